"""Quality rules: base counts, and an n-gram perplexity within bands of the document's language.

The language model is an interpolated modified Kneser-Ney model over byte n-grams of order
ORDER. Spark counts the n-grams of all whole texts (tasks count theirs first), takes the
continuation counts of the lower orders from the distinct n-grams, and joins the orders to
the interpolated log probability of every n-gram that occurs. Scoring uses sorted arrays of
n-gram hashes and log probabilities, an entry for every n-gram: the 64-bit hash is bijective, so
no two n-grams are merged. The arrays grow with the corpus; they are cut by ranges of the hash and broadcast in
groups of at most about GROUP bytes, collected one group at a time; with more groups than one, every chunk of documents
probes them in turn. Bands: documents that pass the base rules give the quartiles of their
mean negative log probability for each language (null is a language of its own); a document
more than LOW interquartile ranges below the first quartile or HIGH above the third is rejected.

Null texts are empty; texts without bytes have no perplexity and fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK, NOT_SPACE, U64, byte_table, doc_of, ids_of, materialize, mix, numbered, partitions, record, table, text_chunks, word_spans

#: Bytes in an n-gram (at most 7), widths of a band below and above the quartiles in interquartile ranges, set from labels.
ORDER, LOW, HIGH = 5, 4.0, 2.0
#: Bytes of an entry of the model, of entries in a broadcast, of text that probes several broadcasts in turn.
ENTRY, GROUP, PROBING = 12, 64 << 20, 4 << 20
#: N-grams that a counting task holds before it hands its counts on.
HELD = 1 << 21
#: Characters that count as symbols.
_SYMBOLS = byte_table(b"#*$%&|<>")

_COUNTS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("nll", pa.float64())])


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as an integer; documents begin after line ends."""
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + (order - 1) * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded = np.full(len(data) + (order - 1) * len(lengths), 10, np.uint8)
    padded[at] = data
    out = np.zeros(len(data), U64)
    for back in range(order - 1, -1, -1):
        out = (out << U64(8)) | padded[at - back]
    return out


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all whole texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            distinct, at = np.unique(k, return_inverse=True)
            return distinct, np.bincount(at, c, len(distinct)).astype(np.int64)

        for _, data, offsets in text_chunks(batches):
            k, c = np.unique(grams(data, offsets, order), return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = merged()
                keys, counts, held = [k], [c], len(k)
                if held > HELD // 2:
                    yield record(_COUNTS, k.astype(np.int64), c)
                    keys, counts, held = [], [], 0
        if keys:
            k, c = merged()
            yield record(_COUNTS, k.astype(np.int64), c)

    return rows.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp): interpolated modified Kneser-Ney log probability of each n-gram's last byte."""
    orders = {order: counts}
    for k in range(order - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    lower: DataFrame | None = None
    for k in range(1, order + 1):
        n1, n2, n3, n4 = orders[k].agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d1, d2, d3 = (max(0.0, min(i, i - (i + 1) * y * b / a)) if a and y else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        by = Window.partitionBy("context")
        n = F.col("n")
        discount: Column = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rows = orders[k].withColumn("context", F.shiftright("gram", 8)).withColumn("total", F.sum("n").over(by)).withColumn("left", F.sum(discount).over(by))
        rows = rows.select("gram", ((n - discount) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("weight"))
        if lower is None:
            lower = rows.select("gram", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            suffix = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.join(suffix, F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("suffix"))
            lower = rows.select("gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
    return lower.select("gram", F.log("p").alias("logp"))


def shards(model: DataFrame, size: int, group_bytes: int) -> DataFrame:
    """(shard, blob) of a model of `size` n-grams: sorted hashes and log probabilities of a range of hashes, written to shared storage."""
    n = max(partitions(model.sparkSession), -(-4 * ENTRY * size // group_bytes))
    hashed_, packed_ = pa.schema([("shard", pa.int32()), ("hash", pa.int64()), ("logp", pa.float32())]), pa.schema([("shard", pa.int32()), ("blob", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column(0).to_numpy().astype(U64))
            yield record(hashed_, ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32), h.view(np.int64), b.column(1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            shard, h, logp = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h.view(U64))  # and so by shard
            shard, h, logp = shard[order], h[order], logp[order]
            some, starts = np.unique(shard, return_index=True)
            for s, i, j in zip(some, starts, [*starts[1:], len(shard)], strict=True):
                yield record(packed_, [s], [h[i:j].tobytes() + logp[i:j].tobytes()])

    rows = model.select("gram", F.col("logp").cast("float").alias("logp")).mapInArrow(hashed, "shard int, hash long, logp float")
    return materialize(rows.repartitionById(n, F.col("shard")).mapInArrow(packed, "shard int, blob binary"), "op4-model")


def broadcasts(model: DataFrame, size: int, group_bytes: int | None = None) -> list:
    """The model as broadcasts of lists of blobs, by range of the hash, of about group_bytes at most."""
    group_bytes = group_bytes or GROUP
    stored = shards(model, size, group_bytes)
    groups, total = [], 0
    for shard, size_ in sorted((r.shard, r.b) for r in stored.select("shard", F.octet_length("blob").alias("b")).collect()):  # a row for each shard
        if not groups or total + size_ > group_bytes:
            groups.append([])
            total = 0
        groups[-1].append(shard)
        total += size_
    sc = stored.sparkSession.sparkContext
    return [sc.broadcast([bytes(r.blob) for r in sorted(stored.where(F.col("shard").between(g[0], g[-1])).collect())]) for g in groups]


class Entries:
    """The entries of a range of hashes, from blobs in the order of their shards."""

    def __init__(self, blobs: list[bytes]):
        self.hashes = np.concatenate([np.frombuffer(b, U64, len(b) // ENTRY) for b in blobs])
        self.logp = np.concatenate([np.frombuffer(b, np.float32, len(b) // ENTRY, 8 * (len(b) // ENTRY)) for b in blobs])
        span = int(self.hashes[-1] - self.hashes[0])
        self.shift = U64(max(0, span.bit_length() - (2 * len(self.hashes)).bit_length()))
        per_bucket = np.bincount(((self.hashes - self.hashes[0]) >> self.shift).astype(np.int64))
        self.first = np.concatenate(([0], np.cumsum(per_bucket)[:-1])).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where h has hashes that are here, and their log probabilities."""
        inside = np.flatnonzero((h >= self.hashes[0]) & (h <= self.hashes[-1]))
        x = h[inside]
        at = self.first[((x - self.hashes[0]) >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.hashes[at] < x)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < x[left]]
        found = self.hashes[at] == x
        return inside[found], self.logp[at[found]]


def _opened(sent: list) -> Iterator[Entries]:
    """The groups, one after the other; a single group stays open in the worker's task."""
    for b in sent:
        if not hasattr(b, "_open"):
            b._open = Entries(b.value)
            del b._value
        yield b._open
        if len(sent) > 1:
            del b._open


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n_docs = len(offsets) - 1
    starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = per_doc(NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOLS[data])
    doc, words = doc_of(bounds), len(starts)
    repeats = np.zeros(n_docs, np.int64)
    if words > 2:
        number, first = numbered(data, starts, ends)
        three = doc[:-2]  # the document and the three words, as one integer
        for word in (number[:-2], number[1:-1], number[2:]):
            if (int(three.max()) + 1) * len(first) >= 1 << 62:
                three = np.unique(three, return_inverse=True)[1]
            three = three * len(first) + word
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.argsort(three[inside])]
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(words, bool)
        for step in range(3):
            covered[order[twice] + step] = True
        total = np.concatenate(([0], np.cumsum(covered)))
        repeats = total[bounds[1:]] - total[bounds[:-1]]
    raw, lines = data.tobytes(), np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        found = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(found) - len(set(found))
    return [np.diff(bounds), chars, symbols, lines, repeats]


def scored(rows: DataFrame, sent: list, order: int = ORDER) -> DataFrame:
    """Base counts and the mean negative log probability of each byte; sent: the model's broadcasts."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, offsets in text_chunks(batches, PROBING if len(sent) > 1 else CHUNK):
            h = mix(grams(data, offsets, order))
            logp, least = np.full(len(h), np.nan, np.float32), 0.0
            for entries in _opened(sent):
                at, found = entries.find(h)
                logp[at] = found
                least = min(least, float(entries.logp.min()))
            logp[np.isnan(logp)] = least
            total = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
            n = np.diff(offsets)
            nll = (total[offsets[:-1]] - total[offsets[1:]]) / np.maximum(n, 1)
            yield record(_SCORED, ids_of(chunk), ids_of(chunk, "lang"), *base_counts(data, offsets), pa.array(nll, mask=n == 0))

    return rows.mapInArrow(judged, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nll double")


def rules(documents: DataFrame, below: float = LOW, above: float = HIGH) -> DataFrame:
    """The verdicts, one row per document, with nll and the band of its language."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(count_grams(rows), "op4-grams")
    judged = scored(rows, broadcasts(kneser_ney(counts), counts.count()))
    judged = judged.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = materialize(judged, "op4-scored")
    quartiles = judged.where("not base_failed").groupBy("lang").agg(F.percentile_approx("nll", [0.25, 0.75], 10_000).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    bands = quartiles.select(F.col("lang").alias("band_lang"), (low - below * (high - low)).alias("band_low"), (high + above * (high - low)).alias("band_high"))
    joined = judged.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left")  # broadcast if its measured size allows
    kept = ~F.col("base_failed") & F.coalesce(F.col("nll").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "nll", "band_low", "band_high")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
