"""Line dedup by a sharded minimal perfect hash.

1. A task hashes the keys of its documents' lines. It sends what it holds of each distinct key (documents, largest id), so that a line that all
   documents share is one row for each task, to the key's hash shard; and where the lines stand, past the shards, to its own block.
2. A shard merges the rows and builds, for the distinct hashes that reach MIN_DOCS documents (no other is ever acted on),
   a minimal perfect hash (levels of bitmaps without collisions) that indexes arrays of fingerprints, counts and keepers. The rows of
   each block probe the arrays, and the block gets those that are there. No line is joined, and neither texts nor arrays move.
3. A block makes the same arrays of its answers, and its documents' lines probe them; the numbers of lost lines, by document, are written
   to shared storage. Documents join these rows, which exist only for documents that lose a line; Spark broadcasts them if their size allows.

Shards stand for about SHARD bytes of text, whatever the corpus: a partition holds several, sorted (spilling if need be) and handled
one after the other. A key is known by a 128-bit hash.

Null and empty texts are one empty line. A null id ranks below all others. Rows that share an id count as
documents of their own and keep or lose a line together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, U64, ids_of, materialize, mix, partitions, record, row_key, table, text_chunks, texts

#: Code points of a key at least, documents that hold it at least, bytes of text that a shard stands for, lines a task holds.
MIN_CHARS, MIN_DOCS, SHARD, HELD = 40, 5, 64 << 20, 1 << 18
_NO_ID = np.iinfo(np.int64).min
_ROW = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4"), ("last", "<i8")])
#: Where a line with a key stands: its document's number in the blob and its own in the document.
_PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u4"), ("line", "<u4")])
#: kind 0: rows of a block for a shard; 1: lines of a block; 2: rows that a shard answers. home: the block's bucket.
_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("home", pa.int32()), ("blob", pa.binary())])
_LOST = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("lost", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def key_of(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    line = line.strip(SPACES)
    if len(line) < MIN_CHARS:
        return None
    key = line.lower()
    return key if key.isascii() or len(key.decode()) >= MIN_CHARS else None


def _merged(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    first = np.concatenate(([0], np.flatnonzero((rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])) + 1))
    out = rows[first]
    out["n"] = np.minimum(np.add.reduceat(rows["n"].astype(np.int64), first), 0xFFFFFFFF)
    out["last"] = np.maximum.reduceat(rows["last"], first)
    return out


class PerfectHash:
    """Levels of bitmaps: a key sits at the first level where no other key falls on its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + n)
            n += int(bits.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        levels = []
        while len(keys):
            size = 64 * -(-2 * len(keys) // 64)
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key in 0..n-1; -1 or any index for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


def _identity(rows: np.ndarray) -> np.ndarray:
    return mix(rows["a"] ^ mix(rows["b"]))


def pack(rows: np.ndarray) -> bytes:
    """A shard's perfect hash and arrays, as bytes."""
    table_ = PerfectHash.of(_identity(rows))
    index = table_.index(_identity(rows))
    arrays = np.empty(len(rows), _ROW)
    arrays[index] = rows
    head = np.array([len(rows), len(table_.levels), *(len(x) for x in table_.levels)], "<i8")
    return b"".join((head.tobytes(), *(np.packbits(x).tobytes() for x in table_.levels), arrays["b"].tobytes(), arrays["n"].tobytes(), arrays["last"].tobytes()))


class Shard:
    """What pack() wrote."""

    def __init__(self, blob: bytes):
        n, levels = np.frombuffer(blob, "<i8", 2).tolist()
        sizes, at = np.frombuffer(blob, "<i8", levels, 16).tolist(), 16 + 8 * levels
        bitmaps = []
        for size in sizes:
            bitmaps.append(np.unpackbits(np.frombuffer(blob, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        self.hash = PerfectHash(bitmaps)
        self.fingerprint = np.frombuffer(blob, "<u8", n, at)
        self.count = np.frombuffer(blob, "<u4", n, at + 8 * n)
        self.last = np.frombuffer(blob, "<i8", n, at + 12 * n)

    def probe(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row's key is in the shard, the largest id that holds it, and in how many documents it is."""
        at = self.hash.index(_identity(rows))
        found = (at >= 0) & (self.fingerprint[at] == rows["b"])
        return found, self.last[at], self.count[at]


def _shard_of(a: np.ndarray, n: int) -> np.ndarray:
    return ((a >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _lines(chunk: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    raw = data.tobytes()
    for a, b, i in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ids_of(chunk).to_pylist(), strict=True):
        yield _NO_ID if i is None else i, raw[a:b].split(b"\n")


def _digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """(bucket, (kind, home, blob) of its rows) of sorted rows; a bucket's rows must be used up before the next."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for bucket, some in groupby(rows, key=itemgetter(0)):
        yield bucket, (row[1:] for row in some)


def _sent(m: int):
    """Step 1: rows for the shards, and the lines' places for the block itself."""

    def flush(home: int, places: list[tuple], docs: list[tuple[int, int]]) -> pa.RecordBatch:
        at = np.array(places, _PLACE)
        rows = np.empty(len(at), _ROW)
        rows["a"], rows["b"], rows["n"], rows["last"] = at["a"], at["b"], 1, np.array([i for _, i in docs], np.int64)[at["doc"]]
        once = np.lexsort((at["doc"], at["b"], at["a"]))  # a key counts once in a document
        x = at[once]
        new = np.ones(len(x), bool)
        new[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1]) | (x["doc"][1:] != x["doc"][:-1])
        rows = _merged(rows[once[new]])  # sorted by hash, and so by shard
        ends = np.searchsorted(_shard_of(rows["a"], m), np.arange(m + 1))
        some = np.flatnonzero(np.diff(ends))
        own = np.array([len(docs)], "<u8").tobytes() + np.array(docs, "<i8").tobytes() + at.tobytes()
        blobs = [own, *(rows[ends[s] : ends[s + 1]].tobytes() for s in some)]
        return record(_DEALT, [home, *some.tolist()], [1, *[0] * len(some)], [home] * (1 + len(some)), blobs)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId() % m
        places: list[tuple[int, int, int, int]] = []
        docs: list[tuple[int, int]] = []
        for chunk, data, offsets in text_chunks(batches):
            for key, (doc_id, lines) in zip(ids_of(chunk, "key").to_pylist(), _lines(chunk, data, offsets), strict=True):
                found = [(*_digest(k), len(docs), i) for i, x in enumerate(lines) if (k := key_of(x)) is not None]
                if found:
                    places += found
                    docs.append((key, doc_id))
                if len(places) >= HELD:
                    yield flush(home, places, docs)
                    places, docs = [], []
        if places:
            yield flush(home, places, docs)

    return sent


def _answered(min_docs: int):
    """Step 2: of each shard's arrays, what the blocks hold."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, some in _by_bucket(batches):
            parts = []
            for kind, home, blob in some:
                if kind == 1:  # a block's own lines, on their way home
                    yield record(_DEALT, [home], [1], [home], [blob])
                else:
                    parts.append((home, np.frombuffer(blob, _ROW)))
            rows = _merged(np.concatenate([r for _, r in parts])) if parts else np.zeros(0, _ROW)
            rows = rows[rows["n"] >= min_docs]
            if not len(rows):
                continue
            shard = Shard(pack(rows))
            for home, asked in parts:
                found, last, count = shard.probe(asked)
                if found.any():
                    known = asked[found]
                    known["last"], known["n"] = last[found], count[found]
                    yield record(_DEALT, [home], [2], [home], [known.tobytes()])

    return answered


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: of each block, the numbers of the lines that its documents lose."""
    for _, some in _by_bucket(batches):
        answers, lines = [], []
        for kind, _, blob in some:
            (lines if kind == 1 else answers).append(blob)
        if not answers:
            continue
        shard = Shard(pack(_merged(np.concatenate([np.frombuffer(x, _ROW) for x in answers]))))
        for blob in lines:
            n = int(np.frombuffer(blob, "<u8", 1)[0])
            docs, at = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(-1, 2), np.frombuffer(blob, _PLACE, offset=8 + 16 * n)
            asked = np.zeros(len(at), _ROW)
            asked["a"], asked["b"] = at["a"], at["b"]
            found, last, _ = shard.probe(asked)
            gone = at[found & (last != docs[at["doc"], 1])]  # by document, as they were sent
            if len(gone):
                first = np.concatenate(([0], np.flatnonzero(gone["doc"][1:] != gone["doc"][:-1]) + 1))
                own = docs[gone["doc"][first]]
                yield record(_LOST, own[:, 0], own[:, 1], [x.tobytes() for x in np.split(gone["line"], first[1:])])


def lost_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, id, lost) of the documents that lose lines, with the lines' numbers; written to shared storage."""
    n = partitions(documents.sparkSession)
    each = max(1, -(-(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (n * SHARD)))  # shards in a partition
    schema = "bucket int, kind int, home int, blob binary"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.floor(F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket")

    keyed = texts(documents).withColumn("key", row_key())
    asked = dealt(keyed.mapInArrow(_sent(n * each), schema))
    lost = dealt(asked.mapInArrow(_answered(min_docs), schema)).mapInArrow(_lost, "key long, id long, lost binary")
    return materialize(lost.groupBy("key", "id").agg(F.min("lost").alias("lost")), "op9-lost")  # equal rows lose the same


def drop_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: n_lines, n_dropped, kept_sha256, and the text that is left as `kept`."""
    out = pa.schema([*_OUT, ("kept", pa.string())])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, offsets in text_chunks(batches):
            n, dropped, left = [], [], []
            for (_, lines), lost in zip(_lines(chunk, data, offsets), ids_of(chunk, "lost").to_pylist(), strict=True):
                gone = set(np.frombuffer(lost or b"", "<u4").tolist())
                n.append(len(lines))
                dropped.append(len(gone))
                left.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]))
            yield record(out, ids_of(chunk), n, dropped, [hashlib.sha256(x).hexdigest() for x in left], [x.decode() for x in left])

    keyed = texts(documents).withColumn("key", row_key()).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    both = keyed.join(lost_lines(documents, min_docs), ["key", "id"], "left").select("doc_id", "text", "lost")
    return both.mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
with doc as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select r, doc_id, i, lines[i] as x from (select *, unnest(range(1, len(lines) + 1)) as i from doc)),
k as (select *, translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
often as (select k, max(coalesce(doc_id, -9223372036854775808)) as last from k where length(k) >= 40 group by k having count(distinct r) >= 5),
marked as (select k.*, often.last is not null and often.last <> coalesce(doc_id, -9223372036854775808) as lost from k left join often using (k))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count_if(lost)::bigint as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not lost), '')) as kept_sha256
from marked group by r
"""
