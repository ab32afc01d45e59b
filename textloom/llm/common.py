"""What the operators share: reading tables, shared storage, and byte-level text kernels in numpy.

Texts reach the kernels as Arrow buffers, so a chunk of documents is one uint8 array with
offsets and no Python string is made. A chunk holds whole documents of about CHUNK bytes
together, or one longer document; memory follows the longest document.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time.
CHUNK = 1 << 19
U64 = np.uint64
#: Multiplier of the span hash (odd) and constants of the 64-bit mixer.
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: The four white-space classes of the contracts: space and \t \n \v \f \r.
SPACES = b" \t\n\v\f\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table; other columns, clashing names included, stay out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A key of a row that also tells rows apart that share a doc_id but not the text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's checkpoint folder, else one in the warehouse; a local folder only if Spark runs on this machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(found or f"{spark.conf.get('spark.sql.warehouse.dir')}/textloom-checkpoints")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to `one`, which has a key once: keys that hold more than a task's share of rows are dealt over as many tasks as they hold shares.

    There are fewer such keys than partitions, and fewer than twice as many extra rows in `one`; both sides should be stored tables, as they are read twice.
    """
    n, total = partitions(rows.sparkSession), rows.count()
    shares = F.ceil(F.col("n") * n / max(total, 1)).cast("int")
    hot = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * n > total).select(key, shares.alias("__shares")), "hot-keys")
    part = F.pmod(F.xxhash64(*rows.columns, F.lit("part")), F.coalesce("__shares", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", part.cast("int")).drop("__shares")  # fewer rows than partitions
    copies = one.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK, col: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole documents, of about `limit` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(col))
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, where, data = column.buffers()
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> U64(30))
    h *= _MIX1
    h ^= h >> U64(27)
    h *= _MIX2
    h ^= h >> U64(31)
    return h


#: Spans longer than this are hashed and compared one by one.
_LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _steps(length: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(spans, offset, masks) of the eight-byte steps through spans that are not long."""
    some, k = np.flatnonzero((length > 0) & (length <= _LONG)), 0
    while len(some):
        yield some, k, _KEEP[np.minimum(length[some] - k, 8)]
        k += 8
        some = some[length[some] > k]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], mixed anew after every eight bytes. Equal hashes do not prove equal bytes: see numbered() and Spans."""
    window, length = eight_bytes(data), ends - starts
    h = mix(length.astype(U64) * U64(_BASE))
    for some, k, mask in _steps(length):
        h[some] = mix(h[some] * U64(_BASE) + (window[starts[some] + k] & mask))
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, data2: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether the bytes of each data[start:end] are those of data2[start2:end2]."""
    window, window2, length = eight_bytes(data), eight_bytes(data2), ends - starts
    same = length == ends2 - starts2
    for some, k, mask in _steps(np.where(same, length, 0)):
        same[some] &= ((window[starts[some] + k] ^ window2[starts2[some] + k]) & mask) == 0
    for i in np.flatnonzero(same & (length > _LONG)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], data2[starts2[i] : ends2[i]])
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for the same bytes only, and a span of each number. h: the spans' hashes."""
    _, first, number = np.unique(span_hashes(data, starts, ends) if h is None else h, return_index=True, return_inverse=True)
    same = first[number]
    odd = ~equal_spans(data, starts, ends, data, starts[same], ends[same])
    if odd.any():  # different bytes, one hash
        fresh: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            number[i] = fresh.setdefault(data[starts[i] : ends[i]].tobytes(), len(first) + len(fresh))
        _, again = np.unique(number, return_index=True)
        first = again
    return number, first


class Spans:
    """Distinct spans, found by hash and known by their bytes; slots count up from 0 in the order of adding."""

    def __init__(self):
        self.hash, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.raw, self.start, self.end = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.slot)

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Adds spans that are distinct and not there yet."""
        order = np.argsort(h, kind="stable")
        at = np.searchsorted(self.hash, h[order])
        self.hash = np.insert(self.hash, at, h[order])
        self.slot = np.insert(self.slot, at, order + len(self.start))
        stops = np.cumsum(ends - starts) + len(self.raw)
        self.raw = np.concatenate((self.raw, data[ragged(starts, ends - starts)]))
        self.start, self.end = np.concatenate((self.start, stops - (ends - starts))), np.concatenate((self.end, stops))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each span, -1 if it is not there."""
        out, at, left = np.full(len(h), -1, np.int64), np.searchsorted(self.hash, h), np.arange(len(h))
        while True:
            left = left[at[left] < len(self.hash)]
            left = left[self.hash[at[left]] == h[left]]
            if not len(left):
                return out
            slot = self.slot[at[left]]
            same = equal_spans(data, starts[left], ends[left], self.raw, self.start[slot], self.end[slot])
            out[left[same]] = slot[same]
            left = left[~same]
            at[left] += 1


def byte_table(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words between white space, and bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing.
NOT_SPACE = ~byte_table(SPACES)
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of member bytes inside a document), and the index of the first word of each document, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = members[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    stops = inside
    stops[:-1] &= begins[1:] | ~members[data[1:]]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """Document number of each word, from the bounds that word_spans gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all ranges, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ids_of(rows: pa.RecordBatch, col: str = "doc_id") -> pa.Array:
    return rows.column(rows.schema.get_field_index(col))


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))
