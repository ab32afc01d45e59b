"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A segment is a file of its own: a header, the ids that occur in it by falling frequency (ties by
id), the documents' ids and lengths, then for every token the rank of its id in one to four bytes.
Control bytes hold four two-bit lengths each and stand before the data, so a decoder looks
up lengths in a 256-row table and gathers the bytes by numpy. Segments are stored as the binary
rows of a Parquet table, as any store that Spark writes can hold those, in ascending doc_id order:
documents are range-partitioned and sorted by id, and (part, seq) numbers the segments.

Positions: a segment knows its start inside its part; the parts' totals (one number for each
partition) give the rest when files are read. Null ids come first, rows of equal id are ordered
by text. Null and empty texts hold the end id alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import ids_of, partitions, ragged, record, shared_dir, table, text_chunks, texts

#: Id that ends a document; bytes of text in a segment.
END, SEGMENT = 2, 4 << 20
_MAGIC = b"TLID0001"
_FILE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("segment", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: Lengths of the four ids of a control byte, for each of its values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ids(ids: np.ndarray) -> bytes:
    """Number of ids, number of distinct ids, these by rank, control bytes, data bytes."""
    if not len(ids):
        return np.zeros(2, "<u8").tobytes()
    counts = np.bincount(ids)
    by_rank = np.flatnonzero(counts)
    by_rank = by_rank[np.argsort(-counts[by_rank], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = rank[ids]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = extra
    control = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    at = np.cumsum(extra, dtype=np.int64) - extra + np.arange(len(ids))
    data = np.zeros(int(at[-1]) + int(extra[-1]) + 1, np.uint8)
    for byte in range(int(extra.max()) + 1):
        some = extra >= byte
        data[at[some] + byte] = (ranks[some] >> np.uint32(8 * byte)) & np.uint32(0xFF)
    return np.array([len(ids), len(by_rank)], "<u8").tobytes() + by_rank.astype("<u4").tobytes() + np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes() + data.tobytes()


def decode_ids(raw: bytes, at: int = 0) -> np.ndarray:
    n, distinct = np.frombuffer(raw, "<u8", 2, at).astype(np.int64).tolist()
    at += 16
    by_rank = np.frombuffer(raw, "<u4", distinct, at)
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at + 4 * distinct)
    data = np.frombuffer(raw, np.uint8, offset=at + 4 * distinct + len(control))
    length = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(length) - length
    ranks = np.zeros(n, np.uint32)
    for byte in range(int(length.max()) if n else 0):
        some = length > byte
        ranks[some] |= data[start[some] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return by_rank[ranks] if n else np.zeros(0, np.uint32)


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    valid = np.array([i is not None for i in doc_ids], np.uint8)
    known = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join((_MAGIC, np.array([len(doc_ids)], "<u8").tobytes(), valid.tobytes(), known.tobytes(), lengths.astype("<u8").tobytes(), encode_ids(ids)))


def decode_segment(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, all ids joined."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a token-id segment")
    n = int(np.frombuffer(raw, "<u8", 1, 8)[0])
    valid, known = np.frombuffer(raw, np.uint8, n, 16), np.frombuffer(raw, "<i8", n, 16 + n)
    lengths = np.frombuffer(raw, "<u8", n, 16 + 9 * n).astype(np.int64)
    return pa.array(known, mask=valid == 0), lengths, decode_ids(raw, 16 + 17 * n)


def write_files(documents: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Writes the segments of all documents to `path`."""
    vocab, n = vocabulary or tokens.vocabulary_path(), partitions(documents.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for chunk, data, offsets in text_chunks(batches, SEGMENT):
            ids, counts = tokens.encode(vocab, data, offsets)
            ends = np.cumsum(counts)
            full = np.full(len(ids) + len(counts), end, np.uint32)
            full[ragged(np.arange(len(counts)) + ends - counts, counts)] = ids
            yield record(_FILE, [part], [seq], [start], [len(full)], [encode_segment(ids_of(chunk).to_pylist(), counts + 1, full)])
            seq, start = seq + 1, start + len(full)

    rows = texts(documents).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encoded, "part int, seq int, start long, n_tokens long, segment binary").write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema("part int, seq int, start long, n_tokens long, segment binary").parquet(path)
    base, total = {}, 0
    for r in sorted(files.groupBy("part").agg({"n_tokens": "sum"}).collect()):  # a row for each partition
        base[r[0]], total = total, total + r[1]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, lengths, ids = decode_segment(raw.as_buffer().to_pybytes())
                ends, joined = np.cumsum(lengths), ids.astype("<u4").tobytes()
                crc = [zlib.crc32(joined[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield record(_OUT, doc_ids, base[part] + start + ends - lengths, lengths, crc)

    return files.select("part", "start", "segment").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents and reads the files back."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/op10-{uuid.uuid4().hex}"
    write_files(documents, path)
    return read_files(spark, path)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
