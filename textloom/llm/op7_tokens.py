"""Token counts with a digest cache: each distinct text is encoded once per tokenizer version.

The cache is a Parquet table (version, digest, n_tokens), digest being SHA-256 of the text
with null as empty, version a digest of the vocabulary and the library's version. Documents' distinct
digests that it lacks are the misses; one document of each is encoded and the
counts are appended; then all documents join the cache. A hot text is one row among the
distinct digests, and its rows are dealt over several tasks in the last, narrow join.

Null and empty texts have no tokens. Rows that share a text share a cache row. The cache is read once
before and once after the append, so a rerun after a failure only finds more rows, and rows written twice count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import ids_of, materialize, record, row_key, shared_dir, spread_join, table, text_chunks, texts

#: Tokens above which a document is over the limit.
LIMIT = 2048
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
_COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; an absent cache is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def counts(documents: DataFrame, cache: str, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit. New counts are appended to `cache`."""
    spark = documents.sparkSession
    path = vocabulary or tokens.vocabulary_path()
    version = tokens.version(path)
    rows = texts(documents).withColumn("key", row_key()).withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = materialize(rows.select("doc_id", "key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "op7-digests")
    known = cached(spark, cache).where(F.col("version") == version)
    misses = narrow.groupBy("digest").agg(F.min("key").alias("key")).join(known, "digest", "left_anti")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, offsets in text_chunks(batches, 1 << 21):
            yield record(_COUNTED, ids_of(chunk, "digest"), tokens.count(path, data, offsets))

    new = rows.select("key", "digest", "text").join(misses.select("key"), "key", "left_semi").select("digest", "text")
    new = new.mapInArrow(counted, "digest binary, n_tokens long")
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = cached(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return spread_join(narrow, known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache, so that every distinct text is encoded."""
    return counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/op7-cache-{uuid.uuid4().hex}")
