"""Record linkage: blocking, similarity joins, the k best matches, statistics of pairs, clusters by a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures


def blocked_pairs(left: DataFrame, right: DataFrame, block: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pairs that share a block key: an equi-join, so Spark shuffles by the key and splits skewed blocks itself."""
    x = left.select(F.col(block).alias("block"), F.col(id_col).alias("src_id"), F.col(text_col).alias("src"))
    y = right.select(F.col(block).alias("block"), F.col(id_col).alias("tar_id"), F.col(text_col).alias("tar"))
    return x.join(y, "block")


def self_pairs(df: DataFrame, block: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return blocked_pairs(df, df, block, id_col, text_col).where("src_id < tar_id")


def q_gram_join(left: DataFrame, right: DataFrame, threshold: float = 0.8, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pairs of distinct texts whose sets of padded bigrams have a Jaccard similarity of at least threshold, exactly.

    Prefix filtering: with tokens in one order of rising frequency, two such sets share a token among the first
    size - ceil(threshold * size) + 1 of either. Only these are joined, rare tokens first, and the
    sizes must fit, so common tokens make no pairs; equal texts are one row.
    """

    def sets(df: DataFrame) -> DataFrame:
        return df.select(F.col(text_col).alias("text")).where("text is not null").distinct().withColumn("tokens", F.array_distinct(measures.q_grams(F.col("text"))))

    x, y = sets(left), sets(right)
    weight = x.unionByName(y).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = df.select("text", F.explode("tokens").alias("token")).join(weight, "token").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        size = F.size("ranked")
        first = F.slice("ranked", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
        return ranked.select("text", F.transform("ranked", lambda t: t["token"]).alias("tokens"), F.explode(first).alias("t")).select("text", "tokens", F.col("t.token").alias("token"))

    l = prefixes(x).select("token", F.col("text").alias("src"), F.col("tokens").alias("x"))  # noqa: E741
    r = prefixes(y).select("token", F.col("text").alias("tar"), F.col("tokens").alias("y"))
    fits = (F.size("x") >= F.size("y") * threshold - 1e-9) & (F.size("y") >= F.size("x") * threshold - 1e-9)
    pairs = l.join(r, "token").where(fits).dropDuplicates(["src", "tar"])
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.withColumn("sim", shared / (F.size("x") + F.size("y") - shared)).where(F.col("sim") >= threshold - 1e-12).select("src", "tar", "sim")


def top_k(pairs: DataFrame, k: int, by: str = "src_id", score: str = "sim", ties: bool = True) -> DataFrame:
    """The k best rows of each `by`; all ties of the last one if ties."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc())
    rank = F.rank() if ties else F.row_number()
    return pairs.withColumn("rank", rank.over(w)).where(F.col("rank") <= k)


def pair_statistics(pairs: DataFrame, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """max, min, mean and population standard deviation of the similarity of (src, tar) rows."""
    rows = pairs.withColumn("sim", similarity(F.col("src"), F.col("tar"))) if similarity else pairs
    return rows.agg(F.max("sim").alias("max"), F.min("sim").alias("min"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))


def mean_pairwise_similarity(pairs: DataFrame, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Harmonic mean of the similarity of all rows; 0 if one is 0, NaN if more are."""
    rows = pairs.select(similarity(F.col("src"), F.col("tar")).alias("sim"))
    zeros = F.count_if(F.col("sim") == 0)
    mean = F.count("sim") / F.sum(F.when(F.col("sim") > 0, 1 / F.nullif(F.col("sim"), F.lit(0.0))))
    return rows.agg(F.when(zeros > 1, F.lit(float("nan"))).when(zeros == 1, 0.0).otherwise(mean).alias("mean"))


def key_collisions(df: DataFrame, key: Column, text_col: str = "text") -> DataFrame:
    """(key, n, least, greatest) of keys that several distinct texts share, as in clustering by fingerprint."""
    rows = df.select(key.alias("key"), F.col(text_col).alias("text")).distinct()
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("text").alias("least"), F.max("text").alias("greatest")).where("n > 1")
