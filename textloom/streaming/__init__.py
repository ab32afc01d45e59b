"""Streams: every column function is stateless, so a stream is matched like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_stream(stream: DataFrame, text_col: str, targets: DataFrame, target_col: str, block, similarity, threshold: float) -> DataFrame:
    """Rows of a stream joined with a static table on a block key, kept where the similarity reaches the threshold."""
    left = stream.withColumn("__block", block(F.col(text_col)))
    right = targets.select(block(F.col(target_col)).alias("__block"), F.col(target_col).alias("target"))
    return left.join(right, "__block").withColumn("sim", similarity(F.col(text_col), F.col("target"))).where(F.col("sim") >= threshold).drop("__block")


def counts_by_window(stream: DataFrame, time_col: str, key, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts of a key in tumbling windows, or sliding ones, with a watermark that bounds the state."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window, slide), key.alias("key")).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time_col: str, key, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts of a key in sessions, which end when the key is away for the gap."""
    return stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("window"), key.alias("key")).agg(F.count("*").alias("n"))


def once(stream: DataFrame, time_col: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows without those that repeat the keys within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
