"""Readers: whole text files as a corpus, and tab-separated n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_corpus(spark: SparkSession, path: str, document_split: str = "\n\n") -> DataFrame:
    """(path, doc_id, text) of the documents in text files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", document_split)).alias("doc_id", "text"))
    return rows


def ngram_table(spark: SparkSession, path: str) -> DataFrame:
    """(ngram array<string>, count): ngram, year, count and volumes by tabs, years added up."""
    rows = spark.read.csv(path, sep="\t", schema="ngram string, year int, count long, doc_count long", quote="")
    return rows.groupBy("ngram").agg(F.sum("count").alias("count")).select(F.split("ngram", " ").alias("ngram"), "count")


def unigram_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, count, doc_count) of a one-word table, part-of-speech suffixes dropped."""
    rows = spark.read.csv(path, sep="\t", schema="word string, year int, count long, doc_count long", quote="")
    word = F.regexp_replace("word", "_[A-Z]+$", "")
    return rows.groupBy(word.alias("word")).agg(F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count"))
