"""A training corpus from raw documents, stage by stage; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import op2_decontamination, op5_simhash, op6_mixing, op8_language, op10_token_ids
from textloom.llm.common import materialize, table


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in bad; a null id is an id."""
    ids = bad.select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__bad_id")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return _without(docs, op8_language.predict(docs, op8_language.learn(docs)).where("not accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; ids are unique in documents, a null id stays only without a group that has ids."""
    return _without(docs, op5_simhash.near_duplicates(docs).where("component_id is not null and not (doc_id <=> component_id)"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return op2_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The calibrated sample."""
    return op6_mixing.sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold."""
    return op10_token_ids.token_files(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
#: Fingerprints, compression and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
