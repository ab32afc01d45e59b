"""Corpus operators: words of documents and sentences, counts, inverse document frequencies, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentence_split: str = "\n", filter_chars: str = "", stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, sent_id, pos, word): whitespace words, without the filtered characters and stop words."""
    sentences = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, sentence_split)).alias("sent_id", "sentence"))
    clean: Column = F.translate("sentence", filter_chars, "") if filter_chars else F.col("sentence")
    found = F.regexp_extract_all(clean, F.lit(r"(\S+)"), 1)
    if stop_words:
        found = F.filter(found, lambda w: ~w.isin(stop_words))
    return sentences.select("doc_id", "sent_id", F.posexplode(found).alias("pos", "word"))


def unigrams(rows: DataFrame) -> DataFrame:
    """(word, count, doc_count) of what words() gives; counted for each document first, so no word's documents meet in one task."""
    return rows.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("count"), F.count("*").alias("doc_count"))


def idf(counts: DataFrame, n_documents: int, smooth: bool = False) -> DataFrame:
    """Adds idf = ln(N/df), or ln(1 + N/df) if smooth."""
    ratio = F.lit(float(n_documents)) / F.col("doc_count")
    return counts.withColumn("idf", F.log1p(ratio) if smooth else F.ln(ratio))


def tf_idf(rows: DataFrame, n_documents: int) -> DataFrame:
    """(doc_id, word, tf_idf): log1p(tf) times ln(1 + N/df), each document's vector of length 1."""
    tf = rows.groupBy("word", "doc_id").agg(F.count("*").alias("tf"))
    seen = tf.groupBy("word").agg(F.count_if(F.col("tf") > 0).alias("doc_count"))  # reads tf so that both sides need the same columns and share one exchange
    weighed = tf.join(idf(seen, n_documents, True).select("word", "idf"), "word").withColumn("weight", F.log1p("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return weighed.select("doc_id", "word", (F.col("weight") / norm).alias("tf_idf"))


def n_grams(documents: DataFrame, n: int = 2, text_col: str = "text", sentence_split: str = "\n") -> DataFrame:
    """(ngram, count): word n-grams of sentences with _START_ and _END_ around them."""
    found = F.regexp_extract_all("sentence", F.lit(r"(\S+)"), 1)
    padded = F.concat(F.array(F.lit("_START_")), found, F.array(F.lit("_END_")))
    # The outer transform binds the words once; the inner one would otherwise match them anew for every n-gram.
    slices = F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - (n - 1))), lambda i: F.array_join(F.slice(p, i, n), " ")))
    grams = F.flatten(F.filter(slices, lambda g: F.size(g) > 0))
    sentences = documents.select(F.explode(F.split(text_col, sentence_split)).alias("sentence"))
    found = sentences.select(F.explode(grams).alias("ngram")).where(F.size(F.split("ngram", " ")) == n)
    return found.groupBy("ngram").agg(F.count("*").alias("count"))


def n_grams_up_to(documents: DataFrame, n: int = 3, text_col: str = "text", sentence_split: str = "\n", start: str = "_START_", end: str = "_END_") -> DataFrame:
    """(ngram, size, count): word n-grams of 1 to n words; an empty start or end mark is left out."""
    found = F.regexp_extract_all("sentence", F.lit(r"(\S+)"), 1)
    padded = F.concat(*([F.array(F.lit(start))] if start else []), found, *([F.array(F.lit(end))] if end else []))
    sentences = documents.select(F.explode(F.split(text_col, sentence_split)).alias("sentence")).select(padded.alias("p")).where(F.size("p") > 0)
    p = F.col("p")
    slices = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size(p) - i + 1)), lambda k: F.struct(F.array_join(F.slice(p, i, k), " ").alias("ngram"), k.alias("size"))))
    return sentences.select(F.inline(F.flatten(slices))).groupBy("ngram", "size").agg(F.count("*").alias("count"))


def n_gram_count(counts: DataFrame, ngram: str | list[str]) -> DataFrame:
    """(count): the n-gram's, 0 if there is none."""
    key = ngram if isinstance(ngram, str) else " ".join(ngram)
    return counts.where(F.col("ngram") == key).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
