"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes after lower-casing A-Z. Features of a
document are the sets of its words, word pairs and pairs with one word between, hashed to
2**BITS coordinates. The model is fitted by one task on at most SAMPLE labelled documents
(those of smallest hashed id, each at most once), which bounds that task; per-coordinate
learning rates and L1 leave a few hundred weights, at most 2**BITS by construction, and
these are broadcast to score all documents in one pass without a shuffle.

Null and empty texts have no features and get the score of the bias alone. Null labels and
null ids train nothing; conflicting labels of an id count as toxic. Without any usable label
the score of all is under 1e-300. Repeated rows are scored alike, each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, doc_of, ids_of, mix, record, span_hashes, table, text_chunks, texts, word_spans

#: log2 of the number of coordinates, and the bound on the labelled documents that the model is fitted on.
BITS, SAMPLE = 20, 12_000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 0.0, 4

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document number, coordinate) of every word, pair and skip pair, repeats included."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    h, doc = span_hashes(data, starts, ends), doc_of(bounds)
    docs, found = [doc], [h]
    for gap, salt in ((1, U64(0x51AFD6ED558CCD05)), (2, U64(0xC4CEB9FE1A85EC53))):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        docs.append(doc[:-gap][same] if len(doc) > gap else doc[:0])
        found.append(mix(h[:-gap][same] * salt + h[gap:][same]) if len(doc) > gap else h[:0])
    return np.concatenate(docs), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)


def unique_features(doc: np.ndarray, coordinate: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((doc << bits) | coordinate)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def fit(examples: list[tuple[int, np.ndarray]], bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal, one example at a time: bias, coordinates with a weight, their weights."""
    z, n, size = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), 1 << bits
    shrink = np.full((1 << bits) + 1, L1)
    shrink[size] = 0.0  # the bias is not pruned

    def weights(i: np.ndarray) -> np.ndarray:
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - shrink[i], 0) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, at in examples:
            i = np.append(at, size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    kept = np.flatnonzero(every[:size])
    return float(every[size]), kept, every[kept]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model; labels has doc_id and toxic."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = texts(documents).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")  # `sample` rows at most

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("order", pa.int64()), ("toxic", pa.int32()), ("at", pa.binary())])
        for chunk, data, offsets in text_chunks(batches):
            doc, at = unique_features(*features(data, offsets, bits), bits)
            parts = np.split(at.astype(np.uint32), np.searchsorted(doc, np.arange(1, chunk.num_rows)))
            yield record(out, ids_of(chunk), ids_of(chunk, "toxic"), [p.tobytes() for p in parts])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for order, label, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found[(order * 0x9E3779B97F4A7C15) % (1 << 64), order, at] = label  # an order by hash; repeated rows count once
        if found:
            bias, at, w = fit([(label, np.frombuffer(k[2], np.uint32)) for k, label in sorted(found.items())], bits)
            yield record(pa.schema([("bias", pa.float64()), ("at", pa.binary()), ("w", pa.binary())]), [bias], [at.astype(np.uint32).tobytes()], [w.astype(np.float64).tobytes()])

    model = rows.mapInArrow(featurize, "order long, toxic int, at binary").repartition(1).mapInArrow(learn, "bias double, at binary, w binary").collect()
    if not model:
        return -700.0, np.zeros(0, np.int64), np.zeros(0)
    return model[0].bias, np.frombuffer(model[0].at, np.uint32).astype(np.int64), np.frombuffer(model[0].w, np.float64)


def score(documents: DataFrame, model: tuple[float, np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """Scores every whole text; one narrow pass."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # at most 2**bits weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = sent.value
        dense = np.zeros(1 << bits, np.float64)
        dense[at] = w
        for chunk, data, offsets in text_chunks(batches):
            doc, found = features(data, offsets, bits)
            hit = dense[found] != 0
            doc, found = unique_features(doc[hit], found[hit], bits)
            total = bias + np.bincount(doc, dense[found], chunk.num_rows)
            s = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield record(_OUT, ids_of(chunk), ids_of(chunk, "held_out"), s, (s >= 0.5).astype(np.int32))

    rows = texts(documents).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
