"""SimHash near-dedup: exact links at a Hamming distance of RADIUS or less, found by vantage-point trees.

Fingerprints of whole texts are written once to shared storage. A tree of vantage points
fitted on a bounded sample of the distinct fingerprints deals all of them to shards: at a node a
fingerprint goes to the near side, the far side, or to both if it lies so close to the
boundary that a partner may be on either side. Each shard goes on splitting around
vantage points of its own, compares its leaves in blocks, and returns a star for each leaf's component instead of
pairs. A leaf that cannot be split (many texts in one ball) looks up all fingerprints within
RADIUS bits instead, so nothing is quadratic in a group. Components come from minima along
the stars with pointer jumping, written to shared storage every round.

Null and empty texts have fingerprint zero and link like any other. A null id is no smallest id; a
component without ids has a null component_id. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, ids_of, materialize, partitions, record, spread_join, table, text_chunks, texts

#: Differing bits that link, words in a shingle, seed of XXH64.
RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints in the sample that the dealing tree is fitted on; of a shard; of a leaf.
SAMPLE, SHARD, LEAF = 1 << 17, 1 << 14, 1024

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_DEALT = pa.schema([("shard", pa.int32()), ("fps", pa.binary())])
_STARS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def simhash(text: bytes) -> int:
    """The fingerprint of a lower-cased text."""
    words = text.split()
    if not words:
        return 0
    joined, k = b" ".join(words), SHINGLE
    if len(words) <= k:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], U64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        starts = (ends - length)[: len(words) - k + 1]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], U64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, offsets in text_chunks(batches):
            raw = LOWER[data].tobytes()
            fps = [simhash(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield record(_FINGERPRINTS, ids_of(chunk), np.array(fps, U64).view(np.int64))

    return texts(documents).mapInArrow(hashed, "doc_id long, fp long")


def _split(points: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a boundary with few points near it, or None if no split is worth it."""
    best = None
    for k in range(4):
        vantage = points[(seed * 2654435761 + k * 40503) % len(points)]
        at = np.bincount(np.bitwise_count(points ^ vantage), minlength=68 + RADIUS).cumsum() / len(points)
        for mu in range(64):  # near: distance < mu + RADIUS; far: distance >= mu
            near, far = at[mu + RADIUS - 1], 1 - (at[mu - 1] if mu else 0)
            if max(near, far) < 0.8 and (best is None or near + far + abs(near - far) / 4 < best[0]):
                best = (near + far + abs(near - far) / 4, vantage, mu)
    return best and (best[1], best[2])


def dealing_tree(sample: np.ndarray, size: float, seed: int = 1) -> tuple:
    """Nested (vantage point, boundary, near, far); size: fingerprints that each sampled one stands for."""
    found = _split(sample, seed) if len(sample) * size > SHARD and len(sample) >= 64 else None
    if found is None:
        return ()
    d = np.bitwise_count(sample ^ found[0])
    return (*found, dealing_tree(sample[d < found[1] + RADIUS], size, 2 * seed), dealing_tree(sample[d >= found[1]], size, 2 * seed + 1))


def _leaves(tree: tuple, points: np.ndarray, seed: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    if not tree:
        yield seed, points
        return
    vantage, mu, near, far = tree
    d = np.bitwise_count(points ^ vantage)
    yield from _leaves(near, points[d < mu + RADIUS], 2 * seed)
    yield from _leaves(far, points[d >= mu], 2 * seed + 1)


def _numbered(tree: tuple, seed: int = 1) -> list[int]:
    return [seed] if not tree else _numbered(tree[2], 2 * seed) + _numbered(tree[3], 2 * seed + 1)


def _minima(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf: in blocks, or by looking up all neighbours if it is large."""
    i, j = [], []
    if len(points) <= 4 * LEAF:
        for at in range(0, len(points), 256):
            a, b = np.nonzero(np.bitwise_count(points[at : at + 256, None] ^ points[None, at:]) <= RADIUS)
            keep = b > a
            i.append(a[keep] + at)
            j.append(b[keep] + at)
    else:
        bits = [U64(1 << k) for k in range(64)]
        masks = [a for a in bits] + [bits[a] | bits[b] for a in range(64) for b in range(a)]
        for m in masks:
            other = points ^ m
            at = np.minimum(np.searchsorted(points, other), len(points) - 1)
            hit = np.flatnonzero((points[at] == other) & (at > np.arange(len(points))))
            i.append(hit)
            j.append(at[hit])
    return np.concatenate(i), np.concatenate(j)


def local_stars(points: np.ndarray, seed: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, smallest of its component) of every leaf, without the singles."""
    found = _split(points, seed) if len(points) > LEAF else None
    if found is not None:
        d = np.bitwise_count(points ^ found[0])
        yield from local_stars(points[d < found[1] + RADIUS], 2 * seed)
        yield from local_stars(points[d >= found[1]], 2 * seed + 1)
    elif len(points) > 1:
        label = _minima(len(points), *_links(points))
        moved = np.flatnonzero(label != np.arange(len(points)))
        yield points[moved], points[label[moved]]


def stars(distinct: DataFrame) -> DataFrame:
    """(u, v): links that span the components of all distinct fingerprints `fp` at RADIUS or less."""
    n = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64).view(U64)
    if not len(sample):
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    tree = dealing_tree(sample, n / len(sample))
    number = {seed: i for i, seed in enumerate(_numbered(tree))}
    parts = partitions(distinct.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = [(number[seed], part.tobytes()) for seed, part in _leaves(tree, batch.column(0).to_numpy().view(U64)) if len(part)]
            yield record(_DEALT, [s for s, _ in dealt], [b for _, b in dealt])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for shard, some in groupby(rows, key=itemgetter(0)):  # one shard at a time
            for u, v in local_stars(np.unique(np.frombuffer(b"".join(fps for _, fps in some), U64)), shard + 1):
                yield record(_STARS, u.view(np.int64), v.view(np.int64))

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fps binary").repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard")
    return dealt.mapInArrow(linked, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the same label for the nodes of a component of links (u, v)."""
    both = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "op5-links")
    label = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), "op5-labels")
    while True:
        seen = spread_join(both, label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("seen")).withColumnRenamed("u", "node")
        lower = materialize(label.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "op5-seen")
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        lower = materialize(spread_join(lower, jump, "label").select("node", "old", F.least("label", "jump").alias("label")), "op5-labels")
        label = lower.select("node", "label")
        if not lower.where("old <> label").take(1):
            return label


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint in hex, component_id."""
    prints = materialize(fingerprints(documents), "op5-fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "op5-distinct")
    label = components(stars(distinct))
    joined = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", "label")
    joined = materialize(joined, "op5-joined")
    least = joined.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    of = spread_join(joined, least, "label", "left").select("fp", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return spread_join(prints, materialize(of, "op5-components"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
