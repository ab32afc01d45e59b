"""Cells of a pair's tokens when tokens that are only alike also count as shared; every measure over cells works on them.

`soft` splits two like tokens into what they share and what is left of each; `fuzzy` shares like tokens from the likest
pair on; `linkage` shares by the assignment of least total distance. Null on either side gives null cells.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edits, measures
from .alignments import aligned


@lru_cache(1 << 16)
def _likeness(s: str, t: str) -> float:
    longer = max(len(s), len(t))
    return max(longer - edits.edit_distance(s, t), edits.shared_prefix(s, t)) / longer


_levenshtein = lru_cache(1 << 16)(edits.levenshtein)


def soft(x: Counter, y: Counter) -> tuple[Counter, Counter, Counter]:
    """What is shared, and what is left of either side."""
    shared, left, right = x & y, x - y, y - x
    likeness = {(s, t): _likeness(s, t) for s in left for t in right}
    parts = Counter(), Counter()
    for s, t in sorted(likeness, key=lambda k: (-likeness[k], k)):
        n = min(left[s], right[t])
        if not n or not likeness[s, t]:
            continue
        steps = aligned(s, t)
        for side, out in ((0, parts[0]), (1, parts[1]), (2, shared)):
            # 0 and 1: the letters of one string that find no partner; 2: those that do
            letters = [p[0] if p[0] == p[1] else None for p in steps] if side == 2 else [p[side] if p[0] != p[1] else None for p in steps]
            out["".join(c or "-" for c in letters).strip("-")] += n * sum(c is not None for c in letters) / len(steps)
        left[s] -= n
        right[t] -= n
    return shared, left + parts[0], right + parts[1]


def _share(x: Counter, y: Counter, links) -> tuple[Counter, Counter, Counter]:
    """Counts of linked tokens are shared in proportion to their likeness, once each."""
    shared, left, right = x & y, x - y, y - x
    rest = left.copy(), right.copy()
    for s, t, sim in links(left, right):
        n = min(rest[0][s], rest[1][t])
        rest[0][s] -= n
        rest[1][t] -= n
        shared[s] += sim / 2 * n
        shared[t] += sim / 2 * n
        left[s] -= sim * n
        right[t] -= sim * n
    return shared, +left, +right


def fuzzy(x: Counter, y: Counter, like=_levenshtein, threshold: float = 0.8) -> tuple[Counter, Counter, Counter]:
    def links(left, right):
        sims = [(like(s, t), s, t) for s in left for t in right]
        return [(s, t, sim) for sim, s, t in sorted(sims, key=lambda k: (-k[0], k[1:])) if sim >= threshold]

    return _share(x, y, links)


def assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Rows and columns of the least total, for no more rows than columns; one shortest augmenting path for each row."""
    rows, columns = len(cost), len(cost[0]) if cost else 0
    of_row, of_column, taken = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1)
    for i in range(1, rows + 1):
        taken[0], at = i, 0
        least, back, done = [float("inf")] * (columns + 1), [0] * (columns + 1), set()
        while taken[at]:
            done.add(at)
            row, free = taken[at], [j for j in range(1, columns + 1) if j not in done]
            for j in free:
                slack = cost[row - 1][j - 1] - of_row[row] - of_column[j]
                if slack < least[j]:
                    least[j], back[j] = slack, at
            nearest = min(free, key=least.__getitem__)
            step = least[nearest]
            for j in done:
                of_row[taken[j]] += step
                of_column[j] -= step
            for j in free:
                least[j] -= step
            at = nearest
        while at:
            taken[at] = taken[back[at]]
            at = back[at]
    return [(taken[j] - 1, j - 1) for j in range(1, columns + 1) if taken[j]]


@lru_cache(1 << 16)
def _damerau(a: str, b: str) -> float:
    return edits.of_longer(edits.damerau(a, b), a, b)


def linkage(x: Counter, y: Counter, like=_damerau, threshold: float = 0.1) -> tuple[Counter, Counter, Counter]:
    def links(left, right):
        few, many = sorted((sorted(left), sorted(right)), key=len)
        turned = len(right) < len(left)
        cost = [[1 - (like(t, s) if turned else like(s, t)) for t in many] for s in few]
        for i, j in assignment(cost):
            if 1 - cost[i][j] >= threshold:
                yield (many[j], few[i], 1 - cost[i][j]) if turned else (few[i], many[j], 1 - cost[i][j])

    return _share(x, y, links)


KINDS = {"soft": soft, "fuzzy": fuzzy, "linkage": linkage}
_CELLS = "a double, b double, c double, p double, q double, u long"


def with_cells(pairs: DataFrame, intersection: str = "soft", src: str = "src", tar: str = "tar", kind: str = "padded", alphabet: int = measures.ALPHABET, **options) -> DataFrame:
    """As measures.with_cells, with the named intersection; options go to it (like: a similarity of two strings, threshold)."""
    share = KINDS[intersection]

    def cells(x: list[str], y: list[str]) -> tuple:
        x, y = Counter(x), Counter(y)
        shared, left, right = share(x, y, **options)
        a, b, c = (float(sum(part.values())) for part in (shared, left, right))
        whole = (a + b, a + c) if intersection == "soft" else (float(x.total()), float(y.total()))
        return a, b, c, *whole, len(+left + +right + shared) if intersection == "soft" else len(x | y)

    def batch(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 6 if s is None or t is None else cells(s, t) for s, t in zip(x, y)]
        return pd.DataFrame(rows, columns=list("abcpqu"))

    df = pairs.withColumn("x", measures.tokens(F.col(src), kind)).withColumn("y", measures.tokens(F.col(tar), kind)).withColumn("same", F.col(src) == F.col(tar))
    df = df.withColumn("cells", F.pandas_udf(batch, _CELLS)("x", "y")).select("*", "cells.*").drop("cells")
    rest = lambda n: F.greatest(F.lit(0), F.lit(alphabet) - n).cast("double")
    df = df.withColumn("d", rest(F.col("u"))).withColumns({"r": F.expr("c + d"), "s": F.expr("b + d"), "n": F.expr("a + b + c + d")})
    return df.withColumns({"x_p": F.size("x").cast("double"), "y_p": F.size("y").cast("double"), "x_d": rest(F.size(F.array_distinct("x"))), "y_d": rest(F.size(F.array_distinct("y")))})


#: Normalizers of cells, margins and the total; the second is the number of squares that a count covers.
NORMALIZERS = {
    "proportional": lambda v, squares: v / F.greatest(F.lit(1.0), F.col("n")),
    "log": lambda v, squares: F.log1p(v),
    "exp": lambda v, squares: F.exp(v),
    "laplace": lambda v, squares: v + squares,
    "inverse": lambda v, squares: F.when(v == 0, F.col("n")).otherwise(1 / F.nullif(v, F.lit(0.0))),
    "complement": lambda v, squares: F.col("n") - v,
}


def normalized(cells: DataFrame, normalizer: str) -> DataFrame:
    """The table of cells with its counts normalized."""
    form = NORMALIZERS[normalizer]
    return cells.withColumns({c: form(F.col(c), n) for n, names in ((1, "abcd"), (2, "pqrs"), (4, "n")) for c in names})


def measure(pairs: DataFrame, name: str, intersection: str = "soft", normalizer: str | None = None, **options) -> DataFrame:
    """Adds `sim`, the named measure over the cells of the intersection."""
    cells = with_cells(pairs, intersection, kind=measures.TOKENS.get(name, "padded"), **options)
    return (normalized(cells, normalizer) if normalizer else cells).withColumn("sim", F.expr(measures.similarity(name)))


def query(name: str, intersection: str):
    def run(spark, sf_dir: str) -> DataFrame:
        pairs = measures.pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))
        return measure(pairs, name, intersection).select("id", "src", "tar", F.round("sim", 9).alias("sim"))

    return run
