"""Mixing sources to target weights: token weights raked to marginals, then a calibrated sample.

Documents fall into cells of source, language and topic. Iterative proportional fitting
starts from the cells' token counts and scales them, margin after margin, until the token
shares of every source, language and topic meet their targets. A document stays with a
probability in proportion to raked weight / tokens of its cell, scaled so that the cell that needs most keeps RATE of its
documents: no probability passes 1 and none is cut, so that the sample's expected shares are the raked ones, and with RATE 1 it is the
largest such sample without copies. A hash of the id decides, so the same
sample comes out of any run. Only DataFrame functions are used, and only cells are shuffled.

A target is a mapping of values to weights (values that it lacks keep their own tokens), or an exponent:
each value's token share to that power. Null is a value like any other. A document
without tokens has weight and probability 0. Rows with one id get one verdict. The topic of this corpus is the
form of a text, as it has no other topic column; any column expression can take its place.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Exponents of the token shares, rounds of raking, rounds between cuts of the lineage, share to keep of the cell that needs most.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, CUT, RATE = 12, 4, 1.0
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The form of a text: short, list, long or prose."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(n_tokens < 100, "short").when(8 * lines > n_tokens, "list").when(n_tokens >= 1000, "long").otherwise("prose")


def _features(documents: DataFrame) -> DataFrame:
    """The documents with the four columns that decide, under names of our own."""
    text, tokens = F.coalesce("text", F.lit("")), F.col("__mix_tokens")
    found = documents.withColumn("__mix_tokens", F.regexp_count(text, F.lit(_WORD)).cast("long"))
    return found.withColumns({"__mix_source": F.col("source").cast("string"), "__mix_lang": F.col("lang").cast("string"), "__mix_topic": topic_of(text, tokens)})


def _goal(target: float | dict[str, float], value: Column, own: Column) -> Column:
    """A value's goal before its margin is scaled."""
    if not isinstance(target, dict):
        return F.pow(own, F.lit(float(target)))
    given = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in target.items()))[value] if target else F.lit(None)
    return F.coalesce(given, own)


def rake(cells: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """cells: the targets' columns and tokens (positive); the same with weight raked to the targets' marginals."""
    cells = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "op6-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for dim, target in targets.items():
        margin = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("__own")).withColumn("__goal", _goal(target, F.col(dim), F.col("__own")))
        scale = total / (margin.agg(F.sum("__goal")).first()[0] or 1.0)  # a number for each margin
        own = F.sum("tokens").over(Window.partitionBy(dim)).cast("double")
        cells = cells.withColumn(f"__goal_{dim}", _goal(target, F.col(dim), own) * F.lit(scale))
    for k in range(rounds):
        if k and k % CUT == 0:
            cells = materialize(cells, "op6-cells")
        for dim in targets:
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"__goal_{dim}") / F.sum("weight").over(Window.partitionBy(dim)))
    return materialize(cells.select(*targets, "tokens", "weight"), "op6-cells")


def calibrated(documents: DataFrame, targets: dict = TARGETS, rate: float = RATE) -> DataFrame:
    """The documents, all columns, with __mix_source, __mix_lang, __mix_topic, __mix_tokens, __mix_weight, __mix_prob, __mix_sampled."""
    rows = _features(documents)
    dims = {f"__mix_{d}": d for d in targets}
    cells = rows.where("__mix_tokens > 0").groupBy(*(F.col(m).alias(d) for m, d in dims.items())).agg(F.sum("__mix_tokens").alias("tokens"))
    raked = rake(cells, targets).select(*(F.col(d).alias(f"__cell_{d}") for d in targets), (F.col("weight") / F.col("tokens")).alias("__cell_weight"))
    largest = raked.agg(F.max("__cell_weight")).first()[0] or 1.0
    same = [F.col(m).eqNullSafe(F.col(f"__cell_{d}")) for m, d in dims.items()]
    joined = rows.join(raked, [*same], "left")  # broadcast if the cells' measured size allows
    weight = F.when(F.col("__mix_tokens") > 0, F.col("__cell_weight")).otherwise(0.0)
    prob = F.col("__mix_weight") / F.lit(largest) * F.lit(rate)
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = joined.withColumn("__mix_weight", weight).withColumn("__mix_prob", prob).withColumn("__mix_sampled", draw < F.col("__mix_prob"))
    return out.drop("__cell_weight", *(f"__cell_{d}" for d in targets))


def mixing(documents: DataFrame) -> DataFrame:
    """One row per document: its cell, tokens, weight, probability and whether it is in the sample."""
    rows = calibrated(documents.select("doc_id", "text", "source", "lang"))
    return rows.select(
        "doc_id", F.col("__mix_source").alias("source"), F.col("__mix_lang").alias("lang"), F.col("__mix_topic").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        F.round("__mix_weight", 6).alias("weight"), F.round("__mix_prob", 6).alias("prob"), F.col("__mix_sampled").alias("sampled"),
    )


def sampled(documents: DataFrame, targets: dict = TARGETS, rate: float = RATE) -> DataFrame:
    """The sampled documents with their own columns."""
    return calibrated(documents, targets, rate).where("__mix_sampled").select(*(F.col(f"`{c}`") for c in documents.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rounds, last = [], "goals"
    for k in range(ROUNDS):
        for d in TARGETS:
            rounds.append(f"w{k}_{d} as materialized (select * replace (weight * goal_{d} / sum(weight) over (partition by {d}) as weight) from {last})")
            last = f"w{k}_{d}"
    margins = ", ".join(f"m_{d} as (select {d}, g * (select sum(tokens) from cells) / sum(g) over () as goal_{d} from (select {d}, power(sum(tokens)::double, {t}) as g from cells group by {d}))" for d, t in TARGETS.items())
    joins = " ".join(f"join m_{d} on cells.{d} is not distinct from m_{d}.{d}" for d in TARGETS)
    same = " and ".join(f"f.{d} is not distinct from c.{d}" for d in TARGETS)
    return rf"""
with t as (select doc_id, source, lang, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
f as (select *, case when n_tokens < 100 then 'short' when 8 * (length(text) - length(replace(text, chr(10), ''))) > n_tokens then 'list' when n_tokens >= 1000 then 'long' else 'prose' end as topic from t),
cells as materialized (select source, lang, topic, sum(n_tokens) as tokens from f where n_tokens > 0 group by all),
{margins},
goals as materialized (select cells.*, {", ".join(f"goal_{d}" for d in TARGETS)}, tokens::double as weight from cells {joins}),
{", ".join(rounds)},
o as (select f.doc_id, f.source, f.lang, f.topic, f.n_tokens, case when f.n_tokens > 0 then c.weight / c.tokens else 0.0 end as w,
    ('0x' || substr(md5(coalesce(f.doc_id::varchar, 'null') || ':{SEED}'), 1, 12))::bigint::double / {float(1 << 48)} as u
    from f left join {last} c on {same})
select doc_id, source, lang, topic, n_tokens, round(w, 6) as weight, round(w / m * {RATE}, 6) as prob, u < w / m * {RATE} as sampled from o, (select coalesce(max(weight / tokens), 1.0) as m from {last})
"""


SQL = _sql()
