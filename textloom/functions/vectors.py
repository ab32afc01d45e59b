"""Measures over the counts of a pair's tokens, as SQL expressions with sums over the union of the tokens.

`SUM[e]` is the sum of e over the tokens, x and y being a token's counts in src and tar; p and q are the
numbers of tokens, u the tokens, n the alphabet's total. One text serves Spark (aggregate) and DuckDB (list_sum).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import measures
from .measures import both, same

XX, YY, XY = "SUM[x*x]", "SUM[y*y]", "SUM[x*y]"
#: Expressions of the similarity.
SIM: dict[str, str] = {
    "bhattacharyya": both("1 - SUM[sqrt(x*y)]/sqrt(p*q)").replace("then 0e0", "then 1e0"),
    "brainerd_robinson": "1 - SUM[abs(x/greatest(p, 1e0) - y/greatest(q, 1e0))]/2",
    "chord": f"1 - round(sqrt(SUM[power(x/greatest(sqrt({XX}), 1e0) - y/greatest(sqrt({YY}), 1e0), 2)])/sqrt(2e0), 15)",
    "clark": same("1 - sqrt(SUM[power((x - y)/nullif(x + y, 0e0), 2)]/LEN)"),
    "euclidean": same(f"1 - sqrt(SUM[power(x - y, 2)])/nullif(sqrt(SUM[power(x + y, 2)]), 0e0)"),
    "fidelity": both("power(SUM[sqrt(x*y)], 2)/(p*q)"),
    "hassanat": same("1 - SUM[1 - (1 + least(x, y))/(1 + greatest(x, y))]/LEN"),
    "hellinger": same("1 - sqrt(2*SUM[power(sqrt(x) - sqrt(y), 2)])/sqrt(2*SUM[power(greatest(x, y), 2)])"),
    "horn_morisita": both(f"2*{XY}/(p*q*({XX}/(p*p) + {YY}/(q*q)))"),
    "jensen_shannon": same(both("-0.5e0/ln(2e0)*SUM[case when x > 0 and y > 0 then (x/p)*ln(x/p) + (y/q)*ln(y/q) - (x/p + y/q)*ln(x/p + y/q) else 0e0 end]")),
    "lorentzian": same("1 - SUM[ln(1 + abs(x - y))]/nullif(SUM[ln(1 + greatest(x, y))], 0e0)"),
    "manhattan": same("1 - SUM[abs(x - y)]/nullif(SUM[x + y], 0e0)"),
    "matusita": same(both("1 - round(sqrt(SUM[power(sqrt(x/p) - sqrt(y/q), 2)])/sqrt(2e0), 15)")),
    "minkowski": same("1 - SUM[abs(x - y)]/nullif(SUM[x + y], 0e0)"),
    "quantitative_cosine": same(both(f"{XY}/(sqrt({XX})*sqrt({YY}))")),
    "quantitative_dice": same(f"2*{XY}/nullif({XX} + {YY}, 0e0)"),
    "quantitative_jaccard": same(f"{XY}/nullif({XX} + {YY} - {XY}, 0e0)"),
    "roberts": same("SUM[(x + y)*least(x, y)/nullif(greatest(x, y), 0e0)]/nullif(SUM[x + y], 0e0)"),
    "shape": same("1 - (SUM[power(x - y, 2)]/n - power(SUM[abs(x - y)]/n, 2))"),
    "whittaker": "round(1 - SUM[abs(x/greatest(p, 1e0) - y/greatest(q, 1e0))]/2, 14)",
}
#: Scores of measures that have no similarity between 0 and 1.
SCORE: dict[str, str] = {
    "millar": "greatest(0e0, SUM[((case when x > 0 then x*ln(x/nullif(x + y, 0e0)) else 0e0 end) + (case when y > 0 then y*ln(y/nullif(x + y, 0e0)) else 0e0 end) + (x + y)*ln(2e0))/nullif(x + y, 0e0)])",
    "morisita": both("2*SUM[x*y]/nullif(p*q*(SUM[x*(x - 1)]/nullif(p*(p - 1), 0e0) + SUM[y*(y - 1)]/nullif(q*(q - 1), 0e0)), 0e0)"),
}
NAMES = sorted({*SIM, *SCORE})


def _sums(text: str, form: str) -> str:
    """Replaces SUM[e], innermost last: sums inside a sum are of the pair, not of the token."""
    while (at := text.find("SUM[")) >= 0:
        end, depth = at + 4, 1
        while depth:
            depth += {"[": 1, "]": -1}.get(text[end], 0)
            end += 1
        inner, held = text[at + 4 : end - 1], []
        while (m := re.search(r"SUM\[[^\[\]]*\]", inner)) :
            held.append(_sums(m[0], form))
            inner = inner.replace(m[0], f"@{len(held) - 1}@", 1)
        inner = re.sub(r"\b([xy])\b", r"t.\1", inner)
        for k, x in enumerate(held):
            inner = inner.replace(f"@{k}@", x.replace("t.", "t2.").replace("t ->", "t2 ->").replace("acc, t)", "acc, t2)").replace("lambda t:", "lambda t2:"))
        text = text[:at] + form.format(inner) + text[end:]
    return text


def spark_sql(name: str) -> str:
    return _sums((SIM | SCORE)[name], "aggregate(vec, 0D, (acc, t) -> acc + {})").replace("LEN", "size(vec)")


def duckdb_sql(name: str) -> str:
    return _sums((SIM | SCORE)[name], "coalesce(list_sum(list_transform(vec, lambda t: {})), 0e0)").replace("LEN", "len(vec)")


def measure(pairs: DataFrame, name: str, src: str = "src", tar: str = "tar") -> DataFrame:
    """Adds `sim`, the named similarity (or score) of two string columns."""
    df = measures.with_cells(pairs, src, tar)
    count = lambda side, t: F.size(F.filter(F.col(side), lambda v: v == t)).cast("double")
    df = df.withColumn("vec", F.transform("u", lambda t: F.struct(count("x", t).alias("x"), count("y", t).alias("y"))))
    return df.drop("x", "y").withColumn("sim", F.expr(spark_sql(name)))


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return measure(measures.pairs_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet")), name).select("id", "src", "tar", F.round("sim", 9).alias("sim"))

    return run


def sql(name: str) -> str:
    vec = "list_transform(u, lambda k: {'x': len(list_filter(x, lambda i: i = k))::double, 'y': len(list_filter(y, lambda i: i = k))::double})"
    return f"with {measures.PAIRS_SQL}, {measures.cells_sql()}, vecs as (select * exclude (x, y), {vec} as vec from cells) select id, src, tar, round({duckdb_sql(name)}, 9) as sim from vecs"
