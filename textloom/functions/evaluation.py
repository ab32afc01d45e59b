"""Match quality from counts of true and false positives and negatives, as SQL expressions of tp, tn, fp, fn.

Ratios without a denominator are NaN. The precision/recall means and information measures follow from the same four counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import means


def _over(num: str, den: str) -> str:
    return f"(case when ({den}) = 0 then cast('NaN' as double) else ({num})/nullif({den}, 0e0) end)"


POP, CP, CN, PP, PN = "(tp + tn + fp + fn)", "(tp + fn)", "(fp + tn)", "(tp + fp)", "(tn + fn)"
P, R, S, NPV = _over("tp", PP), _over("tp", CP), _over("tn", CN), _over("tn", PN)
MCC = _over("tp*tn - fp*fn", f"sqrt({PP}*{CP}*{CN}*{PN})")


def _fbeta(beta: str) -> str:
    return _over(f"(1 + {beta}*{beta})*{P}*{R}", f"{beta}*{beta}*{P} + {R}")


def _entropy(*cells: str) -> str:
    return f"(ln({POP}) - (" + " + ".join(f"{x}*ln(nullif({x}, 0e0))" for x in cells) + f")/{POP})"


ACCURACY = _over("tp + tn", POP)
RANDOM = f"({PP}*{CP} + {PN}*{CN})/({POP}*{POP})"
MI = "((" + " + ".join(f"{x}*ln(nullif({POP}*{x}/nullif({m}, 0e0), 0e0))" for x, m in (("tp", f"({CP}*{PP})"), ("fp", f"({CN}*{PP})"), ("fn", f"({CP}*{PN})"), ("tn", f"({CN}*{PN})"))) + f")/{POP})"
METRICS: dict[str, str] = {
    "correct_pop": "tp + tn", "error_pop": "fp + fn", "pred_pos_pop": PP, "pred_neg_pop": PN, "cond_pos_pop": CP, "cond_neg_pop": CN, "population": POP,
    "precision": P, "precision_gain": _over(P, f"{CP}/{POP}"), "recall": R, "specificity": S, "fnr": f"1 - {R}", "npv": NPV, "false_omission_rate": _over("fn", PN), "fallout": f"1 - {S}",
    "pos_likelihood_ratio": _over(R, f"1 - {S}"), "neg_likelihood_ratio": _over(f"1 - {R}", S), "diagnostic_odds_ratio": _over("tp*tn", "fp*fn"), "fdr": _over("fp", PP),
    "accuracy": ACCURACY, "accuracy_gain": _over(ACCURACY, f"power({CP}/{POP}, 2) + power({CN}/{POP}, 2)"), "balanced_accuracy": f"({R} + {S})/2", "error_rate": _over("fp + fn", POP), "prevalence": _over(CP, POP),
    "informedness": f"{R} + {S} - 1", "markedness": f"{P} + {NPV} - 1",
    "pr_amean": f"({P} + {R})/2", "pr_gmean": f"sqrt({P}*{R})", "pr_hmean": _over(f"2*{P}*{R}", f"{P} + {R}"), "pr_qmean": f"sqrt(({P}*{P} + {R}*{R})/2)", "pr_cmean": _over(f"{P}*{P} + {R}*{R}", f"{P} + {R}"),
    "pr_lmean": f"(case when {P} = 0 or {R} = 0 then 0e0 when {P} = {R} then {P} else ({P} - {R})/nullif(ln({P}/nullif({R}, 0e0)), 0e0) end)",
    "pr_imean": f"(case when {P} = {R} then {P} else exp((({P}*ln(nullif({P}, 0e0)) - {R}*ln(nullif({R}, 0e0)))/nullif({P} - {R}, 0e0)) - 1) end)",
    "pr_seiffert_mean": _over(f"{P} - {R}", f"2*asin(({P} - {R})/({P} + {R}))"),
    "pr_lehmer_mean": _over(f"{P}*{P} + {R}*{R}", f"{P} + {R}"), "pr_heronian_mean": f"({P} + sqrt({P}*{R}) + {R})/3", "pr_hoelder_mean": f"sqrt(({P}*{P} + {R}*{R})/2)",
    "f1_score": _fbeta("1e0"), "f2_score": _fbeta("2e0"), "fhalf_score": _fbeta("0.5e0"), "e_score": f"1 - {_fbeta('1e0')}",
    "jaccard": _over("tp", "tp + fp + fn"), "d_measure": f"1 - {_over('1e0', f'{_over("1e0", P)} + {_over("1e0", R)} - 1')}",
    "mcc": MCC, "phi_coefficient": MCC, "significance": _over(f"power(tp*tn - fp*fn, 2)*{POP}", f"{PP}*{CP}*{CN}*{PN}"), "kappa_statistic": _over(f"{ACCURACY} - {RANDOM}", f"1 - {RANDOM}"),
    "joint_entropy": _entropy("tp", "tn", "fp", "fn"), "actual_entropy": _entropy(CP, CN), "predicted_entropy": _entropy(PP, PN), "mutual_information": MI,
    "proficiency": f"{MI}/nullif({_entropy(CP, CN)}, 0e0)", "igr": f"{MI}/nullif({_entropy(PP, PN)}, 0e0)", "dependency": f"{MI}/nullif({_entropy('tp', 'tn', 'fp', 'fn')}, 0e0)", "lift": _over(f"tp*{POP}", f"{PP}*{CP}"),
}


def fbeta_score(beta: float = 1.0) -> Column:
    """F-beta over the columns tp, tn, fp and fn."""
    if beta <= 0:
        raise ValueError("beta must be above 0")
    return F.expr(_fbeta(f"cast({float(beta)!r} as double)"))


def pr_mean(kind: str) -> Column:
    """Iterated mean of precision and recall: agmean, ghmean or aghmean."""
    return getattr(means, kind)()(F.array(F.expr(P).cast("double"), F.expr(R).cast("double")))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (tp, tn, fp, fn) of two 0/1 columns; rows with a null do not count."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.agg(*(F.count_if(x).cast("double").alias(n) for n, x in (("tp", t & p), ("tn", ~t & ~p), ("fp", ~t & p), ("fn", t & ~p))))


def with_metrics(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    return counts.select("*", *(F.round(F.expr(METRICS[n]).cast("double"), 9).alias(n) for n in names or METRICS))


def query(spark, sf_dir: str) -> DataFrame:
    """All metrics of quality as a prediction of non-toxic labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("clean", 1 - F.col("toxic"))
    return with_metrics(confusion(labels, "clean", "quality"))


SQL = (
    "with c as (select count(*) filter (toxic = 0 and quality = 1)::double as tp, count(*) filter (toxic <> 0 and quality <> 1)::double as tn, count(*) filter (toxic <> 0 and quality = 1)::double as fp, count(*) filter (toxic = 0 and quality <> 1)::double as fn from labels) select *, "
    + ", ".join(f"round(({x})::double, 9) as {n}" for n, x in METRICS.items())
    + " from c"
)
