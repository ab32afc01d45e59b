"""Means and spread of an array<double> column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(nums: Column, of=lambda x: x) -> Column:
    return F.aggregate(nums, F.lit(0.0), lambda a, x: a + of(x))


def _nan(c: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(float("nan"))).otherwise(c)


def amean(nums: Column) -> Column:
    return _sum(nums) / F.size(nums)


def gmean(nums: Column) -> Column:
    return F.pow(F.aggregate(nums, F.lit(1.0), lambda a, x: a * x), 1.0 / F.size(nums))


def hmean(nums: Column) -> Column:
    """Equal values give that value; one zero gives 0, more give NaN."""
    zeros = F.size(F.filter(nums, lambda x: x == 0))
    safe = F.size(nums) / F.nullif(_sum(nums, lambda x: F.when(x == 0, 0.0).otherwise(1 / F.nullif(x, F.lit(0.0)))), F.lit(0.0))
    return F.when(F.array_max(nums) == F.array_min(nums), nums[0]).when(zeros > 1, F.lit(float("nan"))).when(zeros == 1, 0.0).otherwise(safe)


def qmean(nums: Column) -> Column:
    return F.sqrt(_sum(nums, lambda x: x * x) / F.size(nums))


def cmean(nums: Column) -> Column:
    return _sum(nums, lambda x: x * x) / _sum(nums)


def lehmer_mean(nums: Column, exp: float = 2.0) -> Column:
    return _sum(nums, lambda x: F.pow(x, F.lit(exp))) / _sum(nums, lambda x: F.pow(x, F.lit(exp - 1)))


def hoelder_mean(nums: Column, exp: float = 2.0) -> Column:
    return gmean(nums) if exp == 0 else F.pow(_sum(nums, lambda x: F.pow(x, F.lit(exp))) / F.size(nums), F.lit(1 / exp))


def heronian_mean(nums: Column) -> Column:
    n = F.size(nums)
    rows = F.transform(nums, lambda x, i: _sum(F.slice(nums, i + 1, n), lambda y: F.sqrt(x * y)))
    return 2 * _sum(rows) / (n * (n + 1))


def lmean(nums: Column) -> Column:
    """Logarithmic mean of two values."""
    x, y = nums[0], nums[1]
    return F.when(x == y, x).otherwise((y - x) / F.nullif(F.ln(y / x), F.lit(0.0)))


def imean(nums: Column) -> Column:
    """Identric mean of one or two values; NaN unless positive."""
    x, y = nums[0], F.when(F.size(nums) > 1, F.get(nums, F.lit(1))).otherwise(nums[0])
    safe = F.exp((x * F.ln(x) - y * F.ln(y)) / F.nullif(x - y, F.lit(0.0)) - 1)
    return F.when((x <= 0) | (y <= 0), F.lit(float("nan"))).when(x == y, x).otherwise(safe)


def seiffert_mean(nums: Column) -> Column:
    x, y = nums[0], nums[1]
    return _nan((x - y) / F.nullif(2 * F.asin((x - y) / F.nullif(x + y, F.lit(0.0))), F.lit(0.0)), (x == y) | (x + y == 0))


def midrange(nums: Column) -> Column:
    return (F.array_max(nums) + F.array_min(nums)) / 2


def median(nums: Column) -> Column:
    s, n = F.array_sort(nums), F.size(nums)
    return F.when(n % 2 == 1, F.get(s, F.floor(n / 2).cast("int"))).otherwise((F.get(s, F.floor(n / 2).cast("int") - 1) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mode(nums: Column) -> Column:
    """The commonest value, the first seen of those."""
    found = F.transform(F.array_distinct(nums), lambda t: F.struct(F.size(F.filter(nums, lambda v: v == t)).alias("n"), (-F.array_position(nums, t)).alias("at"), t.alias("v")))
    return F.array_max(found)["v"]


def var(nums: Column, mean=amean, ddof: int = 0) -> Column:
    return F.transform(F.array(mean(nums)), lambda m: _sum(nums, lambda x: (x - m) * (x - m)) / (F.size(nums) - ddof))[0]


def std(nums: Column, mean=amean, ddof: int = 0) -> Column:
    return F.sqrt(var(nums, mean, ddof))


def _until_equal(step, digits: int = 12):
    def one(nums) -> float:
        a = list(map(float, nums))
        state = step(a, None)
        for _ in range(10_000):
            if any(math.isnan(x) for x in state) or any(round(x, digits) == round(y, digits) for x, y in zip(state, state[1:])):
                return state[0]
            state = step(None, state)
        return state[0]

    def batch(nums: pd.Series) -> pd.Series:
        return nums.map(lambda x: None if x is None else one(x))

    return F.pandas_udf(batch, "double")


def _am(x):
    return sum(x) / len(x)


def _gm(x):
    return math.prod(x) ** (1 / len(x)) if math.prod(x) >= 0 else math.nan


def _hm(x):
    return 0.0 if 0 in x else len(x) / sum(1 / y for y in x)


#: Means that iterate until two means agree to 12 digits; Arrow-vectorised.
def agmean():
    return _until_equal(lambda a, s: (_am(a or s), _gm(a or s)))


def ghmean():
    return _until_equal(lambda a, s: (_gm(a or s), _hm(a or s)))


def aghmean():
    return _until_equal(lambda a, s: (_am(a or s), _gm(a or s), _hm(a or s)))
