"""Inference on counts: intervals, tests, effect sizes, corrections for many tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Two-sided 95 % point of the normal distribution.
Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of a proportion k / n, inside 0..1; NULL where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    base = 1 + z * z / n
    return F.greatest(F.lit(0.0), (centre - half) / base), F.least(F.lit(1.0), (centre + half) / base)


def difference(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of two proportions with its bounds."""
    p1, p2 = k1 / n1.cast("double"), k2 / n2.cast("double")
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return p1 - p2, p1 - p2 - z * se, p1 - p2 + z * se


def odds_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Odds ratio with half a case added to each cell."""
    return ((k1 + 0.5) * (n2 - k2 + 0.5)) / ((n1 - k1 + 0.5) * (k2 + 0.5))


def chi_square(df: DataFrame, by: list[str], level: str, k: str, n: str) -> DataFrame:
    """Pearson's test of yes / no over the levels of one column, per group: statistic, degrees of freedom, effect size, adequacy.

    One grouped pass: with the pooled share p, each level adds (k - np)^2 / (n p (1 - p)).
    """
    w = W.partitionBy(*by)
    p = F.sum(k).over(w) / F.sum(n).over(w).cast("double")
    x = df.withColumn("__p", p)
    e1, e0 = F.col(n) * F.col("__p"), F.col(n) * (1 - F.col("__p"))
    term = F.try_divide(F.pow(F.col(k) - e1, 2), e1) + F.try_divide(F.pow(F.col(k) - e1, 2), e0)
    g = x.groupBy(*by).agg(F.sum(term).alias("statistic"), (F.count("*") - 1).alias("df"), F.sum(n).alias("n"), F.min(F.least(e1, e0)).alias("least_expected"))
    return g.withColumn("cramers_v", F.sqrt(F.try_divide("statistic", F.col("n").cast("double")))).withColumn("adequate", F.col("least_expected") >= 5)


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution by the finite sums for whole degrees of freedom; NULL in, NULL out."""
    return pd.Series([None if pd.isna(x) or pd.isna(k) else _tail(float(x), int(k)) for x, k in zip(statistic, df, strict=True)], dtype="float64")


def _tail(x: float, k: int) -> float:
    if k < 1 or x <= 0:
        return 1.0
    h = x / 2
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (k + 1) // 2):
        total += math.exp(-h) * term
        term *= h / (i + 0.5)
    return total


def adjust(df: DataFrame, family: list[str], p: str, key: list[str]) -> DataFrame:
    """``p_bh`` and ``p_holm`` inside each family; NULL p-values stay NULL and do not count as tests.

    A family is a bounded set of tests, not of rows.
    """
    tested = df.filter(F.col(p).isNotNull())
    m = F.count("*").over(W.partitionBy(*family))
    up, down = W.partitionBy(*family).orderBy(p, *key), W.partitionBy(*family).orderBy(F.desc(p), *[F.desc(k) for k in key])
    t = tested.withColumn("__m", m).withColumn("__r", F.row_number().over(up))
    t = t.withColumn("__bh", F.col(p) * F.col("__m") / F.col("__r")).withColumn("__ho", F.col(p) * (F.col("__m") - F.col("__r") + 1))
    t = t.withColumn("p_bh", F.least(F.lit(1.0), F.min("__bh").over(down.rowsBetween(W.unboundedPreceding, W.currentRow))))
    t = t.withColumn("p_holm", F.least(F.lit(1.0), F.max("__ho").over(up.rowsBetween(W.unboundedPreceding, W.currentRow))))
    none = df.filter(F.col(p).isNull()).withColumn("p_bh", F.lit(None).cast("double")).withColumn("p_holm", F.lit(None).cast("double"))
    return t.drop("__m", "__r", "__bh", "__ho").unionByName(none)


def logit_contrast(k: Column, n: Column, k0: Column, n0: Column) -> tuple[Column, Column]:
    """Log odds of a level against the base level and its standard error; a model saturated in the level has this closed form (V20). NULL with an empty cell."""
    full = (k > 0) & (k < n) & (k0 > 0) & (k0 < n0)
    beta = F.log(k / (n - k)) - F.log(k0 / (n0 - k0))
    se = F.sqrt(1 / k + 1 / (n - k) + 1 / k0 + 1 / (n0 - k0))
    return F.when(full, beta), F.when(full, se)
