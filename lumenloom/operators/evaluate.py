"""Gold against prediction: metrics, agreement, matching, grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators.cube import ratio


def binary_metrics(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where undefined (V1)."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * tp, 2 * tp + fp + fn)


def per_class(df: DataFrame, gold: str, predicted: str, labels: DataFrame) -> DataFrame:
    """Support and metrics of each label in one pass: every row counts for its gold and for its predicted label (V1)."""
    both = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col(gold) == F.col(predicted)).alias("hit"))
    g = both.groupBy("x.label").agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("x.g")).otherwise(0)).alias("tp"))
    j = labels.join(g, "label", "left").fillna(0, ["support", "predicted", "tp"])
    p, r, f = binary_metrics(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp"))
    return j.select("label", "support", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: DataFrame) -> DataFrame:
    """Dense confusion counts over a label list (V2)."""
    grid = labels.withColumnRenamed("label", "gold").crossJoin(F.broadcast(labels.withColumnRenamed("label", "predicted")))
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Pairs, observed and chance agreement, kappa and the prevalence-adjusted form; kappa is NULL where chance is certain (V3).

    The marginals come from one grouped table of label pairs, not from the rows again.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    x = cells.withColumn("t", F.sum("n").over(w))
    pa = x.groupBy(*by, F.col("a").alias("l")).agg(F.sum("n").alias("na"), F.max("t").alias("t"))
    pb = x.groupBy(*by, F.col("b").alias("l")).agg(F.sum("n").alias("nb"))
    pe = pa.join(pb, [*by, "l"], "left").groupBy(*by).agg((F.sum(F.col("na") * F.coalesce("nb", F.lit(0))) / F.pow(F.max("t").cast("double"), 2)).alias("chance"))
    po = x.groupBy(*by).agg(F.max("t").alias("pairs"), ratio(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.max("t")).alias("agreement"))
    j = po.join(pe, by) if by else po.crossJoin(pe)
    return j.select(*by, "pairs", "agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"), (2 * F.col("agreement") - 1).alias("pabak"))


def match_counts(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset intersection on keys: gold, predicted and matched counts per key."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("gold"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("predicted"))
    return g.join(p, keys, "full").fillna(0, ["gold", "predicted"]).withColumn("matched", F.least("gold", "predicted"))


def match_ordinal(gold: DataFrame, predicted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th gold row of a key with its k-th predicted row (J11); all columns of the right side get the prefix 'p_'."""
    w = W.partitionBy(*keys).orderBy(order)
    g = gold.withColumn("k", F.row_number().over(w))
    p = predicted.withColumn("k", F.row_number().over(w))
    p = p.select(*keys, "k", *[F.col(c).alias(f"p_{c}") for c in p.columns if c not in (*keys, "k")])
    return g.join(p, [*keys, "k"], "full")


def threshold_grid(df: DataFrame, score: Column, gold: Column, low: list[float], high: list[float]) -> DataFrame:
    """Counts of each pair of thresholds (include from ``high``, exclude below ``low``), all pairs in one pass (V8).

    Each row becomes one row per pair of a small literal grid and is summed before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a in low for b in high if a < b])
    x = df.select(score.alias("s"), gold.alias("g"), F.explode(pairs).alias("t"))
    inc, exc = F.col("s") >= F.col("t.high"), F.col("s") < F.col("t.low")
    return x.groupBy("t.low", "t.high").agg(F.count_if(inc & F.col("g")).alias("tp"), F.count_if(inc & ~F.col("g")).alias("fp"), F.count_if(exc & F.col("g")).alias("fn"), F.count_if(exc & ~F.col("g")).alias("tn"), F.count_if(~inc & ~exc).alias("review"))


def _poisson_cuts(bits: int = 40) -> list[float]:
    """Cumulative chances of 0, 1, 2, ... of a Poisson number with mean 1, as far as a hash of so many bits can tell."""
    cuts, term, total = [], math.exp(-1), 0.0
    while 1 - total > 2.0**-bits:
        total += term
        cuts.append(total)
        term /= len(cuts)
    return cuts


def bootstrap(df: DataFrame, value: Column, id_col: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Mean with its percentile interval from Poisson weights drawn by hash (V6).

    Rows are expanded over replicates inside their task and summed there, so the shuffle has one row per task and replicate.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("replicate")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    x = df.select(value.cast("double").alias("v"), id_col, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    weight = sum((F.when(F.col("u") > c, 1).otherwise(0) for c in _poisson_cuts()), F.lit(0))
    m = x.withColumn("u", u).withColumn("w", weight).groupBy("replicate").agg(ratio(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
