"""Ranks, first and last rows, bins and greedy picks in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def mark_duplicates(df: DataFrame, key: Column, id_col: str, order: list[Column], skip: Column) -> DataFrame:
    """``duplicate_of``: the first id with the same key in order; rows where ``skip`` holds are neither duplicates nor originals.

    Rows that are skipped get a partition of their own id, so they pile up nowhere.
    """
    k = F.when(skip, F.concat(F.lit("\u0000"), F.col(id_col).cast("string"))).otherwise(key)
    w = W.partitionBy("__k").orderBy(*order)
    df = df.withColumn("__k", F.sha2(k, 256)).withColumn("__f", F.first(id_col).over(w))
    return df.withColumn("duplicate_of", F.when(~skip & (F.col("__f") != F.col(id_col)), F.col("__f"))).drop("__k", "__f")


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin of a rank 1..n by equal-width quantiles of the ranks, with the edges of linear interpolation (W4): 3 or 4 bins.

    Ranks on an edge belong to the lower bin with 4 bins and to the upper one with 3; one row alone is in bin 0.
    """
    at = (rank - 1) * bins
    last = F.greatest(n - 1, F.lit(1))
    if bins == 4:
        return F.greatest(F.lit(0), F.ceil(at / last) - 1).cast("int")
    if bins == 3:
        return F.least(F.lit(2), F.floor(at / last)).cast("int")
    raise ValueError("bins is 3 or 4")


def ranks(df: DataFrame, by: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """``rank`` (1, 2, ...) and ``size`` of each row inside its group in a total order (W4, W6), without a group in one task.

    Rows are split into ranges of (group, order); ranks inside a range get the rows of the ranges before added, a table of
    groups times ranges.
    """
    x = df.repartitionByRange(parts, *by, *order).withColumn("__p", F.spark_partition_id())
    n = x.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("size", F.sum("__n").over(W.partitionBy(*by))).drop("__n")
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*by, "__p")]
    j = x.withColumn("__r", F.row_number().over(W.partitionBy("__p", *by).orderBy(*order))).alias("x").join(n.alias("n"), keys)
    return j.select("x.*", (F.col("__r") + F.col("n.__b")).alias("rank"), "n.size").drop("__p", "__r")


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in a total order, with ``rank`` (W7). Spark stops early inside partitions (window group limit)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a result in a total order (W11): a bounded top-k, then its tail."""
    first = (number - 1) * size
    return df.orderBy(*order).offset(first).limit(size)


def greedy_representatives(df: DataFrame, by: list[str], document: str, text: str, norm: Column, limit: int = 5) -> DataFrame:
    """Longest text first; a row whose document or normalised text was already chosen is skipped; at most ``limit`` per group.

    The fold is sequential, so its input is cut to what can matter, exactly. A row is reached only after its document's
    better rows failed on chosen texts, of which there are fewer than ``limit``: the limit-th row of a document (and
    likewise of a text) is the last that can be chosen. Among rows cut that way a choice excludes at most 2 * limit others,
    so the first limit * (2 * limit + 1) rows of a group hold all choices.
    """
    d = df.select(*by, document, text, norm.alias("__n"), (-F.length(text)).alias("__len")).filter(F.length(text) > 0)
    d = d.groupBy(*by, document, "__n").agg(F.min(F.struct("__len", text)).alias("x")).select(*by, document, "__n", "x.__len", f"x.{text}")
    order = ["__len", F.col(document).cast("string"), "__n"]
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(*by, document).orderBy(*order))).filter(F.col("__r") <= limit)
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__n").orderBy(*order))).filter(F.col("__r") <= limit)
    d = d.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= limit * (2 * limit + 1))
    s = F.struct(F.col("__len"), F.col(document).cast("string").alias("d"), F.col("__n"), F.col(text).alias("t"))
    empty = F.array().cast("array<struct<__len:int,d:string,__n:string,t:string>>")
    step = lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda y: (y["d"] == x["d"]) | (y["__n"] == x["__n"])), acc).otherwise(F.concat(acc, F.array(x)))
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list(s)).alias("o")).withColumn("chosen", F.aggregate("o", empty, step))
    g = g.select(*by, F.posexplode("chosen").alias("position", "c"))
    return g.select(*by, (F.col("position") + 1).alias("position"), F.col("c.d").alias(document), F.col("c.t").alias(text))
