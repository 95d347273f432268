"""Descriptive cubes: dense grids, explicit denominators, bands.

A cube is one grouped aggregate joined to a small grid of all combinations of
its dimensions, so empty cells appear as zeros. Denominators are named and
never mixed: documents, documents with mentions, mentions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "negative", "neutral", "mixed")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as a double; ``empty`` where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def dimension(spark: SparkSession, name: str, values) -> DataFrame:
    """A fixed list of values as a one-column table."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def dense_grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimension tables: only dimensions, never rows of data, are crossed."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)


def densify(grid: DataFrame, cells: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """The grid with the cells' measures, 0 where a combination has none."""
    j = grid.join(cells, keys, "left")
    return j.select(*keys, *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in zero], *[c for c in cells.columns if c not in keys and c not in zero])


def support_band(n: Column) -> Column:
    """Band of a number of affected documents (F16)."""
    return F.when(n < 30, "very_low").when(n < 100, "low").when(n < 500, "moderate").otherwise("high")


def effect_band(v: Column) -> Column:
    """Band of an effect size (F16)."""
    return F.when(v.isNull(), None).when(v < 0.1, "negligible").when(v < 0.2, "small").when(v < 0.3, "moderate").otherwise("large")


def roll_up(parts: DataFrame, parent: str, child_keys: list[str], label: str) -> DataFrame:
    """Parts to their parent: the single label they share, else 'mixed' (A11)."""
    g = parts.groupBy(parent, *child_keys).agg(F.count("*").alias("mentions"), F.countDistinct(label).alias("__n"), F.min(label).alias("__l"))
    return g.select(parent, *child_keys, "mentions", F.when(F.col("__n") == 1, F.col("__l")).otherwise("mixed").alias(label))


def unpivot_dimensions(df: DataFrame, dims: list[str], *measures: Column) -> DataFrame:
    """One grouped pass over many dimensions in long form (V5): each row once per dimension, partial sums before the shuffle."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("__d"))
    return long.groupBy(F.col("__d.dimension").alias("dimension"), F.col("__d.value").alias("value")).agg(*measures)
