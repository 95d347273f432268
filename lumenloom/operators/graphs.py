"""Merge pointers: every node points to one other node or to none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(edges: DataFrame, id_col: str, target: str, longest: int = 1 << 20) -> DataFrame:
    """(id, root, steps, cycle, missing): where each chain of pointers ends (U4).

    Pointers are doubled: after k joins a node knows its ancestor 2^k steps up, so the plan has a logarithmic number of
    joins, and a chain that has not ended after all of them is a cycle. ``missing`` is a target that is no node.
    """
    spark = edges.sparkSession
    base = edges.select(F.col(id_col).alias("id"), F.col(target).alias("up"))
    cur = base.select("id", F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("steps"))
    k = 1
    while k < longest:
        nxt = cur.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"))
        cur = cur.join(nxt, "at", "left").select("id", F.coalesce("at2", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        cur = _cut(cur)
        k *= 2
        ended = cur.join(base.filter(F.col("up").isNotNull()).select(F.col("id").alias("at")), "at", "left_semi").limit(1).count() == 0
        if ended:
            break
        if k >= base.count():
            break
    tail = base.select(F.col("id").alias("at"), F.col("up").alias("beyond"), F.lit(True).alias("known"))
    out = cur.join(tail, "at", "left")
    return out.select("id", F.col("at").alias("root"), "steps", F.col("beyond").isNotNull().alias("cycle"), F.col("known").isNull().alias("missing"))


def _cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared checkpoint folder where the session names one."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and folder:
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df
