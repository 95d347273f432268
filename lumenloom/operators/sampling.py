"""Samples by the order of a keyed hash: the same rows on every cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def draw(seed: str, id_col: str) -> Column:
    """Order of a draw: the SHA-256 of seed and id."""
    return F.sha2(F.concat(F.lit(seed + "|"), F.col(id_col).cast("string")), 256)


def uniform(seed: str, id_col: str) -> Column:
    """A number in (0, 1) from the first 12 hex digits of the draw."""
    return (F.conv(F.substring(draw(seed, id_col), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def proportional(strata: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """Allocation of ``total`` over strata by size, largest remainder first, ties by name (P2). A stratum gets no more than it has when total <= all."""
    w = W.partitionBy()  # one row per stratum
    share = F.col(size).cast("double") * total / F.sum(size).over(w)
    s = strata.withColumn("__f", F.floor(share + 1e-9).cast("bigint")).withColumn("__r", share - F.col("__f"))
    s = s.withColumn("__left", F.lit(total) - F.sum("__f").over(w)).withColumn("__k", F.row_number().over(W.partitionBy().orderBy(F.desc(F.round("__r", 9)), name)))
    return s.withColumn("quota", F.col("__f") + (F.col("__k") <= F.col("__left")).cast("bigint")).drop("__f", "__r", "__left", "__k")


def stratified(df: DataFrame, stratum: Column, id_col: str, quotas: DataFrame, seed: str) -> DataFrame:
    """The first ``quota`` rows of each stratum in draw order; ``quotas`` is small: (stratum, quota).

    The rank is cut inside each task before the shuffle of a stratum (window group limit).
    """
    x = df.withColumn("stratum", stratum).join(F.broadcast(quotas), "stratum").withColumn("__d", draw(seed, id_col))
    most = F.row_number().over(W.partitionBy("stratum").orderBy("__d", id_col))
    return x.withColumn("position", most.cast("bigint")).filter(F.col("position") <= F.col("quota")).drop("__d", "quota")


def weighted(df: DataFrame, weight: Column, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows with chances by weight, without replacement: smallest exponential clock first (P6). A distributed top-k."""
    clock = -F.log(uniform(seed, id_col)) / F.nullif(weight.cast("double"), F.lit(0.0))
    return df.withColumn("__c", clock).filter(F.col("__c").isNotNull()).orderBy("__c", id_col).limit(n).drop("__c")


def blind(df: DataFrame, allowed: list[str], hidden: tuple[str, ...] = ("model", "predicted", "confidence")) -> DataFrame:
    """Only the allowed columns; names that would tell a reviewer the answer are refused (P10)."""
    bad = [c for c in allowed if any(h in c.lower() for h in hidden)]
    if bad:
        raise ValueError(f"columns {bad} would give the answer away")
    return df.select(*allowed)


def coverage_sample(df: DataFrame, id_col: str, group: str, values: list[str], n: int, per_group: int = 2) -> list:
    """Greedy cover: each pick adds the most values not seen yet, the largest id first among equals, at most ``per_group`` rows of a group.

    Exact: rows with the same combination of values differ for the greedy only by id and group. Of one combination and
    group no more than ``per_group`` rows can be taken, and no more than n rows can be skipped because their group is full,
    so the first 2n rows of each combination hold all picks. ``values`` are columns with few combinations of values.
    """
    last = F.desc(F.col(id_col).cast("string"))
    key = [F.coalesce(F.col(v).cast("string"), F.lit("\u0000")) for v in values]
    r = df.withColumn("__r", F.row_number().over(W.partitionBy(*key, F.col(group)).orderBy(last))).filter(F.col("__r") <= per_group)
    r = r.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(last))).filter(F.col("__r") <= 2 * n).drop("__r")
    rows = [x.asDict() for x in r.select(id_col, group, *values).collect()]
    seen: set[tuple[str, object]] = set()
    used: dict[object, int] = {}
    out = []
    while rows and len(out) < n:
        best = max(rows, key=lambda r: (sum((v, r[v]) not in seen for v in values), str(r[id_col])))
        rows.remove(best)
        if used.get(best[group], 0) >= per_group:
            continue
        used[best[group]] = used.get(best[group], 0) + 1
        seen.update((v, best[v]) for v in values)
        out.append(best)
    return out
