"""Problem 7: filling containers of fixed capacity with items that are not split.

The driver works on the histogram of lengths only. A configuration linear
program (which multisets of lengths fill a container, how often to use each)
is solved by multiplicative weights; prices of lengths are updated by how far
they are covered, and the best configuration under the present prices comes
from an unbounded knapsack by dynamic programming. Rounding down leaves a
remainder that best fit packs. The plan says which ranks of each length go
into which containers; documents get their rank inside their length without
gathering a length in one task, and join the plan.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Length classes of the linear program; lengths inside a class count as its longest one while pricing.
CLASSES = 160
ROUNDS = 240
#: A public vocabulary, sent to every executor by ``share``; texts are read whole.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Rows of one length that one task ranks; a length with more is ranked in parts.
RANKED = 1_000_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the published split pattern of this vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def share(spark: SparkSession, tokenizer: str = TOKENIZER) -> None:
    """Send the vocabulary's file to the executors, once for a session."""
    sc = spark.sparkContext
    if not getattr(sc, "_lumenloom_vocabulary", None) == tokenizer:
        sc.addFile(tokenizer)
        sc._lumenloom_vocabulary = tokenizer


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text under a public vocabulary; 0 for NULL and ''. The file is the one that ``share`` has sent, else that of its own path."""

    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        sent = SparkFiles.get(os.path.basename(tokenizer))
        enc = _encoding(sent if os.path.exists(sent) else tokenizer)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return udf.asNondeterministic()(text)


def _classes(sizes: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """Class of each length: exact lengths while there are few, else classes that split the total size evenly, large ones exact."""
    if len(sizes) <= most:
        return np.arange(len(sizes))
    weight = np.cumsum(counts * sizes.astype(float))
    by_size = np.minimum((weight / weight[-1] * (most // 2)).astype(int), most // 2 - 1)
    by_log = (np.log(sizes) / np.log(sizes[-1] + 1) * (most // 2)).astype(int)
    key = by_size * most + by_log
    return np.unique(key, return_inverse=True)[1]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int, limit: np.ndarray) -> np.ndarray:
    """Counts of each length in the container of the highest value; never more of a length than there are."""
    # a coarse grid keeps the table small; sizes are rounded up to it, so a container never overflows
    grid = max(1, capacity // 2048)
    s = -(-sizes // grid)
    cap = capacity // grid
    keep = np.argsort(-values / s, kind="stable")
    best = np.zeros(cap + 1)
    copies: list[tuple[int, np.ndarray]] = []
    # lengths of better density first; copies of a length enter one after another, never more than there are
    for i in keep:
        si, vi = int(s[i]), float(values[i])
        if vi <= 0 or si > cap:
            continue
        taken = np.zeros(cap + 1, np.int32)
        for _ in range(min(int(limit[i]), cap // si)):
            cand = best[: cap + 1 - si] + vi
            better = cand > best[si:] + 1e-15
            if not better.any():
                break
            new, more = best.copy(), taken.copy()
            new[si:][better] = cand[better]
            more[si:][better] = taken[: cap + 1 - si][better] + 1
            best, taken = new, more
        if taken.any():
            copies.append((int(i), taken))
    out = np.zeros(len(sizes), np.int64)
    c = int(best.argmax())
    room = capacity
    for i, taken in reversed(copies):
        n = int(taken[c])
        out[i] = n
        room -= n * int(sizes[i])
        c -= n * int(s[i])
    # what rounding left over takes the densest length that still fits
    for i in keep:
        if values[i] > 0 and sizes[i] <= room:
            n = min(room // int(sizes[i]), int(limit[i]) - int(out[i]))
            if n > 0:
                out[i] += n
                room -= n * int(sizes[i])
    return out


def plan(histogram: list[tuple[int, int]], capacity: int, classes: int = CLASSES, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many containers each gets: a list of ({length: count}, containers) that uses every item exactly once.

    Lengths are between 1 and ``capacity``; an empty histogram gives an empty plan.
    """
    have = {s: n for s, n in histogram if n > 0}
    if not have:
        return []
    sizes = np.array(sorted(have))
    counts = np.array([have[int(s)] for s in sizes])
    cls = _classes(sizes, counts, classes)
    k = int(cls.max()) + 1
    top = np.zeros(k, np.int64)
    np.maximum.at(top, cls, sizes)
    demand = np.bincount(cls, counts, k).astype(float)
    limit = np.minimum(demand, capacity // np.maximum(top, 1)).astype(np.int64)
    # multiplicative weights on the covering constraints; sizes are the first prices
    price = top / capacity
    covered = np.zeros(k)
    used: dict[bytes, float] = {}
    found: dict[bytes, np.ndarray] = {}
    lower = float((sizes * counts).sum()) / capacity
    step = max(1.0, lower / rounds)
    eps = 0.35
    for _ in range(rounds):
        conf = _knapsack(top, price, capacity, limit)
        if not conf.any():
            break
        key = conf.tobytes()
        found[key] = conf
        # as often as one length allows, but no more than a step: then its price has to move
        there = conf > 0
        amount = min(step, float((np.maximum(demand - covered, 0)[there] / conf[there]).min()))
        amount = max(amount, step * 0.1)
        used[key] = used.get(key, 0.0) + amount
        covered += amount * conf
        share = covered / demand
        # covered lengths lose their price exponentially, lengths behind the average gain
        price = (top / capacity) * np.exp(-eps * (share - share.min()) * 8)
        price[share >= 1.02] *= 1e-3
        if share.min() >= 1:
            break
    # rounding down, largest use first, within what is there
    left = demand.astype(np.int64)
    members: list[list[int]] = [[] for _ in range(k)]
    for i, c in enumerate(cls):
        members[c].append(i)
    rest = counts.astype(np.int64).copy()
    out: dict[tuple[tuple[int, int], ...], int] = {}

    def take(conf: np.ndarray, times: int) -> None:
        """Use one configuration of classes ``times`` times with real lengths, largest first inside a class."""
        nonlocal out
        while times > 0:
            pick: dict[int, int] = {}
            batch = times
            for c in np.nonzero(conf)[0]:
                need = int(conf[c])
                for i in reversed(members[c]):
                    n = min(need, int(rest[i]))
                    if n:
                        pick[i] = n
                        need -= n
                    if not need:
                        break
                if need:
                    return
            for i, n in pick.items():
                batch = min(batch, int(rest[i]) // n)
            batch = max(1, batch)
            for i, n in pick.items():
                rest[i] -= n * batch
            shape = tuple(sorted((int(sizes[i]), n) for i, n in pick.items()))
            out[shape] = out.get(shape, 0) + batch
            times -= batch

    for key in sorted(used, key=lambda x: (-used[x], x)):
        conf = found[key]
        there = conf > 0
        times = min(int(used[key]), int((left[there] // conf[there]).min()))
        if times > 0:
            take(conf, times)
            left = np.zeros(k, np.int64)
            np.add.at(left, cls, rest)
    # what rounding left: complete containers one configuration at a time by the knapsack on what is there, exact lengths
    while rest.sum() > 0:
        there = np.nonzero(rest)[0]
        if rest.sum() <= 4 * len(there) + 200:
            break
        sub = there if len(there) <= 2 * classes else there[np.linspace(0, len(there) - 1, 2 * classes).astype(int)]
        conf = _knapsack(sizes[sub], sizes[sub].astype(float), capacity, rest[sub])
        if not conf.any():
            break
        times = int((rest[sub][conf > 0] // conf[conf > 0]).min())
        rest[sub] -= conf * times
        shape = tuple(sorted((int(sizes[i]), int(n)) for i, n in zip(sub, conf, strict=True) if n))
        out[shape] = out.get(shape, 0) + times
    for shape, n in _best_fit({int(sizes[i]): int(rest[i]) for i in np.nonzero(rest)[0]}, capacity).items():
        out[shape] = out.get(shape, 0) + n
    return [(dict(shape), n) for shape, n in sorted(out.items())]


def _best_fit(rest: dict[int, int], capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best fit decreasing over what rounding left, equal containers together."""
    import bisect

    room: list[tuple[int, int]] = []  # (room, container), sorted
    inside: list[dict[int, int]] = []
    for size in sorted(rest, reverse=True):
        for _ in range(rest[size]):
            k = bisect.bisect_left(room, (size, -1))
            if k < len(room):
                r, c = room.pop(k)
            else:
                r, c = capacity, len(inside)
                inside.append({})
            inside[c][size] = inside[c].get(size, 0) + 1
            if r > size:
                bisect.insort(room, (r - size, c))
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for x in inside:
        shape = tuple(sorted(x.items()))
        out[shape] = out.get(shape, 0) + 1
    return out


def pieces(items: DataFrame, id_col: str, tokens: str, capacity: int) -> DataFrame:
    """Items as (item_id, piece, size): one piece each, or full pieces and a remainder where an item exceeds the capacity.

    Items without a size or of size 0 need no room and do not appear.
    """
    t = F.col(tokens)
    n = F.ceil(t / F.lit(capacity)).cast("int")
    df = items.filter(t > 0).select(F.col(id_col).alias("item_id"), t.alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return df.select("item_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("t") - F.col("piece").cast("bigint") * capacity).alias("size"))


def fill(items: DataFrame, id_col: str, tokens: str, capacity: int, ranked: int = RANKED) -> DataFrame:
    """(container_id, item_id, piece, size) for every piece; no container holds more than ``capacity``.

    ``items`` has unique ids and integer sizes. A whole item is never split unless it is larger than a container. No task
    ranks more than about ``ranked`` rows: full pieces of long items, all of one length, are ranked in as many parts as they need.
    """
    spark = items.sparkSession
    parts = pieces(items, id_col, tokens, capacity)
    histogram = [(int(r["size"]), int(r["n"])) for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()]  # at most capacity rows
    many = {s: 1 + n // ranked for s, n in histogram if n >= ranked}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("size").cast("int")), F.lit(1)) if many else F.lit(1)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("item_id", "piece"), salts.cast("bigint")))
    counted = parts.groupBy("size", "salt").agg(F.count("*").alias("n"))
    # ranks: each salt of a length owns a range
    before = W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    off = counted.select("size", "salt", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    shapes = plan(histogram, capacity)
    ranges, used, base = [], {}, 0
    for shape, times in shapes:
        for s, n in shape.items():
            lo = used.get(s, 0)
            ranges.append((s, lo, lo + n * times, base, n))
            used[s] = lo + n * times
        base += times
    table = spark.createDataFrame(pd.DataFrame(ranges or [], columns=["size", "lo", "hi", "base", "per"]).astype("int64"), "size bigint, lo bigint, hi bigint, base bigint, per bigint")
    w = W.partitionBy("size", "salt").orderBy("item_id", "piece")
    with_rank = parts.withColumn("rn", F.row_number().over(w) - 1)
    # the first table is as long as lengths and millions of rows, the second as configurations times lengths: bounded by the capacity
    placed = with_rank.join(F.broadcast(off), ["size", "salt"]).withColumn("rank", F.col("rn") + F.col("offset"))
    r = table.withColumnRenamed("size", "r_size")
    placed = placed.join(F.broadcast(r), (F.col("size") == F.col("r_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("base") + F.expr("(rank - lo) div per")
    return placed.select(container.alias("container_id"), "item_id", "piece", "size")
