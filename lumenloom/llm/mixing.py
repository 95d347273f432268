"""Problem 8: mixing sources to target weights.

Each source of a mix owes a share of the mix' size. Whole copies of every
document are given out first; the rest is a fixed-size sample with unequal
probabilities by Pareto order sampling: documents are ranked by the odds of a
random number over the odds of their inclusion probability, and the lowest
ranks are taken until the source's size is reached. The cut is found on
histograms of the ranking variable, level by level, so no source is ever
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the ranking variable at each level, and levels: a bin of the last level holds next to nothing.
BINS, LEVELS = 2_048, 3
SEED = "mix-1"


def allocate(targets: list[dict], sizes: dict[str, int], size: int | None = None) -> list[dict]:
    """Size owed by each source. Without ``size`` the mix is as large as the scarcest source with documents allows, at most as large as its sources are together.

    With ``size`` every source owes its share of that; one that cannot give it gives all its copies, and the report shows the share really reached.

    A source without documents owes nothing; its share cannot be reached and is reported as missing.
    """
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = [t for t in targets if t["mix_name"] == mix]
        there = [t for t in rows if sizes.get(t["source"], 0) > 0 and t["target_share"] > 0]
        total = sum(sizes[t["source"]] for t in there)
        for t in there:
            total = min(total, t["max_repeats"] * sizes[t["source"]] / t["target_share"])
        total = total if size is None else size
        for t in sorted(rows, key=lambda t: t["source"]):
            have = sizes.get(t["source"], 0)
            want = total * t["target_share"] if have else 0.0
            copies = min(int(want // have), int(t["max_repeats"])) if have else 0
            rest = max(0, round(want - copies * have)) if have and copies < t["max_repeats"] else 0
            out.append({"mix_name": mix, "source": t["source"], "target_share": float(t["target_share"]), "max_repeats": int(t["max_repeats"]), "have": int(have), "copies": copies, "rest": int(rest)})
    return out


def _uniform(*cols):
    """A number in (0, 1) from a hash: the same in every run and on every executor."""
    bits = F.pmod(F.xxhash64(*cols), F.lit(1 << 52))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, targets: DataFrame, id_col: str, source: str, tokens: str, size: int | None = None, bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """(mix_name, source, doc_id, tokens, copies) for every document a mix takes at least once.

    ``docs`` has unique ids; documents without a source or without tokens belong to no mix. ``targets`` is a small table
    (mix_name, source, target_share, max_repeats) and is read by the driver. ``size`` is the size of each mix, see ``allocate``.
    """
    spark = docs.sparkSession
    wanted = [r.asDict() for r in targets.collect()]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens")).filter(F.col("source").isNotNull() & (F.col("tokens") > 0))
    names = sorted({t["source"] for t in wanted})
    stats = {r["source"]: r for r in d.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("t"), F.sum(F.sqrt("tokens")).alias("w"), F.sum(F.col("tokens") * F.sqrt("tokens")).alias("tw")).collect()}
    plan = allocate(wanted, {k: r["t"] for k, r in stats.items()}, size)
    # inclusion probability by the root of a document's size: c * sqrt(tokens), with c such that the expected size is the rest
    rows = [(p["mix_name"], p["source"], p["copies"], p["rest"], float(p["rest"]) / stats[p["source"]]["tw"] if p["rest"] else 0.0) for p in plan if p["have"]]
    shares = spark.createDataFrame(rows, "mix_name string, source string, whole int, rest bigint, c double")
    j = d.join(F.broadcast(shares), "source")  # one row for each target: bounded by the targets table
    prob = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("c") * F.sqrt("tokens")))
    u = _uniform(F.lit(SEED), F.col("mix_name"), F.col("doc_id"))
    j = j.withColumn("q", F.log(u / (1 - u)) - F.log(prob / (1 - prob)))
    # log odds lie within +-70; each level splits the bin that holds the cut
    cuts = {(m, s): (-80.0, 80.0, 0) for m, s, _, rest, _ in rows if rest > 0}
    goal = {(m, s): rest for m, s, _, rest, _ in rows}
    for _ in range(levels):
        if not cuts:
            break
        now = spark.createDataFrame([(m, s, lo, hi) for (m, s), (lo, hi, _) in cuts.items()], "mix_name string, source string, lo double, hi double")
        inside = j.join(F.broadcast(now), ["mix_name", "source"]).filter((F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi")))
        at = F.least(F.lit(bins - 1), F.floor((F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))
        hist: dict[tuple[str, str], dict[int, int]] = {}
        for r in inside.groupBy("mix_name", "source", at.alias("bin")).agg(F.sum("tokens").alias("t")).collect():  # targets x bins rows
            hist.setdefault((r["mix_name"], r["source"]), {})[r["bin"]] = r["t"]
        for key, (lo, hi, before) in list(cuts.items()):
            got, cut, width = before, None, (hi - lo) / bins
            for b in range(bins):
                t = hist.get(key, {}).get(b, 0)
                if got + t > goal[key]:
                    cut = b
                    break
                got += t
            cuts[key] = (lo + cut * width, lo + (cut + 1) * width, got) if cut is not None else (hi, hi + 1e-9, got)
    # below the cut all are in; of the last bin the start, in order, as long as the size is not passed by more than it is missed
    lows = spark.createDataFrame([(m, s, lo, hi, goal[m, s] - got) for (m, s), (lo, hi, got) in cuts.items()], "mix_name string, source string, lo double, hi double, lack bigint")
    e = j.join(F.broadcast(lows), ["mix_name", "source"], "left")
    from pyspark.sql.window import Window as W

    edge = e.filter((F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi")))
    w = W.partitionBy("mix_name", "source").orderBy("q", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = edge.withColumn("sum", F.sum("tokens").over(w)).withColumn("extra", ((F.col("sum") - F.col("tokens") / 2) <= F.col("lack")).cast("int"))
    main = e.filter(F.col("lo").isNull() | (F.col("q") < F.col("lo")) | (F.col("q") >= F.col("hi"))).withColumn("extra", F.when(F.col("q") < F.col("lo"), 1).otherwise(0))
    cols = ["mix_name", "source", "doc_id", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return main.select(*cols).unionByName(edge.select(*cols)).filter("copies > 0")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source of each mix, with documents, copies and tokens; sources that gave nothing included."""
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum("copies").cast("bigint").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    j = targets.join(F.broadcast(got), ["mix_name", "source"], "left").join(F.broadcast(total), "mix_name", "left")
    return j.select("mix_name", "source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("actual_share"), zero("documents"), zero("copies"), zero("tokens"), zero("most_repeats"))
