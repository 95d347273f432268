"""Operators without SQL against brute force, and cases that the tables lack."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import evaluate, sampling, windows
from lumenloom.plans import language, products, reports, themes
from lumenloom.sources import files


def brute_transitions(base, cand):
    used, out = set(), {}
    for b in sorted(base):
        free = [c for c in sorted(cand) if c[0] not in used]
        same = [c for c in free if c[1:3] == b[1:3]] or [c for c in free if c[3] == b[3]]
        c = same[0] if same else None
        used |= {c[0]} if c else set()
        if b[2] == "TP":
            out[b[0]] = (c and c[0], "TP_missing" if not c else "TP_kept" if c[2] == "TP" and c[1] == b[1] else "TP_other_aspect")
        else:
            out[b[0]] = (c and c[0], "FP_removed" if not c else "FP_corrected" if c[2] == "TP" else "FP_still_there" if c[1] == b[1] else "FP_changed")
    return out


def test_transitions_equal_brute_force(spark):
    rng = random.Random(3)
    row = lambda i: (f"m{i:02}", rng.choice("xy"), rng.choice(("TP", "FP")), rng.choice(("one", "two", "")))
    docs = {f"d{k}": ([row(i) for i in range(rng.randrange(1, 6))], [row(i) for i in range(rng.randrange(0, 6))]) for k in range(40)}
    schema = "document_id string, mention_id string, aspect string, status string, evidence_text string"
    sides = [spark.createDataFrame([(d, *r) for d, p in docs.items() for r in p[k]], schema) for k in (0, 1)]
    got = {(r["document_id"], r["mention_id"]): (r["candidate_id"], r["transition"]) for r in products.transitions(*sides).collect()}
    want = {(d, m): v for d, (b, c) in docs.items() for m, v in brute_transitions(b, c).items()}
    assert got == want


def test_coverage_equals_greedy_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(f"i{k:03}", f"g{rng.randrange(6)}", rng.choice("abc"), rng.choice(["p", "q", None]), rng.choice("uvwxyz")) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, g string, a string, b string, c string")
    got = [r["id"] for r in sampling.coverage_sample(df, "id", "g", ["a", "b", "c"], 9)]
    left, seen, used, want = list(rows), set(), {}, []
    while left and len(want) < 9:
        best = max(left, key=lambda r: (sum((k, r[k]) not in seen for k in (2, 3, 4)), r[0]))
        left.remove(best)
        if used.get(best[1], 0) < 2:
            used[best[1]] = used.get(best[1], 0) + 1
            seen |= {(k, best[k]) for k in (2, 3, 4)}
            want.append(best[0])
    assert got == want


def test_ranks_with_one_large_group(spark):
    rows = [("big" if i % 3 else None, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: (r["rank"], r["size"]) for r in windows.ranks(df, ["g"], ["v", "i"], 7).collect()}
    for g in ("big", None):
        mine = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in mine] == [(k, len(mine)) for k in range(1, len(mine) + 1)]
    assert windows.ranks(df.limit(0), ["g"], ["v", "i"]).count() == 0


def test_bootstrap_weights_have_mean_one(spark):
    cuts = evaluate._poisson_cuts()
    assert sum(1 - c for c in cuts) == pytest.approx(1, abs=1e-9)
    r = evaluate.bootstrap(spark.range(400).withColumn("v", F.col("id") % 2), F.col("v"), "id", 300).first()
    assert r["mean"] == pytest.approx(0.5, abs=0.01) and 0.43 < r["low"] < 0.5 < r["high"] < 0.57


def test_ids_from_files_whatever_the_header(spark, tmp_path):
    for name, lines in (("a/x_1.csv", ["document_id,l", "d1,1", "d2,2"]), ("b/c/x_2.csv", ['﻿l,"record_id"', '3,"d3"', "4,d1", ""]), ("b/y.csv", ["document_id", "d9"]), ("x_3.csv", ["other", "d8"]), ("x_4.csv", ["document_id"])):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(lines), "utf-8")
    assert sorted(r["id"] for r in files.collect_ids(spark, str(tmp_path), ["x_*.csv"]).collect()) == ["d1", "d2", "d3"]


def test_keys_that_are_not_unique_are_refused(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string")
    assert files.one_to_one(a, a.withColumnRenamed("l", "r"), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        files.one_to_one(a, a.unionByName(a).withColumnRenamed("l", "r"), ["k"]).collect()
    with pytest.raises(ValueError, match="missing"):
        files.require(a, ["k", "z"])


def test_language_spans_and_components(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(20))
    df = spark.createDataFrame([(1, words), (2, "Short one here. Tiny."), (3, ""), (4, None)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", language.spans(F.col("t")).alias("s")).collect()}
    assert got[1] == [words, " ".join(words.split()[:16]), " ".join(words.split()[11:])] and got[2] == ["Short one here."] and got[3] == [""] == got[4]
    parts = spark.createDataFrame([("d", "A", "abcd", 0.5), ("d", "A", "ab", 1.0), ("d", "B", "xy 12", None), ("d", "", "zz", 1.0), ("d", None, "zz", 1.0), ("e", "A", "12", 1.0)], "d string, l string, t string, c double")
    c = {(r["d"], r["language"]): (r["letters"], r["coverage"], r["confidence"]) for r in language.components(parts, "d", "l", "t", "c").collect()}
    assert c == {("d", "A"): (6, 0.75, pytest.approx(0.6667)), ("d", "B"): (2, 0.25, 0.0)}


def test_topic_text_and_pairs(spark):
    r = spark.createDataFrame([("Go @a.b https://x.y/z #Night_Run-2024 now",), (None,)], "t string").select(themes.topic_text(F.col("t")).alias("r")).collect()
    assert [x["r"] for x in r] == ["Go Night Run 2024 now", ""]


def test_matching_and_information_of_groupings():
    rng = random.Random(9)
    for _ in range(30):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        t = [[rng.randrange(9) for _ in range(m)] for _ in range(n)]
        got = reports.best_matching(t)
        big, small = (t, m) if n <= m else ([list(c) for c in zip(*t, strict=True)], n)
        best = max(sum(r[j] for r, j in zip(big, p, strict=True)) for p in itertools.permutations(range(small), len(big)))
        assert sum(t[i][j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
    assert reports.best_matching([]) == []
    assert reports.adjusted_information([[5, 0], [0, 7]]) == pytest.approx(1)
    # against the definition: the mean mutual information over all ways to arrange the second grouping
    a, b = [0, 0, 0, 1, 1], [0, 0, 1, 1, 1]

    def information(x, y):
        k = len(x)
        return sum(c / k * math.log(c * k / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == (i, j) for p in zip(x, y, strict=True))))

    every = [information(a, list(p)) for p in itertools.permutations(b)]
    mean = sum(every) / len(every)
    top = (information(a, a) + information(b, b)) / 2
    assert reports.adjusted_information([[2, 1], [0, 2]]) == pytest.approx((information(a, b) - mean) / (top - mean))


def test_names_of_authors_are_cut_at_words(spark, tmp_path):
    rows = [("a", "Ann Lee", "ann lee met Ann-Lee, annual leek. See https://x.y"), ("b", "Lee", "ANN  LEE and lee"), ("c", None, None), ("d", "xy", "xy stays")]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "document_id string, author string, original_text string, ingested_at int").write.parquet(str(tmp_path / "blog_reviews.parquet"))
    got = {r["document_id"]: r["redacted"] for r in themes.redacted_reviews(spark, str(tmp_path)).collect()}
    assert got == {"a": "[AUTHOR] met Ann-[AUTHOR], annual leek. See [URL]", "b": "ANN  [AUTHOR] and [AUTHOR]", "c": "", "d": "xy stays"}
