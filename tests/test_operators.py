import random

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import cube, evaluate, graphs, grounding, sampling, stats, topics, windows
from lumenloom.sources import files


def test_support_and_effect_bands(spark):
    df = spark.createDataFrame([(29,), (30,), (499,), (500,)], "n int").select(cube.support_band(F.col("n")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["very_low", "low", "moderate", "high"]


def test_duplicates_skip_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "")], "id int, k string")
    got = {r["id"]: r["duplicate_of"] for r in windows.mark_duplicates(df, F.col("k"), "id", [F.col("id")], F.col("k") == "").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None}


@pytest.mark.parametrize("bins,n,want", [(4, 10, [3, 2, 2, 3]), (3, 10, [3, 3, 4]), (4, 1, [1, 0, 0, 0])])
def test_quantile_bins(spark, bins, n, want):
    df = spark.range(1, n + 1).select(windows.quantile_bin(F.col("id"), F.lit(n), bins).alias("b"))
    got = [r["b"] for r in df.collect()]
    assert [got.count(k) for k in range(bins)] == want


def test_greedy_representatives_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("g", f"d{rng.randrange(12)}", "x" * rng.randrange(1, 9) + rng.choice("ab")) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, d string, t string")
    got = [(r["d"], r["t"]) for r in windows.greedy_representatives(df, ["g"], "d", "t", F.lower("t"), 5).orderBy("position").collect()]
    want = []
    for _, d, t in sorted(set(rows), key=lambda r: (-len(r[2]), r[1], r[2])):
        if len(want) < 5 and all(d != a and t.lower() != b.lower() for a, b in want):
            want.append((d, t))
    assert got == want


def test_corrections_and_interval(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.20), ("f", "d", None)], "f string, k string, p double")
    got = {r["k"]: (r["p_bh"], r["p_holm"]) for r in stats.adjust(df, ["f"], "p", ["k"]).collect()}
    assert got["a"] == (pytest.approx(0.03), pytest.approx(0.03)) and got["b"] == (pytest.approx(0.03), pytest.approx(0.04)) and got["c"] == (pytest.approx(0.2), pytest.approx(0.2)) and got["d"] == (None, None)
    low, high = stats.wilson(F.lit(0), F.lit(100))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r["l"] == pytest.approx(0, abs=1e-12) and 0.03 < r["h"] < 0.04


def test_chi_square_tail():
    assert stats._tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats._tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert stats._tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert stats._tail(11.070497693516351, 5) == pytest.approx(0.05)


def test_chi_square_with_an_empty_cell(spark):
    df = spark.createDataFrame([("a", 1, 0, 50), ("a", 2, 10, 50)], "a string, y int, k bigint, n bigint")
    r = stats.chi_square(df, ["a"], "y", "k", "n").first()
    assert r["statistic"] == pytest.approx(100 * 0.1**2 / (0.1 * 0.9) * 1.0) and r["df"] == 1


CASES = [
    ("tea was cold at noon", "cold at noon", None, None, "exact", "none"),
    ("we had  two\ncups left", "two cups left", None, None, "recovered", "unique_whitespace_match"),
    ("Jalapen\u0303o soup", "Jalape\u00f1o soup", None, None, "recovered", "unique_unicode_match"),
    ("two  cups, two cups", "two cups", 0, 9, "exact", "none"),
    ("hot   tea and hot\ttea", "hot tea", 0, 9, "recovered", "given_offsets"),
    ("Only ONE cup", "one cup", None, None, "recovered", "unique_case_match"),
    ('a "slow" queue', "a slow queue", None, None, "recovered", "unique_punctuation_match"),
    ("no queue — at all", "no queue - at all", None, None, "recovered", "unique_punctuation_match"),
    ('A "Slow"  queue', "a slow queue", None, None, "unrecoverable", "none"),  # one way of looking away at a time
    ("hot   tea and hot\ttea", "hot tea", None, None, "unrecoverable", "none"),
    ("rain at five", "sunshine all day", None, None, "unrecoverable", "none"),
    (None, "x", None, None, "unrecoverable", "none"),
    ("x", None, None, None, "no_evidence", "none"),
    ("x", "", None, None, "no_evidence", "none"),
]
REASONS = [
    ("two  cups", "two cups", "whitespace_difference"), ("Two Cups", "two cups", "case_difference"), ("rain at five", "rain ... five", "truncated_evidence"), ("rain at five", "rain \U0001f327", "emoji_alias_difference"),
    ("rain at five today", "rain today was heavy", "translated_or_paraphrased_evidence"), ("rain at five", "sunshine all day long", "hallucinated_evidence"), ("rain", "??", "other"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, s, e, None, None) for i, (s, e, _) in enumerate(REASONS)], "i int, s string, e string, a int, b int")
    got = {r["i"]: r["grounding"]["reason"] for r in grounding.ground_mentions(df, "s", "e", "a", "b").collect()}
    assert [got[i] for i in range(len(REASONS))] == [x[2] for x in REASONS]


def test_grounding(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, s string, e string, a int, b int")
    got = {r["i"]: r["grounding"] for r in grounding.ground_mentions(df, "s", "e", "a", "b").collect()}
    for i, c in enumerate(CASES):
        assert (got[i]["status"], got[i]["method"]) == c[4:], c
    for i, span in ((1, "two\ncups left"), (2, "Jalapen\u0303o soup"), (6, 'a "slow" queue'), (4, "hot   tea")):
        assert CASES[i][0][got[i]["start"] : got[i]["end"]] == span


def test_grounding_of_long_evidence():
    s = "Start of a long review which says many things. " * 1 + "Middle part that was left out by the model. And here is the very end of the passage, done."
    assert grounding.anchored(s, "Start of a long review ... very end of the passage") == (0, s.index("very end of the passage") + len("very end of the passage"))


def test_agreement_and_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    r = evaluate.agreement(df, "x", "y").first()
    assert r["agreement"] == 0.75 and r["kappa"] == pytest.approx(0.5) and r["pabak"] == 0.5
    same = evaluate.agreement(df.filter("x = 'b' AND y = 'b'"), "x", "y").first()
    assert same["kappa"] is None
    m = {x["label"]: x for x in evaluate.per_class(df, "x", "y", cube.dimension(spark, "label", ("a", "b", "c"))).collect()}
    assert m["a"]["precision"] == 1 and m["a"]["recall"] == 0.5 and m["c"]["f1"] == 0


def test_matching(spark):
    g = spark.createDataFrame([("d", "x", "1", "pos"), ("d", "x", "2", "neg"), ("e", "y", "3", "pos")], "d string, a string, m string, s string")
    p = spark.createDataFrame([("d", "x", "8", "pos"), ("f", "y", "9", "pos")], "d string, a string, m string, s string")
    c = {r["d"]: (r["gold"], r["predicted"], r["matched"]) for r in evaluate.match_counts(g, p, ["d", "a"]).collect()}
    assert c == {"d": (2, 1, 1), "e": (1, 0, 0), "f": (0, 1, 0)}
    j = evaluate.match_ordinal(g, p, ["d", "a"], "m").filter("m = '1'").first()
    assert j["p_m"] == "8"


def test_roots_and_cycles(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "id int, t int")
    got = {r["id"]: r for r in graphs.roots(e, "id", "t").collect()}
    assert [got[i]["root"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1] and got[4]["steps"] == 3
    assert got[5]["missing"] and got[6]["cycle"] and got[7]["cycle"] and not got[4]["cycle"]


def test_allocation_with_tied_remainders(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "s string, n int")
    got = {r["s"]: r["quota"] for r in sampling.proportional(s, "s", "n", 2).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 0}
    with pytest.raises(ValueError):
        sampling.blind(s, ["s", "model_label"])


def test_cover_is_bounded_per_group(spark):
    df = spark.createDataFrame([(f"m{i}", f"d{i // 4}", f"v{i % 5}", f"w{i % 3}") for i in range(40)], "id string, d string, v string, w string")
    rows = sampling.coverage_sample(df, "id", "d", ["v", "w"], 6, per_group=1)
    assert {r["v"] for r in rows} == {f"v{i}" for i in range(5)} and len({r["d"] for r in rows}) == len(rows)


def test_rand_index_and_zero_vector(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2)], "a int, b int")
    assert topics.rand_index(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    v = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(topics.unit(F.col("v")).alias("u")).first()["u"]
    assert v == [0.0, 0.0]


def test_json_lines_keep_odd_line_ends(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": "one two"}\n{"a": \n{"a": "three"}\n', encoding="utf-8")
    rows = files.read_json_lines(spark, str(p), "a string").collect()
    assert sorted(r["a"] or "" for r in rows) == ["", "one two", "three"] and sum(r["malformed"] is not None for r in rows) == 1


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "", ["a", "b"])], "id string, t string, l array<string>")
    files.write_pair(df, str(tmp_path / "out"))
    back = files.read_csv_strings(spark, str(tmp_path / "out/csv"), ["id", "t", "l"]).first()
    assert back["t"] == "" and back["l"] == '["a","b"]'
    with pytest.raises(Exception):
        files.write_pair(df, str(tmp_path / "out"))
    a = files.file_manifest(spark, str(tmp_path / "out/parquet"), "*.parquet")
    assert files.changed_files(a, a).count() == 0
    b = a.withColumn("sha256", F.lit("0"))
    assert {r["state"] for r in files.changed_files(a, b).collect()} == {"changed"}


def test_file_numbers(spark):
    df = spark.range(0, 25)
    got = files.chunk_numbers(df, [F.col("id")], 10, parts=4).groupBy("file_number").count().orderBy("file_number").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 10), (1, 10), (2, 5)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in files.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_bootstrap_interval(spark):
    df = spark.range(0, 500).select("id", (F.col("id") % 2).alias("v"))
    r = evaluate.bootstrap(df, F.col("v"), "id", 100).first()
    assert r["low"] < 0.5 < r["high"] and 0.4 < r["low"] and r["high"] < 0.6
