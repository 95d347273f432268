import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.llm import chars, copies, lookalike, mixing, mojibake, packing, pii, queries, residue


# --- 4 copies


def canon(t):
    return "".join(c for c in (t or "").upper().lower() if c.isalnum())


def test_copies_equal_brute_force_with_hot_groups(spark):
    rng = random.Random(1)
    texts = ["Great race!", "great  RACE", "Great-Race", "straße", "STRASSE", "", None, "!!!", "other", "Other.", "x" * 5000]
    rows = [(f"id{i:03d}", rng.choice(texts), rng.choice(["a", "A.", None, "b"]), "extra") for i in range(200)]
    rows += rows[:10]  # delivered again
    df = spark.createDataFrame(rows, "document_id string, original_text string, linguistic_text string, keep_id string")
    for hot, most in ((5, 1000), (5, 2), (10_000, 1000)):  # nearly all groups hot, more of them than may be broadcast, none hot
        got = {tuple(r) for r in copies.copy_pairs(df, "document_id", copies.caption_key(), hot_rows=hot, max_hot_keys=most, salts=3).collect()}
        groups = {}
        for i, o, li, _ in rows:
            if canon(o):
                groups.setdefault((canon(o), canon(li)), set()).add(i)
        want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
        assert got == want


def test_copies_of_an_empty_table(spark):
    df = spark.createDataFrame([], "document_id string, original_text string, linguistic_text string")
    assert copies.copy_pairs(df, "document_id", copies.caption_key()).count() == 0


def test_json_keys(spark):
    a = json.dumps({"b": "Hello, World", "a": {"x": 1, "y": [1, 2]}})
    b = json.dumps({"a": {"y": ["1", "2"], "x": "1"}, "b": "hello world!"}, indent=1)
    others = [json.dumps({"b": "hello world", "a": {"x": 1}}), json.dumps({"b": None, "a": {"x": 1, "y": [1, 2]}}), "no json", None, json.dumps({"a/x": 1}), json.dumps({"a": {"x": 1}})]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([a, b, *others])], "i int, t string")
    k = {r["i"]: r["k"] for r in df.select("i", copies.json_key(F.col("t")).alias("k")).collect()}
    assert k[0] == k[1] and k[5] is None and len({k[i] for i in range(2, 8) if i != 5} | {k[0]}) == 6


# --- 5 look-alikes


@pytest.fixture(scope="module")
def trie():
    return lookalike.trie_of([("first", 9), ("timer", 5), ("like", 9), ("running", 3), ("ill", 2), ("вода", 4)])


@pytest.mark.parametrize(
    "text,want",
    [
        ("Fіrst timеr", "First timer"), ("𝚛𝚞𝚗 ｋｍ４２", "run km42"), ("café", "café"), ("run​ning", "running"), ("a b　c d", "a b c d"), ("вoда и вода", "вода и вода"),
        ("plain text", "plain text"), ("“quotes” — … 👨‍👩‍👧 ❤️ £5", None), ("Спасибо всем, НО Я", None), ("跑步，很好　真的", None), ("முதல் முறை", None), ("ﾗﾝ", "ラン"), ("", ""), ("​", ""),
    ],
)
def test_canonical(trie, text, want):
    got = lookalike.canonical(text, trie)
    assert got == (text if want is None else want)
    assert lookalike.canonical(got, trie) == got


def test_automaton_equals_brute_force(trie):
    words = ["run", "rum", "sun", "ruin", "turn"]
    t = lookalike.trie_of([(w, 1) for w in words])

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    for token in ("run", "rn", "ruun", "tum", "xyz"):
        got = {w: c for c, _, w in t.search(token, 2)}
        best = {}
        for c, _, w in t.search(token, 2):
            best[w] = min(c, best.get(w, 9))
        assert best == {w: distance(token, w) for w in words if distance(token, w) <= 2} and set(got) == set(best)
    assert t.search("гun", 0) == [] and t.search("rυn", 0)[0][2] == "run"


def test_the_vocabulary_decides_what_a_character_stands_for():
    words = [("стартом", 9), ("перед", 9), ("month", 5), ("hello", 7), ("here", 3), ("cover", 4), ("river", 4)]
    trie, empty = lookalike.trie_of(words), lookalike.Trie()
    for text, want, by_table in (
        ("перед стaртом месяц", "перед стартом месяц", "перед ctaptom месяц"), ("say heӏІo here", "say hello here", None), ("the rіνer and its coνer", "the river and its cover", None), ("HEӀӀO", "HELLO", None),
    ):
        assert lookalike.canonical(text, trie) == want
        if by_table:
            assert lookalike.canonical(text, empty) == by_table
    # another word is no reading of a token, however near it is
    assert lookalike.canonical("соνen", trie) == "coven"
    assert [w for _, _, w in trie.search("HELLO")] == ["hello"] and trie.search("hella") == []


def test_a_worker_keeps_the_trie_of_the_list_it_was_given():
    class Shared:
        def __init__(self, value):
            self.value = value

    a, b = Shared([("one", 3), ("two", 2), ("six", 1)]), Shared([("one", 3), ("ten", 2), ("six", 1)])  # equal length and ends
    assert lookalike._worker_trie(a).search("two") and not lookalike._worker_trie(b).search("two") and lookalike._worker_trie(b).search("ten")


def test_normalize_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([("ｒun", "old"), (None, "old"), ("", "old")], "t string, canonical_text string")
    got = [r["canonical_text"] for r in lookalike.normalize(df, "t", []).collect()]
    assert got == ["run", None, ""]


def test_words_beyond_the_broadcast_list(spark):
    df = spark.createDataFrame([("the soap and the вода",)] * 3 + [("the cat",)] * 3 + [("I saw the ѕоар here",), ("это cкaжи вoдa нам",), (None,)], "t string")
    whole, short = lookalike.vocabulary([df]), lookalike.vocabulary([df], limit=1)
    assert whole.tail is None and short == [("the", 7)] and {r["word"] for r in short.tail.collect()} == {w for w, _ in whole} - {"the"}
    a, b = (sorted(lookalike.normalize(df, "t", w).select("t", "canonical_text").collect(), key=str) for w in (whole, short))
    assert a == b and "I saw the soap here" in {r["canonical_text"] for r in b}


def test_three_scripts_in_one_token():
    assert lookalike.canonical("my mаrαthon day") == "my marathon day"


# --- 6 wrong encodings


@pytest.mark.parametrize("text", ["Café crème brûlée — “oui” 😭", "完走できました。来年も頑張ります。", "பதக்கம் மிகவும் அழகாக இருக்கிறது", "Спасибо всем, кто был рядом"])
@pytest.mark.parametrize("codec", ["latin-1", "cp437", "mac_roman"])
def test_round_trip(text, codec):
    bad = text.encode().decode(codec)
    got, found, whole = mojibake.repair(bad)
    assert found and got == text and whole


def test_two_layers_and_lost_characters():
    bad = "très – naïve".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(bad) == ("très – naïve", True, True)
    got, found, whole = mojibake.repair("Ol� encore")
    assert found and not whole and got == "Ol� encore"


@pytest.mark.parametrize("text", ["", "ascii", "SENSAÇÃO! MANHÃ!", "Señor naïve 30 °C ±5", "Năm nay tôi đã khóc, ườ", "утро было влажным и душным, темно", "ปีนี้อากาศร้อน โกน", "跑步 没有 Kelab Lari", "¡Qué alegría! «olé»", "👨‍👩‍👧 ☀️ … – “x”"])
def test_good_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, False, True)


def test_restore_frame(spark):
    df = spark.createDataFrame([("x", "cafÃ© â€œokâ€\x9d", 1), ("y", None, 2), ("z", "", 3)], "id string, original_text string, was_garbled int")
    got = {r["id"]: (r["restored_text"], r["was_garbled"]) for r in mojibake.restore(df).collect()}
    assert got == {"x": ("café “ok”", True), "y": (None, False), "z": ("", False)}


@pytest.mark.parametrize("codec", ["cp1251", "cp1250", "cp866", "koi8-r", "cp1253", "cp1258", "cp874"])
def test_lone_accents(codec):
    back = {b: c for c, b in mojibake._bytes(codec).items()}
    bad = "".join(back[b] for b in "Jalapeño für das café".encode())
    assert mojibake.repair(bad) == ("Jalapeño für das café", True, True)


def test_lone_pairs_that_stay():
    for text in ("Еіght Віrds", "Expoรถติด", "Моя машина и её Run"):
        assert mojibake.repair(text) == (text, False, True)
    assert mojibake.residue("SeГ±or") and not mojibake.residue("Señor")


# --- 2 personal information


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("write to runner52 [at] post [dot] example [dot] my please", ["email"]), ("mail ｒｕｎ＠example.com now", ["email"]), ("tri-8 @ mail.example.net", ["email"]), ("call 0 one six 5 5 5 eight 625 now +60", ["phone"]),
        ("whatsapp +60 18-555 8454", ["phone"]), ("ring (03) 5550 2038", ["phone"]), ("IC 890106 14 1751", ["id_number"]), ("passport A33277487", ["id_number"]), ("NIK 3102691403855588", ["id_number"]),
        ("come to 42 Jalan Kenanga, 50999 Kota Selasih", ["address"]), ("Unit B-21-12, Pangsapuri Melur, Lorong Tiram", ["address"]), ("thanks to Suriana binti Abd Wahib", ["name"]), ("My pacer Dr. Tobias Delacourt", ["name"]),
        ("Bib A1234567, order 2024-760-6677, 05:58:36", []), ("turned left into Jalan Kenanga before Dataran Teratai", []), ("#x @run.abc123 https://a.example/p/1", []), ("Tracked as activity 11832081730.", []), ("Team Larks United and Kelab Lari Mentari", []), ("", []),
    ],
)
def test_pii(text, kinds):
    assert [k for _, _, k in pii.find(text)] == kinds


@pytest.mark.parametrize(
    "text,parts,name",
    [
        ("Thank You Everyone For Coming And Thanks To Ahmad Faizal For Pacing Me Today", {"faizal"}, "Ahmad Faizal"), ("Thank You Everyone For Coming And Thanks To Every Volunteer On The Road", {"faizal"}, None),
        ("This Year Siti Binti Rahman Ran With All Of Us", set(), "Siti Binti Rahman"), ("with siti binti rahman at the start", set(), "siti binti rahman"), ("ich bin sehr froh", set(), None),
        ("меня зовут Иван Петров", set(), "Иван Петров"), ("我叫王小明。", set(), "王小明"), ("感谢张伟教练的帮助", set(), "张伟"), ("感谢周围的人，马上出发", set(), None),
    ],
)
def test_names_in_other_cases_and_scripts(text, parts, name):
    got = [text[a:b] for a, b, k in pii.find(text, frozenset(parts)) if k == "name"]
    assert got == ([] if name is None else [name])


def test_a_quick_look_lets_everything_through():
    texts = ["ｃａｌｌ ０１２３４５６７８９", "a (at) b (dot) com x.y", "zero one two three four five six seven", "mail x @ y.example.com", "No. 5 Jalan Kenanga", "零一二三四五六七八九", "n.a＠ex.org"]
    assert all(not pii._nothing(t, frozenset()) for t in texts)
    assert pii._nothing("a fine day on the road #klscm2024 @run.abc https://a.b/1234567", frozenset())


def test_redaction_keeps_the_rest():
    text = "Hi 👋 write tri-8@example.org​ or call +65 9555 2671!"
    assert pii.redact(text) == "Hi 👋 write [EMAIL]​ or call [PHONE]!"
    for a, b, _ in pii.find(text):
        assert 0 <= a < b <= len(text)


def test_learned_names_in_any_case(spark):
    df = spark.createDataFrame([("thanks to Aizatul bin Rosmawi",), ("Dr. Aizatul Hartigan came",), ("Slot belongs to Rosmawi Hartigan ok",), (None,), ("",)], "t string")
    parts = pii.learn_parts([df], min_rows=2)
    assert {"aizatul", "rosmawi", "hartigan"} <= set(parts)
    assert [k for _, _, k in pii.find("AIZATUL HARTIGAN RAN WITH US", frozenset(parts))] == ["name"]
    got = pii.detect(df, "t", parts).select("redacted_text", F.size("pii").alias("n")).collect()
    assert got[3]["redacted_text"] is None and got[4]["redacted_text"] == ""


@pytest.mark.parametrize("text", ["Ahmad b. Ali came", "with Tan Sri Ahmad Zulkifli today", "we saw En. Ahmad Zulkifli", "then Doña Carmen Valdez sang"])
def test_gates_let_every_pattern_through(text):
    assert [k for _, _, k in pii.find(text)] == ["name"]


def test_bracketed_at_without_a_disguised_dot():
    assert [k for _, _, k in pii.find("write runner52 (di) post.example.my please")] == ["email"]


def test_parts_beyond_the_broadcast_list(spark):
    df = spark.createDataFrame([("thanks to Aizatul bin Rosmawi",)] * 3 + [("Dr. Delia Hartigan came",)] * 2 + [("saw Delia Hartigan there",), (None,), ("",)], "t string")
    whole = pii.learn_parts([df], min_rows=2)
    short = pii.learn_parts([df], max_parts=2, min_rows=2)
    assert whole.tail is None and set(short) == {"aizatul", "rosmawi"} and {r["part"] for r in short.tail.collect()} == set(whole) - set(short)
    a, b = (sorted(pii.detect(df, "t", p).select("t", "redacted_text").collect(), key=str) for p in (whole, short))
    assert a == b and "saw [NAME] there" in {r["redacted_text"] for r in b}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Captions and mentions with one case in every field."""
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([("c1", "mail a@b.example.org", ["ｒun", "run"]), ("c2", "Fіrst", None), ("c3", None, [])], "document_id string, original_text string, hashtags array<string>").write.parquet(f"{d}/instagram_captions.parquet")
    spark.createDataFrame([("m1", "call +60 18-555 8454"), ("m2", "ｒun"), ("m3", None)], "mention_id string, evidence_text string").write.parquet(f"{d}/absa_mentions.parquet")
    return str(d)


def test_every_field_is_redacted(spark, tables):
    got = {(r["field_name"], r["record_id"]): (r["record_table"], r["redacted_text"], r["replaced"]) for r in queries.p2_redacted(spark, tables).collect()}
    assert len(got) == 6 and got["evidence_text", "m1"] == ("absa_mentions", "call [PHONE]", 1) and got["original_text", "c1"] == ("instagram_captions", "mail [EMAIL]", 1)
    assert got["evidence_text", "m3"][1] is None and got["original_text", "c3"][1] is None


def test_every_field_has_a_canonical_form(spark, tables):
    got = {(r["field_name"], r["record_id"]): (r["canonical_text"], r["canonical_tags"]) for r in queries.p5_canonical(spark, tables).collect()}
    assert len(got) == 9 and got["hashtags", "c1"] == (None, ["run", "run"]) and got["hashtags", "c2"] == (None, None) and got["hashtags", "c3"] == (None, [])
    assert got["original_text", "c2"] == ("First", None) and got["evidence_text", "m2"] == ("run", None) and got["evidence_text", "m3"] == (None, None)


# --- 9 residue


@pytest.fixture(scope="module")
def index():
    return residue.Index({}, 5.0)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Hi {{first_name}}, thank you", "placeholder"), ("Dear [Your Name], welcome", "placeholder"), ("Your coupon is $$COUPON$$.", "placeholder"), ("Please enable JavaScript to view this page.", "scripts"), ("502 Bad Gateway", "error"),
        ("Intro line.\nError establishing a database connection\nMore.", "error"), ("Lorem ipsum dolor sit amet, consectetur", "filler"), ("blah blah blah blah blah blah", "filler"), ("Checking your browser before accessing x.example. This process is automatic.", "block"), ("页面不存在或已被删除，9秒后返回首页。", "error"),
    ],
)
def test_residue(index, text, kind):
    assert kind in dict(residue.classify(text, index))


@pytest.mark.parametrize("text", ["", "The registration page kept throwing a 503 error until noon, then it worked.", "My coach wrote {breathe} on every page of the plan, in curly brackets", "Splits <5:30 min/km> look easy", "I saw it [photo by my sister].", "Access to the stadium was denied for families, which felt wrong.", "I build JavaScript apps for a living, so sitting still hurts."])
def test_ordinary_talk_is_no_residue(index, text):
    assert residue.classify(text, index) == []


def test_fields_and_runs_are_matched_by_containment(index, monkeypatch):
    assert "<ph_code>" in residue.tokens(residue.with_fields("Hi {{first_name}}, go", residue.fields("Hi {{first_name}}, go")))
    assert {"<ph_code>", "<ph_word>", "<key>", "<rep>", "<latin>"} <= set(index.post)
    texts = ("Hi {{first_name}}, thank you", "Dear [Runner], welcome", "blah asdf blah foo blah", "so so so so so", "elit sed quam ipsum magna")
    assert [[k for k, _ in residue.classify(t, index)] for t in texts] == [["placeholder"]] * 2 + [["filler"]] * 3
    monkeypatch.setattr(index, "post", {})  # without the index nothing is found
    assert all(residue.classify(t, index) == [] for t in texts)


def test_field_weights_are_counted(spark):
    df = spark.createDataFrame([("Hi {{a}}",), ("[gallery x] 50 %",), (None,), *[("Dear [Runner]",)] * 9], "text string")
    idf, _ = residue.token_weights(df)
    assert idf["<ph_word>"] < idf["<ph_code>"] == idf["<ph_label>"] < idf["<ph_date>"]


def test_find_residue_frame(spark):
    df = spark.createDataFrame([(1, "404 Not Found"), (2, None), (3, ""), (4, "A fine race. " * 3000 + "\nlorem ipsum dolor sit amet")], "doc_id long, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == {1, 4}


# --- 7 containers


@pytest.mark.parametrize("capacity", [10, 128])
def test_plan_uses_every_item_once_and_is_nearly_full(capacity):
    rng = random.Random(capacity)
    hist = {}
    for _ in range(3000):
        s = min(capacity, int(rng.lognormvariate(1.0, 0.8)) + 1)
        hist[s] = hist.get(s, 0) + 1
    shapes = packing.plan(sorted(hist.items()), capacity, rounds=60)
    used = {}
    for shape, n in shapes:
        assert sum(s * k for s, k in shape.items()) <= capacity
        for s, k in shape.items():
            used[s] = used.get(s, 0) + k * n
    assert used == hist
    low = -(-sum(s * n for s, n in hist.items()) // capacity)
    assert sum(n for _, n in shapes) <= 1.05 * low + 2


def test_plan_is_best_on_small_cases():
    # 3 of 6 and 6 of 4 in tens: 3 full containers of 6 + 4, one of 4 + 4, one of 4
    assert sum(n for _, n in packing.plan([(6, 3), (4, 6)], 10)) == 5
    assert packing.plan([], 10) == [] and packing.plan([(10, 2)], 10) == [({10: 1}, 2)]


def test_knapsack_is_exact_within_limits():
    rng = random.Random(8)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(1, 12), 4)))
        values = np.array([rng.random() for _ in sizes])
        limit = np.array([rng.randrange(1, 4) for _ in sizes])
        cap = rng.randrange(8, 25)
        got = packing._knapsack(sizes, values, cap, limit)
        best = max(sum(v * k for v, k in zip(values, n, strict=True)) for n in itertools.product(*[range(m + 1) for m in limit]) if sum(s * k for s, k in zip(sizes, n, strict=True)) <= cap)
        assert (got <= limit).all() and (got * sizes).sum() <= cap and (got * values).sum() == pytest.approx(best)


def test_fill_splits_only_what_is_too_long(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 25, 10, 7, 0, None, 7, 3, 3])], "id long, n long")
    rows = packing.fill(df, "id", "n", 10, ranked=2).collect()
    room = {}
    for r in rows:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["size"]
    assert max(room.values()) <= 10 and len(room) <= 7
    pieces = {k: sorted(r["size"] for r in g) for k, g in itertools.groupby(sorted(rows, key=lambda r: r["item_id"]), key=lambda r: r["item_id"])}
    assert pieces == {0: [3], 1: [5, 10, 10], 2: [10], 3: [7], 6: [7], 7: [3], 8: [3]}
    assert packing.fill(df.filter("false"), "id", "n", 10).count() == 0


# --- 8 mixing


def test_allocation_of_a_given_size():
    targets = [{"mix_name": "m", "source": x, "target_share": 0.5, "max_repeats": 2} for x in "ab"]
    a, b = mixing.allocate(targets, {"a": 1000, "b": 50}, 1000)
    assert (a["copies"], a["rest"]) == (0, 500) and (b["copies"], b["rest"]) == (2, 0)
    a, b = mixing.allocate(targets, {"a": 1000, "b": 50})
    assert a["rest"] == 100 and b["copies"] == 2


def test_mix_reaches_the_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i % 4 else "small", int(rng.integers(1, 400))) for i in range(4000)] + [(9001, None, 5), (9002, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.4, 3), ("m", "none", 0.1, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, "doc_id", "source", "tokens")
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t"), F.max("copies").alias("m"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    by = {r["source"]: r for r in got}
    assert abs(by["big"]["t"] / by["small"]["t"] - 5 / 4) < 0.01 and by["small"]["m"] <= 3 and by["big"]["m"] <= 2
    assert all(r["n"] == r["d"] for r in got)
    again = mixing.mix(docs.repartition(7), targets, "doc_id", "source", "tokens")
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in again.collect()}
    rep = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    assert rep["none"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-5


def test_character_tables():
    assert chars.skeleton("а") == "a" and chars.plain("𝚛") == "r" and chars.plain("①") == "①" and chars.script("跑") == "CJK"


def test_what_is_kept_of_stretches_depends_on_their_place():
    mojibake._odds_kept.cache_clear()
    pair = next(a + z for a in "Г" for z in map(chr, range(0x400, 0x500)) if mojibake.LONE.search(f"x{a}{z}x"))
    # the same stretch against a letter and apart, in either order, and one beyond the bound of what is kept
    alone, inside = mojibake.cost(f"{pair} ok"), mojibake.cost(f"x{pair}x")
    assert inside == alone + 2.0 and mojibake.cost(f"{pair} ok") == alone and mojibake.residue(f"x{pair}x")
    assert mojibake.cost("é" * (mojibake.KEPT + 1)) > mojibake.cost("é" * mojibake.KEPT)
    assert mojibake._odds_kept.cache_info().currsize == 3
