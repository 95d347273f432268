import math

from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators import chunking


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


def test_hashtags_and_views(spark):
    assert one(spark, X.hashtags, "Wet shoes all day #TrailLife; then tea #Hujan.") == ["traillife", "hujan"]
    assert one(spark, X.linguistic, "Tea at noon, @kedai.kopi www.kopi.test #Teh_Tarik ☕") == "Tea at noon,"
    assert one(spark, X.linguistic, "two cups left#one #two#three #") == "two cups left"
    assert one(spark, X.linguistic, None) == ""
    assert one(spark, X.text_hash, "Two -- CUPS, left") == one(spark, X.text_hash, "two cups left!")


def test_ids_keep_empty_parts(spark):
    assert one(spark, X.stable_id, "a", None, "b") != one(spark, X.stable_id, "a", "b", None)
    assert len(one(spark, X.stable_id, "a", "b", "c")) == 20


def test_year(spark):
    assert one(spark, X.year, "", "posted 2023-10-01") == "2023"
    assert one(spark, X.year, "no year", "2023") == "Unknown"
    assert one(spark, X.year, None, None) == "Unknown"


def test_quality_order(spark):
    for text, reason in (("   ", "empty_text"), ("www.kopi.test/a?b", "url_only"), ("@kedai @teh", "mention_only"), ("@kedai #teh", "empty_after_normalization"), ("☕🥵", "emoji_only"), ("?? …", "punctuation_only"), ("ok 5", None)):
        assert one(spark, X.quality, text) == reason


def test_tokens_sentences_parts(spark):
    assert {"kopi", "喝茶", "茶吧", "吧", "今天"} <= set(one(spark, X.multilingual_tokens, "Kopi 喝茶吧 今天"))
    assert one(spark, X.sentences, "One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, X.join_distinct, "Route", "route", "hill") == "Route | hill"
    assert one(spark, X.tag_words, "KlangRun2024_fun") == "Klang Run 2024 fun"
    assert one(spark, X.expand_short_forms, "sy dh daftar utk larian ni") == "saya sudah daftar untuk larian ini"
    assert one(spark, X.expression, " not  enough training! ") == "not enough training"


def test_chunks_cover_the_text_and_respect_the_cap(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40)) + " " + "x" * 500 + "."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "id int, t string")
    rows = chunking.units(df, "id", "t", 30).orderBy("id", "chunk_index").collect()
    mine = [r for r in rows if r["id"] == 1]
    assert "".join(r["text"] for r in mine).replace(" ", "") == text.replace(" ", "")
    assert all(r["tokens"] <= 30 for r in mine) and len(mine) > 5
    assert {r["id"] for r in rows} == {1, 4}
    assert [r["chunk_index"] for r in mine] == list(range(len(mine)))


def test_no_unit_exceeds_the_cap_in_any_script(spark):
    texts = ["水" * 900 + "。" + "路很长。" * 50, "é" * 777, "🏅" * 300, "இ" * 400 + " இ", "a. " * 400, "ab. x\n" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for cap in (1, 7, 40):
        rows = chunking.units(df, "id", "t", cap).orderBy("id", "chunk_index").collect()
        assert max(r["tokens"] for r in rows) <= max(cap, 2)
        for i, t in enumerate(texts):
            assert "".join("".join(r["text"] for r in rows if r["id"] == i).split()) == "".join(t.split())


def test_token_estimate(spark):
    assert one(spark, X.token_estimate, "") == 1
    assert one(spark, X.token_estimate, "x" * 35) == math.ceil(35 / 3.5)
