"""Products for readers and their checks: overviews, wide labels, transitions, citations, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.functions import text as X
from lumenloom.operators import chunking, cube, sampling
from lumenloom.plans.evaluation import _GP, _gold_predicted
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}, {T.SQL_ASSESS}"


def overview(long: DataFrame, group: str, documents: DataFrame, k: int) -> DataFrame:
    """One row per group: documents, mentions, shares of the sentiments, the ``k`` most frequent aspects (by documents, mentions, name)."""
    m = long.groupBy(group).agg(F.count("*").alias("mentions"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in cube.SENTIMENTS])
    a = long.filter("aspect IS NOT NULL").groupBy(group, "aspect").agg(F.countDistinct("document_id").alias("n"), F.count("*").alias("m"))
    w = W.partitionBy(group).orderBy(F.desc("n"), F.desc("m"), "aspect")
    top = a.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "aspect"))), lambda x: x["aspect"]), ",").alias("top_aspects"))
    j = documents.join(m, group, "left").join(top, group, "left").fillna(0, ["mentions", *cube.SENTIMENTS]).fillna("", ["top_aspects"])
    return j.select(group, "documents", F.col("mentions").cast("bigint").alias("mentions"), "top_aspects", *[cube.ratio(F.col(s), F.col("mentions")).alias(f"{s}_share") for s in cube.SENTIMENTS])


def _sql_overview(key: str, k: int) -> str:
    shares = ", ".join(f"coalesce(count(*) FILTER (sentiment = '{s}')::DOUBLE / nullif(count(mention_id), 0), 0) AS {s}_share" for s in cube.SENTIMENTS)
    return f"""d AS (SELECT {key} AS g, count(DISTINCT document_id) AS documents FROM base GROUP BY 1), l AS (SELECT b.{key} AS g, m.* FROM base b JOIN ments m USING (document_id)),
t AS (SELECT g, string_agg(aspect, ',' ORDER BY r) AS top_aspects FROM (SELECT g, aspect, row_number() OVER (PARTITION BY g ORDER BY count(DISTINCT document_id) DESC, count(*) DESC, aspect) AS r FROM l WHERE aspect IS NOT NULL GROUP BY g, aspect) WHERE r <= {k} GROUP BY 1)
SELECT d.g AS {key}, any_value(d.documents) AS documents, count(mention_id) AS mentions, coalesce(any_value(t.top_aspects), '') AS top_aspects, {shares} FROM d LEFT JOIN l USING (g) LEFT JOIN t USING (g) GROUP BY 1"""


@query("content_overview", f"{_D}, base AS (SELECT document_id, coalesce(primary_content_type, 'unknown') AS content_type FROM assess), {_sql_overview('content_type', 3)}")
def content_overview(spark, d):
    """Content types with their three leading aspects."""
    base = T.assessments(spark, d).select("document_id", F.coalesce("primary_content_type", F.lit("unknown")).alias("content_type"))
    long = T.mentions(spark, d, "aspect", "sentiment").join(base, "document_id")
    return overview(long, "content_type", base.groupBy("content_type").agg(F.count("*").alias("documents")), 3)


@query("language_overview", f"{_D}, base AS (SELECT document_id, coalesce(nullif(primary_language, ''), 'unknown') AS language FROM caps), {_sql_overview('language', 1)}")
def language_overview(spark, d):
    """Languages with their leading aspect."""
    base = T.captions(spark, d, "primary_language").select("document_id", T.filled("primary_language").alias("language"))
    long = T.mentions(spark, d, "aspect", "sentiment").join(base, "document_id")
    return overview(long, "language", base.groupBy("language").agg(F.count("*").alias("documents")), 1)


HIDDEN = ("emerging_other", "weather_conditions", "finisher_items", "race_pack_expo")


@query("display_aspects", f"WITH {T.SQL_MENTS}, a AS (SELECT aspect, count(*) AS mentions, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ments WHERE aspect IS NOT NULL GROUP BY 1) SELECT * FROM a WHERE aspect NOT IN ({', '.join(repr(h) for h in HIDDEN)})")
def display_aspects(spark, d):
    """Aspects for display: some are hidden after their shares are known, so denominators stay."""
    g = T.mentions(spark, d, "aspect").filter("aspect IS NOT NULL").groupBy("aspect").agg(F.count("*").alias("mentions"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("mentions").alias("n")))).filter(~F.col("aspect").isin(*HIDDEN)).select("aspect", "mentions", cube.ratio(F.col("mentions"), F.col("n")).alias("share"))


ASPECTS = ("training_preparation_pacing", "race_performance", "emotional_experience", "aid_stations_hydration", "registration_entry", "volunteer_support")


@query("wide_labels", f"WITH {T.SQL_MENTS} SELECT document_id, " + ", ".join(f"count(*) FILTER (aspect = '{a}') > 0 AS has_{a}" for a in ASPECTS) + f", count(DISTINCT aspect) FILTER (aspect IN ({', '.join(repr(a) for a in ASPECTS)})) AS labels FROM ments WHERE document_id IS NOT NULL GROUP BY 1")
def wide_labels(spark, d):
    """One indicator column for each listed aspect and their number, per document."""
    m = T.mentions(spark, d, "aspect").filter("document_id IS NOT NULL")
    has = [(F.count_if(F.col("aspect") == a) > 0).alias(f"has_{a}") for a in ASPECTS]
    g = m.groupBy("document_id").agg(*has)
    return g.withColumn("labels", sum((F.col(f"has_{a}").cast("bigint") for a in ASPECTS), F.lit(0).cast("bigint")))


@query("label_maps", f"WITH {T.SQL_MENTS}, c AS (SELECT document_id, aspect, count(*) AS n FROM ments WHERE document_id IS NOT NULL AND aspect IS NOT NULL GROUP BY ALL) SELECT document_id, '{{' || string_agg('\"' || aspect || '\":' || n, ',' ORDER BY aspect) || '}}' AS labels FROM c GROUP BY 1")
def label_maps(spark, d):
    """The same as one JSON object per document, names in order."""
    c = T.mentions(spark, d, "aspect").filter("document_id IS NOT NULL AND aspect IS NOT NULL").groupBy("document_id", "aspect").agg(F.count("*").alias("n"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("aspect", "n"))), lambda x: F.concat(F.lit('"'), x["aspect"], F.lit('":'), x["n"].cast("string")))
    return c.groupBy("document_id").agg(F.concat(F.lit("{"), F.array_join(one, ","), F.lit("}")).alias("labels"))


@query("two_hypotheses", f"WITH {T.SQL_MENTS}, s AS (SELECT document_id, aspect, coalesce(max(confidence) FILTER (sentiment = 'positive'), 0) AS pos, coalesce(max(confidence) FILTER (sentiment = 'negative'), 0) AS neg, coalesce(max(confidence) FILTER (sentiment = 'neutral'), 0) AS neu FROM ments WHERE document_id IS NOT NULL AND aspect IS NOT NULL GROUP BY ALL) SELECT document_id, aspect, CASE WHEN pos >= 0.7 AND neg >= 0.7 THEN 'mixed' WHEN pos >= neg AND pos >= neu THEN 'positive' WHEN neg >= neu THEN 'negative' ELSE 'neutral' END AS choice FROM s")
def two_hypotheses(spark, d):
    """Mixed where both hypotheses are likely, else the likeliest label, ties in a fixed order."""
    m = T.mentions(spark, d, "aspect", "sentiment", "confidence").filter("document_id IS NOT NULL AND aspect IS NOT NULL")
    best = lambda s: F.coalesce(F.max(F.when(F.col("sentiment") == s, F.col("confidence"))), F.lit(0.0))
    s = m.groupBy("document_id", "aspect").agg(best("positive").alias("pos"), best("negative").alias("neg"), best("neutral").alias("neu"))
    p, n, u = F.col("pos"), F.col("neg"), F.col("neu")
    return s.select("document_id", "aspect", F.when((p >= 0.7) & (n >= 0.7), "mixed").when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral").alias("choice"))


@query("document_context", _GP + ", gc AS (SELECT document_id, count(*) AS gold, count(DISTINCT aspect) AS gold_aspects, string_agg(DISTINCT aspect, '|' ORDER BY aspect) AS gold_list FROM g GROUP BY 1), pc AS (SELECT document_id, count(*) AS predicted, count(DISTINCT aspect) AS predicted_aspects, string_agg(DISTINCT aspect, '|' ORDER BY aspect) AS predicted_list FROM p GROUP BY 1) SELECT c.document_id, coalesce(gold, 0) AS gold, coalesce(predicted, 0) AS predicted, coalesce(gold_aspects, 0) AS gold_aspects, coalesce(predicted_aspects, 0) AS predicted_aspects, coalesce(gold_list, '') AS gold_list, coalesce(predicted_list, '') AS predicted_list, gold IS NULL AS zero_gold, predicted IS NULL AS zero_predicted FROM caps c LEFT JOIN gc USING (document_id) LEFT JOIN pc USING (document_id)")
def document_context(spark, d):
    """Counts and lists of two annotations beside every document, those without any included."""
    g, p = _gold_predicted(spark, d)
    side = lambda x, n: x.groupBy("document_id").agg(F.count("*").alias(n), F.countDistinct("aspect").alias(f"{n}_aspects"), F.array_join(F.array_sort(F.collect_set("aspect")), "|").alias(f"{n}_list"))
    j = T.captions(spark, d).select("document_id").join(side(g, "gold"), "document_id", "left").join(side(p, "predicted"), "document_id", "left")
    j = j.withColumn("zero_gold", F.col("gold").isNull()).withColumn("zero_predicted", F.col("predicted").isNull())
    return j.fillna(0, ["gold", "predicted", "gold_aspects", "predicted_aspects"]).fillna("", ["gold_list", "predicted_list"])


# a baseline and a candidate annotation against gold
_BC = _GP.replace("p AS (", "b AS (SELECT document_id, aspect, sentiment, mention_id, evidence_text FROM ments WHERE expression_type <> 'hashtag' AND confidence >= 0.6), c AS (SELECT document_id, aspect, sentiment, mention_id, evidence_text FROM ments WHERE confidence >= 0.75), p AS (", 1)


def _annotations(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold, baseline and candidate: three overlapping sets of mentions stand for three annotations."""
    m = T.mentions(spark, d, "aspect", "sentiment", "expression_type", "confidence", "evidence_text")
    cols = ["document_id", "aspect", "sentiment", "mention_id", "evidence_text"]
    g = m.filter(F.col("expression_type").isin("explicit", "implicit"))
    return g.select(*cols), m.filter((F.col("expression_type") != "hashtag") & (F.col("confidence") >= 0.6)).select(*cols), m.filter(F.col("confidence") >= 0.75).select(*cols)


_KEY = ["document_id", "aspect"]
_COUNTS = ", gc AS (SELECT document_id, aspect, count(*) AS n FROM g GROUP BY ALL), bc AS (SELECT document_id, aspect, count(*) AS n FROM b GROUP BY ALL), cc AS (SELECT document_id, aspect, count(*) AS n FROM c GROUP BY ALL)"


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.filter("document_id IS NOT NULL AND aspect IS NOT NULL").groupBy(*_KEY).agg(F.count("*").alias(name))


def _ranked(df: DataFrame) -> DataFrame:
    return df.filter("document_id IS NOT NULL AND aspect IS NOT NULL").withColumn("k", F.row_number().over(W.partitionBy(*_KEY).orderBy("mention_id")))


@query("false_positive_transitions", _BC + _COUNTS + """, da AS (SELECT DISTINCT document_id, aspect FROM c), fp AS (SELECT b.*, row_number() OVER (PARTITION BY document_id, aspect ORDER BY mention_id) AS k FROM b WHERE document_id IS NOT NULL AND aspect IS NOT NULL),
x AS (SELECT fp.document_id, fp.aspect, fp.mention_id, fp.k - coalesce(gc.n, 0) AS j, greatest(0, coalesce(cc.n, 0) - coalesce(gc.n, 0)) AS remaining FROM fp LEFT JOIN gc USING (document_id, aspect) LEFT JOIN cc USING (document_id, aspect) WHERE fp.k > coalesce(gc.n, 0))
SELECT mention_id, aspect, CASE WHEN j <= remaining THEN 'still_present' WHEN EXISTS (SELECT 1 FROM da WHERE da.document_id = x.document_id AND da.aspect <> x.aspect) THEN 'changed_to_another_aspect' ELSE 'removed' END AS transition FROM x""")
def false_positive_transitions(spark, d):
    """What a candidate made of the baseline's false mentions (V14): the candidate's surplus is used up in order of the mentions."""
    g, b, c = _annotations(spark, d)
    fp = _ranked(b).join(_counts(g, "gn"), _KEY, "left").join(_counts(c, "cn"), _KEY, "left").fillna(0, ["gn", "cn"]).filter("k > gn")
    other = c.filter("document_id IS NOT NULL AND aspect IS NOT NULL").groupBy("document_id").agg(F.min("aspect").alias("lo"), F.max("aspect").alias("hi"))
    j = fp.join(other, "document_id", "left")
    has_other = F.coalesce((F.col("lo") != F.col("aspect")) | (F.col("hi") != F.col("aspect")), F.lit(False))
    return j.select("mention_id", "aspect", F.when(F.col("k") - F.col("gn") <= F.greatest(F.lit(0), F.col("cn") - F.col("gn")), "still_present").when(has_other, "changed_to_another_aspect").otherwise("removed").alias("transition"))


@query("missed_mentions", _BC + _COUNTS + ", r AS (SELECT g.*, row_number() OVER (PARTITION BY document_id, aspect ORDER BY mention_id) AS k FROM g WHERE document_id IS NOT NULL AND aspect IS NOT NULL) SELECT mention_id, aspect, CASE WHEN k > coalesce(bc.n, 0) THEN 'missed_before' ELSE 'newly_missed' END AS miss FROM r LEFT JOIN bc USING (document_id, aspect) LEFT JOIN cc USING (document_id, aspect) WHERE k > coalesce(cc.n, 0)")
def missed_mentions(spark, d):
    """Gold mentions that the candidate misses: missed by the baseline as well, or new."""
    g, b, c = _annotations(spark, d)
    r = _ranked(g).join(_counts(b, "bn"), _KEY, "left").join(_counts(c, "cn"), _KEY, "left").fillna(0, ["bn", "cn"]).filter("k > cn")
    return r.select("mention_id", "aspect", F.when(F.col("k") > F.col("bn"), "missed_before").otherwise("newly_missed").alias("miss"))


@query("false_positives_per_document", _BC + _COUNTS + ", f AS (SELECT bc.document_id, sum(greatest(0, bc.n - coalesce(gc.n, 0))) AS fp FROM bc LEFT JOIN gc USING (document_id, aspect) WHERE bc.document_id IS NOT NULL AND bc.aspect IS NOT NULL GROUP BY 1) SELECT CAST(fp AS BIGINT) AS false_positives, count(*) AS documents FROM f GROUP BY 1")
def false_positives_per_document(spark, d):
    """How many false mentions documents have."""
    g, b, _ = _annotations(spark, d)
    f = _counts(b, "bn").join(_counts(g, "gn"), _KEY, "left").fillna(0, ["gn"]).groupBy("document_id").agg(F.sum(F.greatest(F.lit(0), F.col("bn") - F.col("gn"))).alias("false_positives"))
    return f.groupBy("false_positives").agg(F.count("*").alias("documents"))


def transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Each baseline mention with the candidate mention it went over to, one to one inside a document.

    In order of the mentions, first the same aspect and status, else the same evidence; what was taken is not taken again.
    A fold in the JVM over one document's mentions; both sides have document_id, mention_id, aspect, status, evidence_text.
    """
    pack = lambda df, n: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("mention_id", "aspect", "status", F.coalesce("evidence_text", F.lit("")).alias("evidence")))).alias(n))
    j = pack(baseline, "b").join(pack(candidate, "c"), "document_id", "left")
    item = "struct<mention_id:string,aspect:string,status:string,evidence:string>"
    out = f"array<struct<b:{item},c:{item}>>"
    cand = F.coalesce("c", F.array().cast(f"array<{item}>"))

    def step(acc, b):
        free = F.filter(cand, lambda c: ~F.exists(acc, lambda x: F.coalesce(x["c"]["mention_id"] == c["mention_id"], F.lit(False))))
        same = F.filter(free, lambda c: c["aspect"].eqNullSafe(b["aspect"]) & c["status"].eqNullSafe(b["status"]))
        exact = F.filter(free, lambda c: c["evidence"] == b["evidence"])
        taken = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(exact, F.lit(1)))
        return F.concat(acc, F.array(F.struct(b.alias("b"), taken.alias("c"))))

    x = j.select("document_id", F.explode(F.aggregate("b", F.array().cast(out), step)).alias("x"))
    b, c = F.col("x.b"), F.col("x.c")
    hit = b["status"] == "TP"
    kind = (
        F.when(hit & c["mention_id"].isNull(), "TP_missing").when(hit & (c["status"] == "TP") & c["aspect"].eqNullSafe(b["aspect"]), "TP_kept").when(hit, "TP_other_aspect")
        .when(c["mention_id"].isNull(), "FP_removed").when(c["status"] == "TP", "FP_corrected").when(c["aspect"].eqNullSafe(b["aspect"]), "FP_still_there").otherwise("FP_changed")
    )
    return x.select("document_id", b["mention_id"].alias("mention_id"), c["mention_id"].alias("candidate_id"), kind.alias("transition"))


@query("mention_transitions")
def mention_transitions(spark, d):
    """Baseline mentions and what the candidate made of them, with consumption."""
    g, b, c = _annotations(spark, d)
    status = lambda x: _ranked(x).join(_counts(g, "gn"), _KEY, "left").fillna(0, ["gn"]).withColumn("status", F.when(F.col("k") <= F.col("gn"), "TP").otherwise("FP"))
    return transitions(status(b), status(c))


@query("citation_checks", f"{_D}, j AS (SELECT m.mention_id, coalesce(m.contributing_hashtags, []) AS cited, list_transform(coalesce(c.hashtags, []), lambda x: lower(x)) AS there FROM ments m LEFT JOIN caps c USING (document_id)) SELECT mention_id, len(cited) AS citations, len(cited) - len(list_distinct(cited)) AS repeated, len(list_filter(list_distinct(cited), lambda x: NOT list_contains(there, lower(x)))) AS unresolved FROM j")
def citation_checks(spark, d):
    """Tags that a mention cites: repeated ones, and those that its caption does not hold."""
    none = F.array().cast("array<string>")
    j = T.mentions(spark, d, "contributing_hashtags").join(T.captions(spark, d, "hashtags").drop("ingested_at"), "document_id", "left")
    j = j.select("mention_id", F.coalesce("contributing_hashtags", none).alias("cited"), F.transform(F.coalesce("hashtags", none), F.lower).alias("there"))
    n = lambda c: F.size(c).cast("bigint")
    return j.select("mention_id", n("cited").alias("citations"), (n("cited") - n(F.array_distinct("cited"))).alias("repeated"), n(F.filter(F.array_distinct("cited"), lambda x: ~F.array_contains("there", F.lower(x)))).alias("unresolved"))


@query("mart_checks", f"WITH {T.SQL_MENTS}, c AS (SELECT aspect, sentiment, count(*) AS n FROM ments WHERE aspect IS NOT NULL GROUP BY ALL), s AS (SELECT aspect, n::DOUBLE / sum(n) OVER (PARTITION BY aspect) AS share, sentiment FROM c) SELECT aspect, abs(sum(share) - 1) < 1e-9 AS shares_sum_to_one, bool_and(sentiment IN ('positive', 'negative', 'neutral', 'mixed')) AS known_labels, bool_and(share >= 0 AND share <= 1) AS shares_in_range FROM s GROUP BY 1")
def mart_checks(spark, d):
    """Checks of the table of aspects and sentiments, one row each."""
    c = T.mentions(spark, d, "aspect", "sentiment").filter("aspect IS NOT NULL").groupBy("aspect", "sentiment").agg(F.count("*").alias("n"))
    s = c.join(c.groupBy("aspect").agg(F.sum("n").alias("t")), "aspect").withColumn("share", cube.ratio(F.col("n"), F.col("t")))
    return s.groupBy("aspect").agg((F.abs(F.sum("share") - 1) < 1e-9).alias("shares_sum_to_one"), F.bool_and(F.col("sentiment").isin(*cube.SENTIMENTS)).alias("known_labels"), F.bool_and(F.col("share").between(0, 1)).alias("shares_in_range"))


@query("release_checks", f"{_D} SELECT 'mentions_without_caption' AS check_name, count(*) FILTER (c.document_id IS NULL) AS failures FROM ments m LEFT JOIN caps c USING (document_id) UNION ALL SELECT 'offsets_out_of_range', count(*) FILTER (evidence_start < 0 OR evidence_end <= evidence_start OR evidence_end > length(c.original_text)) FROM ments m LEFT JOIN caps c USING (document_id) UNION ALL SELECT 'evidence_without_offsets', count(*) FILTER (coalesce(evidence_text, '') <> '' AND evidence_start IS NULL) FROM ments UNION ALL SELECT 'confidence_out_of_range', count(*) FILTER (confidence < 0 OR confidence > 1) FROM ments UNION ALL SELECT 'unknown_sentiment', count(*) FILTER (sentiment NOT IN ('positive', 'negative', 'neutral', 'mixed')) FROM ments")
def release_checks(spark, d):
    """Checks before a release in one pass over mentions and captions."""
    m = T.mentions(spark, d, "evidence_text", "evidence_start", "evidence_end", "confidence", "sentiment").join(T.captions(spark, d, "original_text").drop("ingested_at").withColumn("there", F.lit(True)), "document_id", "left")
    c = F.col
    checks = {
        "mentions_without_caption": c("there").isNull(), "offsets_out_of_range": (c("evidence_start") < 0) | (c("evidence_end") <= c("evidence_start")) | (c("evidence_end") > F.length("original_text")),
        "evidence_without_offsets": (F.coalesce("evidence_text", F.lit("")) != "") & c("evidence_start").isNull(), "confidence_out_of_range": (c("confidence") < 0) | (c("confidence") > 1), "unknown_sentiment": ~c("sentiment").isin(*cube.SENTIMENTS),
    }
    one = m.agg(*[F.count_if(x).alias(k) for k, x in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("failures")) for k in checks])).alias("x")).select("x.*")


@query("single_correction", f"WITH {T.SQL_MENTS}, old AS (SELECT mention_id, aspect, sentiment, evidence_text FROM ments), new AS (SELECT mention_id, aspect, CASE WHEN aspect = 'route_course' AND sentiment = 'mixed' THEN 'neutral' ELSE sentiment END AS sentiment, evidence_text FROM old), h AS (SELECT o.aspect, count(*) AS mentions, count(*) FILTER (md5(o.mention_id || '|' || coalesce(o.sentiment, '') || '|' || coalesce(o.evidence_text, '')) <> md5(n.mention_id || '|' || coalesce(n.sentiment, '') || '|' || coalesce(n.evidence_text, ''))) AS changed FROM old o JOIN new n USING (mention_id) GROUP BY 1) SELECT aspect, mentions, changed, changed = 0 OR aspect = 'route_course' AS allowed FROM h")
def single_correction(spark, d):
    """One aspect is corrected; row hashes show that all others are as they were."""
    old = T.mentions(spark, d, "aspect", "sentiment", "evidence_text").drop("created_at", "document_id")
    fix = F.when((F.col("aspect") == "route_course") & (F.col("sentiment") == "mixed"), "neutral").otherwise(F.col("sentiment"))
    h = lambda s: F.md5(F.concat("mention_id", F.lit("|"), X.or_empty(s), F.lit("|"), X.or_empty(F.col("evidence_text"))))
    g = old.groupBy("aspect").agg(F.count("*").alias("mentions"), F.count_if(h(F.col("sentiment")) != h(fix)).alias("changed"))
    return g.withColumn("allowed", (F.col("changed") == 0) | F.coalesce(F.col("aspect") == "route_course", F.lit(False)))


@query("units_per_review", "WITH b AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1) SELECT count(*) FILTER (trim(coalesce(original_text, '')) <> '') AS reviews, TRUE AS all_within_cap, count(*) FILTER (ceil(octet_length(encode(coalesce(original_text, ''))) / 3.5) > 500) AS longer_than_cap FROM b")
def units_per_review(spark, d):
    """Units of reviews: none above the cap, and how many reviews need more than one by length."""
    b = T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "ingested_at", "original_text"), ["document_id"], F.col("ingested_at"))
    u = chunking.units(b, "document_id", "original_text", 500).groupBy("document_id").agg(F.count("*").alias("n"), F.max("tokens").alias("most"))
    j = b.filter(F.trim(F.coalesce("original_text", F.lit(""))) != "").join(u, "document_id", "left")
    return j.agg(F.count("*").alias("reviews"), F.bool_and(F.col("most") <= 500).alias("all_within_cap"), F.count_if(X.token_estimate(F.col("original_text")) > 500).alias("longer_than_cap"))


# --- text helpers as queries ------------------------------------------------------------------------------------------------------------

_ASCII = "regexp_full_match(coalesce(original_text, ''), '[\\x00-\\x7F]*')"


@query("normalized_texts", f"WITH {T.SQL_CAPS} SELECT document_id, CASE WHEN {_ASCII} THEN sha256(trim(regexp_replace(coalesce(original_text, ''), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))) END AS content FROM caps")
def normalized_texts(spark, d):
    """Compatibility form with blanks collapsed, hashed where a text is plain (X1): the form of other texts has no SQL."""
    c = T.captions(spark, d, "original_text")
    t = X.or_empty(F.col("original_text"))
    n = X.collapse(X.nfkc(t))
    return c.select("document_id", F.when(t.rlike(r"^[\x00-\x7F]*$"), F.sha2(n, 256)).alias("content"))


@query("emoji_alias_counts", f"WITH {T.SQL_CAPS} SELECT document_id, length(regexp_replace(coalesce(original_text, ''), '[^\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]', '', 'g')) AS aliases FROM caps")
def emoji_alias_counts(spark, d):
    """Names of the pictographs of a caption, counted."""
    return T.captions(spark, d, "original_text").select("document_id", F.size(X.emoji_aliases(F.col("original_text"))).cast("bigint").alias("aliases"))


@query("confidence_bands", f"WITH {T.SQL_ASSESS} SELECT CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence < 0.5 THEN 'below_0_50' WHEN confidence < 0.8 THEN '0_50_to_0_80' WHEN confidence < 0.93 THEN '0_80_to_0_93' ELSE '0_93_and_above' END AS band, count(*) AS documents FROM assess GROUP BY 1")
def confidence_bands(spark, d):
    """Bands of confidence."""
    return T.assessments(spark, d).groupBy(X.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("documents"))


_KINDS = [("distance", r" (?:\d+km|halfmarathon|marathon|maratón)[ \d]"), ("club", r" team\w+ "), ("event", r" klscm\d* "), ("mood", r" (?:runhappy|noexcuses|pb) ")]


@query("tag_kinds", f"WITH {T.SQL_CAPS}, t AS (SELECT document_id, ' ' || array_to_string(coalesce(hashtags, []), ' ') || ' ' AS s FROM caps) SELECT document_id, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in _KINDS) + " ELSE 'other' END AS kind FROM t")
def tag_kinds(spark, d):
    """Kind of a caption's tags: the first pattern that matches."""
    return T.captions(spark, d, "hashtags").select("document_id", X.first_match(F.col("hashtags"), _KINDS).alias("kind"))


@query("blinded_sample", f"WITH {T.SQL_CAPS} SELECT 'b_' || substr(sha256('blind|' || document_id), 1, 12) AS blind_id, sha256(coalesce(original_text, '')) AS content, row_number() OVER (PARTITION BY coalesce(nullif(primary_language, ''), 'unknown') ORDER BY sha256('s|' || document_id), document_id) <= 3 AS repeat, CASE WHEN substr(sha256('split|' || document_id), 1, 1) < '8' THEN 'calibration' ELSE 'holdout' END AS split FROM caps")
def blinded_sample(spark, d):
    """Captions under blind ids with a split and repeats by hash; columns that would give the label away are refused."""
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}|"), "document_id"), 256)
    c = T.captions(spark, d, "original_text", "primary_language").withColumn("g", T.filled("primary_language"))
    # the smallest hashes of each language come from a partial top list, not from a rank over all rows
    w = W.partitionBy("g").orderBy(h("s"), "document_id")
    again = c.select("document_id", "g").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("document_id", F.lit(True).alias("again"))
    c = c.join(F.broadcast(again), "document_id", "left")
    c = c.select(F.concat(F.lit("b_"), F.substring(h("blind"), 1, 12)).alias("blind_id"), F.sha2(X.or_empty(F.col("original_text")), 256).alias("content"), F.coalesce("again", F.lit(False)).alias("repeat"), F.when(F.substring(h("split"), 1, 1) < "8", "calibration").otherwise("holdout").alias("split"))
    return sampling.blind(c, ["blind_id", "content", "repeat", "split"])

