"""Aspect, sentiment, year, topic and language cubes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators import cube
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
_DOCS = "(SELECT count(*) FROM caps)"
_BEAR = "(SELECT count(DISTINCT document_id) FROM ments WHERE document_id IS NOT NULL)"
_SENTS = "(SELECT unnest(['positive','negative','neutral','mixed']) AS sentiment)"
_ASPECTS = "(SELECT DISTINCT aspect FROM ments WHERE aspect IS NOT NULL)"


def _totals(caps, ments):
    """Both document denominators as one row."""
    return caps.agg(F.count("*").alias("all_docs")).crossJoin(ments.filter("document_id IS NOT NULL").agg(F.countDistinct("document_id").alias("bearing_docs")))


@query(
    "aspect_prevalence",
    f"""{_D}, g AS (SELECT aspect, count(*) AS mentions, count(DISTINCT document_id) AS affected_documents FROM ments WHERE aspect IS NOT NULL GROUP BY aspect)
SELECT aspect, mentions, affected_documents, affected_documents::DOUBLE / {_DOCS} AS prevalence_all, affected_documents::DOUBLE / {_BEAR} AS prevalence_bearing,
mentions::DOUBLE / affected_documents AS mentions_per_affected, mentions::DOUBLE / (SELECT sum(mentions) FROM g) AS mention_share,
CASE WHEN affected_documents < 30 THEN 'very_low' WHEN affected_documents < 100 THEN 'low' WHEN affected_documents < 500 THEN 'moderate' ELSE 'high' END AS support FROM g""",
)
def aspect_prevalence(spark, d):
    m = T.mentions(spark, d, "aspect")
    t = _totals(T.captions(spark, d), m)
    g = m.filter("aspect IS NOT NULL").groupBy("aspect").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("affected_documents")).crossJoin(F.broadcast(t))
    total = F.sum("mentions").over(W.partitionBy())  # one row per aspect
    return g.select(
        "aspect", "mentions", "affected_documents",
        cube.ratio(F.col("affected_documents"), F.col("all_docs")).alias("prevalence_all"),
        cube.ratio(F.col("affected_documents"), F.col("bearing_docs")).alias("prevalence_bearing"),
        cube.ratio(F.col("mentions"), F.col("affected_documents")).alias("mentions_per_affected"), cube.ratio(F.col("mentions"), total).alias("mention_share"), cube.support_band(F.col("affected_documents")).alias("support"),
    )


@query(
    "corpus_counts",
    f"""{_D}, per AS (SELECT c.document_id, count(m.mention_id) AS n FROM caps c LEFT JOIN ments m USING (document_id) GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (n > 0) AS with_mentions, count(*) FILTER (n = 0) AS without_mentions, CAST(sum(n) AS BIGINT) AS mentions, avg(n) AS mean_mentions, median(n) AS median_mentions, max(n) AS most_mentions FROM per""",
)
def corpus_counts(spark, d):
    """Documents with and without mentions in one pass; documents without any stay in (A1, A3)."""
    per = T.captions(spark, d).select("document_id").join(T.mentions(spark, d).groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count("*").alias("documents"), F.count_if(F.col("n") > 0).alias("with_mentions"), F.count_if(F.col("n") == 0).alias("without_mentions"), F.sum("n").alias("mentions"), F.avg("n").alias("mean_mentions"), F.median("n").alias("median_mentions"), F.max("n").alias("most_mentions"))


@query("sentiment_overall", f"{_D} SELECT s.sentiment, count(m.mention_id) AS mentions, count(m.mention_id)::DOUBLE / (SELECT count(*) FROM ments) AS share FROM {_SENTS} s LEFT JOIN ments m USING (sentiment) GROUP BY 1")
def sentiment_overall(spark, d):
    m = T.mentions(spark, d, "sentiment")
    cells = m.groupBy("sentiment").agg(F.count("*").alias("mentions"))
    total = m.agg(F.count("*").alias("t"))
    g = cube.densify(cube.dimension(spark, "sentiment", cube.SENTIMENTS), cells, ["sentiment"], ["mentions"]).crossJoin(F.broadcast(total))
    return g.select("sentiment", "mentions", cube.ratio(F.col("mentions"), F.col("t")).alias("share"))


def _aspects(m):
    return m.filter("aspect IS NOT NULL").select("aspect").distinct()


@query(
    "aspect_sentiment",
    f"""{_D} SELECT a.aspect, s.sentiment, count(m.mention_id) AS mentions, count(DISTINCT m.document_id) AS affected_documents,
coalesce(count(m.mention_id)::DOUBLE / nullif(sum(count(m.mention_id)) OVER (PARTITION BY a.aspect), 0), 0) AS share
FROM {_ASPECTS} a CROSS JOIN {_SENTS} s LEFT JOIN ments m ON m.aspect = a.aspect AND m.sentiment = s.sentiment GROUP BY 1, 2""",
)
def aspect_sentiment(spark, d):
    """Dense aspect by sentiment with shares inside the aspect."""
    m = T.mentions(spark, d, "aspect", "sentiment")
    cells = m.groupBy("aspect", "sentiment").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("affected_documents"))
    g = cube.densify(cube.dense_grid(_aspects(m), cube.dimension(spark, "sentiment", cube.SENTIMENTS)), cells, ["aspect", "sentiment"], ["mentions", "affected_documents"])
    return g.withColumn("share", cube.ratio(F.col("mentions"), F.sum("mentions").over(W.partitionBy("aspect"))))


@query(
    "year_aspect_sentiment",
    f"""{_D}, ys AS (SELECT DISTINCT event_year FROM ments WHERE event_year IS NOT NULL),
cells AS (SELECT event_year, aspect, sentiment, count(*) AS n, count(DISTINCT document_id) AS docs FROM ments GROUP BY ALL),
yd AS (SELECT event_year, count(DISTINCT document_id) AS year_docs, count(*) AS year_mentions FROM ments WHERE event_year IS NOT NULL GROUP BY 1)
SELECT y.event_year, a.aspect, s.sentiment, coalesce(n, 0) AS mentions, coalesce(docs, 0) AS affected_documents, coalesce(n, 0)::DOUBLE / year_mentions AS share_of_year_mentions, coalesce(docs, 0)::DOUBLE / year_docs AS share_of_year_documents,
coalesce(coalesce(n, 0)::DOUBLE / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY y.event_year, a.aspect), 0), 0) AS share_in_aspect
FROM ys y CROSS JOIN {_ASPECTS} a CROSS JOIN {_SENTS} s LEFT JOIN cells c ON c.event_year = y.event_year AND c.aspect = a.aspect AND c.sentiment = s.sentiment JOIN yd ON yd.event_year = y.event_year""",
)
def year_aspect_sentiment(spark, d):
    """Three denominators side by side: the year's mentions, the year's documents, the aspect in the year."""
    m = T.mentions(spark, d, "aspect", "sentiment", "event_year")
    cells = m.groupBy("event_year", "aspect", "sentiment").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("affected_documents"))
    year = m.filter("event_year IS NOT NULL").groupBy("event_year").agg(F.countDistinct("document_id").alias("year_docs"), F.count("*").alias("year_mentions"))
    grid = cube.dense_grid(year.select("event_year"), _aspects(m), cube.dimension(spark, "sentiment", cube.SENTIMENTS))
    g = cube.densify(grid, cells, ["event_year", "aspect", "sentiment"], ["mentions", "affected_documents"]).join(F.broadcast(year), "event_year")
    return g.select(
        "event_year", "aspect", "sentiment", "mentions", "affected_documents",
        cube.ratio(F.col("mentions"), F.col("year_mentions")).alias("share_of_year_mentions"),
        cube.ratio(F.col("affected_documents"), F.col("year_docs")).alias("share_of_year_documents"),
        cube.ratio(F.col("mentions"), F.sum("mentions").over(W.partitionBy("event_year", "aspect"))).alias("share_in_aspect"),
    )


@query(
    "language_aspect_sentiment",
    f"""{_D}, m AS (SELECT *, coalesce(nullif(mention_language, ''), 'unknown') AS lang FROM ments), ls AS (SELECT lang, count(DISTINCT document_id) AS docs, count(*) AS n FROM m GROUP BY 1),
cells AS (SELECT lang, aspect, sentiment, count(*) AS c FROM m GROUP BY ALL)
SELECT ls.lang AS language, a.aspect, s.sentiment, coalesce(c, 0) AS mentions, coalesce(c, 0)::DOUBLE / n AS share_of_language, CASE WHEN docs < 30 THEN 'very_low' WHEN docs < 100 THEN 'low' WHEN docs < 500 THEN 'moderate' ELSE 'high' END AS support
FROM ls CROSS JOIN {_ASPECTS} a CROSS JOIN {_SENTS} s LEFT JOIN cells ON cells.lang = ls.lang AND cells.aspect = a.aspect AND cells.sentiment = s.sentiment""",
)
def language_aspect_sentiment(spark, d):
    """Languages with a support band; a missing language is one of its own."""
    m = T.mentions(spark, d, "aspect", "sentiment", "mention_language").withColumn("language", T.filled("mention_language"))
    lang = m.groupBy("language").agg(F.countDistinct("document_id").alias("docs"), F.count("*").alias("n"))
    cells = m.groupBy("language", "aspect", "sentiment").agg(F.count("*").alias("mentions"))
    grid = cube.dense_grid(lang.select("language"), _aspects(m), cube.dimension(spark, "sentiment", cube.SENTIMENTS))
    g = cube.densify(grid, cells, ["language", "aspect", "sentiment"], ["mentions"]).join(F.broadcast(lang), "language")
    return g.select("language", "aspect", "sentiment", "mentions", cube.ratio(F.col("mentions"), F.col("n")).alias("share_of_language"), cube.support_band(F.col("docs")).alias("support"))


@query(
    "content_aspect_sentiment",
    f"""{_D}, {T.SQL_ASSESS}, j AS (SELECT m.*, coalesce(a.primary_content_type, 'unassessed') AS content_type FROM ments m LEFT JOIN assess a USING (document_id))
SELECT content_type, aspect, count(*) AS mentions, count(DISTINCT document_id) AS affected_documents, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'mixed') AS mixed FROM j WHERE aspect IS NOT NULL GROUP BY ALL""",
)
def content_aspect_sentiment(spark, d):
    """Aspects by the group a document belongs to, sentiment in wide form."""
    m = T.mentions(spark, d, "aspect", "sentiment").filter("aspect IS NOT NULL")
    j = m.join(T.assessments(spark, d).select("document_id", "primary_content_type"), "document_id", "left").withColumn("content_type", F.coalesce("primary_content_type", F.lit("unassessed")))
    return j.groupBy("content_type", "aspect").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("affected_documents"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in cube.SENTIMENTS])


@query("mentions_by_keys", f"{_D} SELECT event_year, mention_language, expression_type, count(*) AS mentions, count(DISTINCT document_id) AS documents, round(avg(confidence), 8) AS mean_confidence FROM ments GROUP BY ALL")
def mentions_by_keys(spark, d):
    """Arbitrary keys, NULL keys kept as groups (A10)."""
    m = T.mentions(spark, d, "event_year", "mention_language", "expression_type", "confidence")
    return m.groupBy("event_year", "mention_language", "expression_type").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"), F.round(F.avg("confidence"), 8).alias("mean_confidence"))


@query(
    "theme_summary",
    f"""{_D}, dl AS (SELECT aspect, target, document_id, CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment) ELSE 'mixed' END AS s FROM ments WHERE target IS NOT NULL GROUP BY ALL), ad AS (SELECT aspect, count(DISTINCT document_id) AS n FROM ments GROUP BY 1),
sup AS (SELECT aspect, target, count(*) AS support_mentions, string_agg(DISTINCT CAST(event_year AS VARCHAR), '|' ORDER BY CAST(event_year AS VARCHAR)) AS years FROM ments WHERE target IS NOT NULL GROUP BY ALL)
SELECT aspect, target, support_mentions, count(*) AS support_documents, count(*)::DOUBLE / any_value(ad.n) AS share_of_aspect, count(*)::DOUBLE / {_DOCS} AS share_of_all, years, count(*) FILTER (s = 'positive') AS positive, count(*) FILTER (s = 'negative') AS negative, count(*) FILTER (s = 'neutral') AS neutral, count(*) FILTER (s = 'mixed') AS mixed, count(*) < 10 AS low_support
FROM dl JOIN sup USING (aspect, target) JOIN ad USING (aspect) GROUP BY aspect, target, support_mentions, years""",
)
def theme_summary(spark, d):
    """Themes (target inside aspect): support, shares of two denominators, years and document-level sentiment."""
    m = T.mentions(spark, d, "aspect", "target", "sentiment", "event_year")
    t = m.filter("target IS NOT NULL")
    docs = cube.roll_up(t, "document_id", ["aspect", "target"], "sentiment")
    per = docs.groupBy("aspect", "target").agg(F.sum("mentions").alias("support_mentions"), F.count("*").alias("support_documents"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in cube.SENTIMENTS])
    years = t.groupBy("aspect", "target").agg(F.array_join(F.array_sort(F.collect_set(F.col("event_year").cast("string"))), "|").alias("years"))
    aspect = m.groupBy("aspect").agg(F.countDistinct("document_id").alias("aspect_docs"))
    total = T.captions(spark, d).agg(F.count("*").alias("all_docs"))
    j = per.join(years, ["aspect", "target"]).join(F.broadcast(aspect), "aspect").crossJoin(F.broadcast(total))
    return j.select("aspect", "target", "support_mentions", "support_documents", cube.ratio(F.col("support_documents"), F.col("aspect_docs")).alias("share_of_aspect"), cube.ratio(F.col("support_documents"), F.col("all_docs")).alias("share_of_all"), F.nullif("years", F.lit("")).alias("years"), *cube.SENTIMENTS, (F.col("support_documents") < 10).alias("low_support"))


@query(
    "theme_year_prevalence",
    f"""{_D} SELECT t.event_year, t.aspect, t.target, t.docs AS documents, t.docs::DOUBLE / a.docs AS prevalence FROM (SELECT event_year, aspect, target, count(DISTINCT document_id) AS docs FROM ments WHERE event_year IS NOT NULL AND target IS NOT NULL GROUP BY ALL) t
JOIN (SELECT event_year, aspect, count(DISTINCT document_id) AS docs FROM ments WHERE event_year IS NOT NULL GROUP BY ALL) a USING (event_year, aspect)""",
)
def theme_year_prevalence(spark, d):
    """Theme in year over the aspect in the same year."""
    m = T.mentions(spark, d, "aspect", "target", "event_year").filter("event_year IS NOT NULL")
    t = m.filter("target IS NOT NULL").groupBy("event_year", "aspect", "target").agg(F.countDistinct("document_id").alias("documents"))
    a = m.groupBy("event_year", "aspect").agg(F.countDistinct("document_id").alias("n"))
    return t.join(F.broadcast(a), ["event_year", "aspect"]).select("event_year", "aspect", "target", "documents", cube.ratio(F.col("documents"), F.col("n")).alias("prevalence"))


@query(
    "length_profile",
    "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS documents, avg(n_chars) AS mean_chars, median(n_chars) AS median_chars, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, count(*) FILTER (n_chars > 1000) AS over_1000, count(*) FILTER (n_chars > 3000) AS over_3000 FROM documents GROUP BY 1",
)
def length_profile(spark, d):
    """Exact percentiles and over-threshold counts."""
    n = F.col("n_chars")
    return T.read(spark, d, "documents", "source", "n_chars").groupBy(T.filled("source").alias("source")).agg(
        F.count("*").alias("documents"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"), F.percentile(n, 0.25).alias("p25"), F.percentile(n, 0.9).alias("p90"), F.percentile(n, 0.99).alias("p99"), F.count_if(n > 1000).alias("over_1000"), F.count_if(n > 3000).alias("over_3000")
    )


@query(
    "value_counts_json",
    "SELECT source, '{' || string_agg('\"' || l || '\":' || n, ',' ORDER BY n DESC, l) || '}' AS counts FROM (SELECT coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(lang, ''), 'unknown') AS l, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
)
def value_counts_json(spark, d):
    """Counts of values as a JSON object, most frequent first."""
    n = T.read(spark, d, "documents", "source", "lang").groupBy(T.filled("source").alias("source"), T.filled("lang").alias("l")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "l", "n")))
    return n.groupBy("source").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["l"], x["n"])))).alias("counts"))


@query(
    "top_aspects_per_language",
    f"""{_D} SELECT language, rank, aspect, mentions FROM (SELECT coalesce(nullif(mention_language, ''), 'unknown') AS language, aspect, count(*) AS mentions, row_number() OVER (PARTITION BY coalesce(nullif(mention_language, ''), 'unknown') ORDER BY count(*) DESC, aspect) AS rank FROM ments GROUP BY 1, 2) WHERE rank <= 3""",
)
def top_aspects_per_language(spark, d):
    """Top k of a group with a full tie-break."""
    g = T.mentions(spark, d, "aspect", "mention_language").groupBy(T.filled("mention_language").alias("language"), "aspect").agg(F.count("*").alias("mentions"))
    w = W.partitionBy("language").orderBy(F.desc("mentions"), "aspect")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3")


@query(
    "sentiment_by_year_wide",
    f"{_D} SELECT event_year, count(*) AS mentions, count(DISTINCT document_id) AS documents, count(*) FILTER (sentiment = 'positive')::DOUBLE / count(*) AS positive_share, count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS negative_share, count(*) FILTER (sentiment = 'neutral')::DOUBLE / count(*) AS neutral_share, count(*) FILTER (sentiment = 'mixed')::DOUBLE / count(*) AS mixed_share FROM ments WHERE event_year IS NOT NULL GROUP BY 1",
)
def sentiment_by_year_wide(spark, d):
    """Year overview with sentiment shares (D3)."""
    m = T.mentions(spark, d, "event_year", "sentiment").filter("event_year IS NOT NULL")
    return m.groupBy("event_year").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"), *[cube.ratio(F.count_if(F.col("sentiment") == s), F.count("*")).alias(f"{s}_share") for s in cube.SENTIMENTS])


@query(
    "cross_source",
    """WITH a AS (SELECT coalesce(nullif(event_year, ''), 'Unknown') AS y, count(DISTINCT document_id) AS n FROM instagram_captions GROUP BY 1), b AS (SELECT coalesce(nullif(event_year, ''), 'Unknown') AS y, count(DISTINCT document_id) AS n FROM blog_reviews GROUP BY 1)
SELECT coalesce(a.y, b.y) AS event_year, coalesce(a.n, 0) AS posts, coalesce(b.n, 0) AS reviews, coalesce(a.n, 0)::DOUBLE / (SELECT sum(n) FROM a) AS share_of_posts, coalesce(b.n, 0)::DOUBLE / (SELECT sum(n) FROM b) AS share_of_reviews, CASE WHEN a.n IS NULL THEN 'reviews_only' WHEN b.n IS NULL THEN 'posts_only' ELSE 'both' END AS status FROM a FULL JOIN b ON a.y = b.y""",
)
def cross_source(spark, d):
    """Two sources side by side, each over its own denominator, never pooled."""
    side = lambda t, n: T.read(spark, d, t, "document_id", "event_year").groupBy(T.filled("event_year", "Unknown").alias("event_year")).agg(F.countDistinct("document_id").alias(n))
    a, b = side("instagram_captions", "posts"), side("blog_reviews", "reviews")
    j = a.join(b, "event_year", "full").withColumn("status", F.when(F.col("posts").isNull(), "reviews_only").when(F.col("reviews").isNull(), "posts_only").otherwise("both"))
    j = j.fillna(0, ["posts", "reviews"]).crossJoin(F.broadcast(a.agg(F.sum("posts").alias("pa")).crossJoin(b.agg(F.sum("reviews").alias("rb")))))
    return j.select("event_year", "posts", "reviews", cube.ratio(F.col("posts"), F.col("pa")).alias("share_of_posts"), cube.ratio(F.col("reviews"), F.col("rb")).alias("share_of_reviews"), "status")


@query(
    "document_aspect_matrix",
    f"""{_D}, a AS {_ASPECTS}, f AS (SELECT document_id, aspect, count(*) AS n, bool_or(sentiment = 'positive') AS p, bool_or(sentiment = 'negative') AS ng, bool_or(sentiment = 'mixed') AS mx, count(DISTINCT sentiment) AS k, min(sentiment) AS one FROM ments GROUP BY ALL)
SELECT c.document_id, a.aspect, coalesce(n, 0) AS mentions, n IS NOT NULL AS present, coalesce(p, false) AS positive, coalesce(ng, false) AS negative, coalesce(mx, false) AS mixed, CASE WHEN n IS NULL THEN 'absent' WHEN k = 1 THEN one ELSE 'multiple_not_forced' END AS dominant FROM caps c CROSS JOIN a LEFT JOIN f ON f.document_id = c.document_id AND f.aspect = a.aspect""",
)
def document_aspect_matrix(spark, d):
    """Every document by every aspect with presence flags and the sentiment that is not forced.

    One aggregate over the mentions, then one pass over the documents in which the small list of aspects is exploded:
    no join of documents with a grid.
    """
    m = T.mentions(spark, d, "aspect", "sentiment").filter("aspect IS NOT NULL")
    f = m.groupBy("document_id", "aspect").agg(F.count("*").alias("n"), F.bool_or(F.col("sentiment") == "positive").alias("p"), F.bool_or(F.col("sentiment") == "negative").alias("g"), F.bool_or(F.col("sentiment") == "mixed").alias("x"), F.countDistinct("sentiment").alias("k"), F.min("sentiment").alias("one"))
    per = f.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("aspect", F.struct("n", "p", "g", "x", "k", "one")))).alias("by"))
    aspects = F.broadcast(_aspects(m).agg(F.array_sort(F.collect_list("aspect")).alias("aspects")))
    j = T.captions(spark, d).select("document_id").join(per, "document_id", "left").crossJoin(aspects).select("document_id", "by", F.explode("aspects").alias("aspect"))
    c = F.try_element_at("by", F.col("aspect"))
    no = F.lit(False)
    return j.select("document_id", "aspect", F.coalesce(c["n"], F.lit(0).cast("bigint")).alias("mentions"), c.isNotNull().alias("present"), F.coalesce(c["p"], no).alias("positive"), F.coalesce(c["g"], no).alias("negative"), F.coalesce(c["x"], no).alias("mixed"), F.when(c.isNull(), "absent").when(c["k"] == 1, c["one"]).otherwise("multiple_not_forced").alias("dominant"))
