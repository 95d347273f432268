"""Presentation tables and integrity counters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators import cube
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"


@query("overview_aspects", f"""{_D}, g AS (SELECT aspect, count(*) AS mentions, count(DISTINCT document_id) AS documents, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'mixed') AS mixed, min(event_year) AS first_year, max(event_year) AS last_year, round(avg(confidence), 8) AS mean_confidence FROM ments WHERE aspect IS NOT NULL GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY documents DESC, aspect) AS position, (positive - negative)::DOUBLE / mentions AS balance FROM g""")
def overview_aspects(spark, d):
    """One wide row per aspect."""
    m = T.mentions(spark, d, "aspect", "sentiment", "event_year", "confidence").filter("aspect IS NOT NULL")
    g = m.groupBy("aspect").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in cube.SENTIMENTS], F.min("event_year").alias("first_year"), F.max("event_year").alias("last_year"), F.round(F.avg("confidence"), 8).alias("mean_confidence"))
    return g.withColumn("position", F.row_number().over(W.partitionBy().orderBy(F.desc("documents"), "aspect")).cast("bigint")).withColumn("balance", cube.ratio(F.col("positive") - F.col("negative"), F.col("mentions")))


@query("corpus_overview", f"""{_D} SELECT 'year' AS dimension, coalesce(nullif(event_year, ''), 'Unknown') AS value, count(*) AS documents FROM caps GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM caps GROUP BY 2 UNION ALL SELECT 'language', coalesce(nullif(language_iso, ''), 'unknown'), count(*) FROM caps GROUP BY 2""")
def corpus_overview(spark, d):
    """Counts by year, source and language from one pass."""
    c = T.captions(spark, d, "event_year", "source", "language_iso").select(T.filled("event_year", "Unknown").alias("year"), T.filled("source").alias("source"), T.filled("language_iso").alias("language"))
    return cube.unpivot_dimensions(c, ["year", "source", "language"], F.count("*").alias("documents"))


@query("integrity_counters", f"""SELECT count(*) AS "rows", count(DISTINCT document_id) AS documents, count(*) - count(DISTINCT document_id) AS delivered_again, count(*) FILTER (author IS NULL OR author = '') AS without_author, count(*) FILTER (original_text IS NULL OR trim(original_text) = '') AS blank, count(*) FILTER (event_year IS NULL OR NOT regexp_full_match(event_year, '\\d{{4}}')) AS without_year, count(*) FILTER (language_confidence IS NULL OR language_confidence < 0 OR language_confidence > 1) AS bad_confidence, count(*) FILTER (post_timestamp IS NULL OR post_timestamp = '') AS without_time, count(*) FILTER (hashtags IS NULL OR len(hashtags) = 0) AS without_tags FROM instagram_captions""")
def integrity_counters(spark, d):
    """All counters in one aggregate."""
    c = F.col
    df = T.read(spark, d, "instagram_captions", "document_id", "author", "original_text", "event_year", "language_confidence", "post_timestamp", "hashtags")
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"), (F.count("*") - F.countDistinct("document_id")).alias("delivered_again"), F.count_if(blank("author")).alias("without_author"),
        F.count_if(F.trim(F.coalesce("original_text", F.lit(""))) == "").alias("blank"), F.count_if(~F.coalesce(c("event_year").rlike(r"^\d{4}$"), F.lit(False))).alias("without_year"),
        F.count_if(c("language_confidence").isNull() | (c("language_confidence") < 0) | (c("language_confidence") > 1)).alias("bad_confidence"), F.count_if(blank("post_timestamp")).alias("without_time"),
        F.count_if(F.coalesce(F.size("hashtags"), F.lit(0)) <= 0).alias("without_tags"),
    )


@query("drill_down", f"{_D} SELECT document_id, author FROM caps c WHERE EXISTS (SELECT 1 FROM ments m WHERE m.document_id = c.document_id AND m.aspect = 'volunteer_support' AND m.sentiment = 'positive') AND event_year = '2024'")
def drill_down(spark, d):
    """Documents by filters of document and mention; aspect and sentiment hold on the same mention."""
    m = T.mentions(spark, d, "aspect", "sentiment").filter("aspect = 'volunteer_support' AND sentiment = 'positive'")
    return T.captions(spark, d, "author", "event_year").filter("event_year = '2024'").join(m.select("document_id"), "document_id", "left_semi").select("document_id", "author")


@query("label_consensus", "WITH v AS (SELECT document_id, count(*) AS votes, count(DISTINCT nullif(reviewer_label, '')) AS kinds, min(nullif(reviewer_label, '')) AS one FROM reviewer_labels GROUP BY 1) SELECT document_id, votes, CASE WHEN kinds = 0 THEN 'missing' WHEN kinds = 1 THEN 'consensus' ELSE 'disagreement' END AS status, CASE WHEN kinds = 1 THEN one END AS label FROM v")
def label_consensus(spark, d):
    """Labels that reviewers share, and those they don't."""
    lab = F.nullif("reviewer_label", F.lit(""))
    v = T.read(spark, d, "reviewer_labels").groupBy("document_id").agg(F.count("*").alias("votes"), F.countDistinct(lab).alias("k"), F.min(lab).alias("one"))
    return v.select("document_id", "votes", F.when(F.col("k") == 0, "missing").when(F.col("k") == 1, "consensus").otherwise("disagreement").alias("status"), F.when(F.col("k") == 1, F.col("one")).alias("label"))


@query("label_overlay", f"WITH {T.SQL_CAPS}, r AS (SELECT document_id, nullif(language_observed, '') AS seen FROM reviewer_labels QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at DESC, reviewer_id) = 1) SELECT document_id, coalesce(seen, nullif(primary_language, ''), 'unknown') AS language, CASE WHEN seen IS NOT NULL THEN 'reviewer' ELSE 'model' END AS decided_by FROM caps LEFT JOIN r USING (document_id)")
def label_overlay(spark, d):
    """The latest human label over the model's."""
    r = T.one_per_key(T.read(spark, d, "reviewer_labels", "document_id", "language_observed", "labelled_at", "reviewer_id"), ["document_id"], F.desc("labelled_at"), F.col("reviewer_id"))
    r = r.select("document_id", F.nullif("language_observed", F.lit("")).alias("seen"))
    j = T.captions(spark, d, "primary_language").join(r, "document_id", "left")
    return j.select("document_id", F.coalesce("seen", T.filled("primary_language")).alias("language"), F.when(F.col("seen").isNotNull(), "reviewer").otherwise("model").alias("decided_by"))


@query("evidence_package", f"{_D}, r AS (SELECT aspect, mention_id, document_id, sentiment, evidence_text, row_number() OVER (PARTITION BY aspect ORDER BY confidence DESC NULLS LAST, mention_id) AS rn FROM ments WHERE aspect IS NOT NULL AND evidence_text <> '') SELECT aspect, '[' || string_agg('\"' || mention_id || '\"', ',' ORDER BY rn) || ']' AS mention_ids FROM r WHERE rn <= 5 GROUP BY 1")
def evidence_package(spark, d):
    """Best evidence per aspect as JSON."""
    m = T.mentions(spark, d, "aspect", "evidence_text", "confidence").filter("aspect IS NOT NULL AND evidence_text <> ''")
    w = W.partitionBy("aspect").orderBy(F.desc_nulls_last("confidence"), "mention_id")
    top = m.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return top.groupBy("aspect").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", "mention_id"))), lambda x: x["mention_id"])).alias("mention_ids"))


@query("years_wide", f"{_D} SELECT aspect, count(*) FILTER (event_year = 2019) AS y2019, count(*) FILTER (event_year = 2023) AS y2023, count(*) FILTER (event_year = 2024) AS y2024, count(*) FILTER (event_year = 2025) AS y2025, count(*) FILTER (event_year IS NULL) AS unknown FROM ments WHERE aspect IS NOT NULL GROUP BY 1")
def years_wide(spark, d):
    """Years as columns."""
    y = F.col("event_year")
    return T.mentions(spark, d, "aspect", "event_year").filter("aspect IS NOT NULL").groupBy("aspect").agg(*[F.count_if(y == v).alias(f"y{v}") for v in (2019, 2023, 2024, 2025)], F.count_if(y.isNull()).alias("unknown"))
