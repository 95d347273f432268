"""Evidence of mentions in their captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators import cube, grounding
from lumenloom.registry import query
from lumenloom.sources import tables as T

_J = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}, j AS (SELECT m.*, c.original_text AS t FROM ments m LEFT JOIN caps c USING (document_id))"


def _joined(spark, d):
    m = T.mentions(spark, d, "aspect", "evidence_text", "evidence_start", "evidence_end", "mention_index", "mention_language")
    return m.drop("created_at").join(T.captions(spark, d, "original_text").drop("ingested_at"), "document_id", "left")


@query("evidence_spans", f"{_J} SELECT mention_id, CASE WHEN evidence_text <> '' AND strpos(t, evidence_text) > 0 THEN strpos(t, evidence_text) - 1 END AS span_start, CASE WHEN evidence_text <> '' AND strpos(t, evidence_text) > 0 THEN strpos(t, evidence_text) - 1 + length(evidence_text) END AS span_end, substr(t, evidence_start + 1, evidence_end - evidence_start) = evidence_text AS offsets_hold FROM j")
def evidence_spans(spark, d):
    """First exact place of the evidence, and whether the given offsets hold."""
    j = _joined(spark, d)
    s = grounding.exact_span(F.col("original_text"), F.col("evidence_text"))
    given = F.substring(F.col("original_text"), F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start"))
    return j.withColumn("s", s).select("mention_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), (given == F.col("evidence_text")).alias("offsets_hold"))


@query("evidence_grounding")
def evidence_grounding(spark, d):
    """Exact, recovered or lost, with method and reason."""
    g = grounding.ground_mentions(_joined(spark, d), "original_text", "evidence_text", "evidence_start", "evidence_end")
    return g.select("mention_id", "grounding.status", "grounding.method", F.col("grounding.start").alias("span_start"), F.col("grounding.end").alias("span_end"), "grounding.reason")


@query("evidence_status", f"{_J} SELECT mention_id, CASE WHEN coalesce(evidence_text, '') = '' THEN 'no_evidence' WHEN strpos(coalesce(t, ''), evidence_text) > 0 THEN 'exact' ELSE 'other' END AS status, CASE WHEN evidence_text <> '' AND strpos(t, evidence_text) > 0 THEN 'none' END AS method, CASE WHEN evidence_text <> '' AND strpos(coalesce(t, ''), evidence_text) = 0 THEN contains(evidence_text, '...') OR contains(evidence_text, '…') OR contains(evidence_text, ' / ') END AS has_gap FROM j")
def evidence_status(spark, d):
    """Which evidence is literal, missing or left to recovery: the part of the grounding that SQL can say."""
    g = grounding.ground_mentions(_joined(spark, d), "original_text", "evidence_text", "evidence_start", "evidence_end")
    status = F.when(F.col("grounding.status").isin("exact", "no_evidence"), F.col("grounding.status")).otherwise("other")
    return g.select("mention_id", status.alias("status"), F.when(status == "exact", F.col("grounding.method")).alias("method"), F.when(status == "other", F.col("evidence_text").rlike("\\.\\.\\.|…| / ")).alias("has_gap"))


@query("grounding_rates", f"{_J} SELECT coalesce(nullif(mention_language, ''), 'unknown') AS language, count(*) AS mentions, count(*) FILTER (coalesce(evidence_text, '') <> '') AS with_evidence, coalesce(count(*) FILTER (evidence_text <> '' AND strpos(t, evidence_text) > 0)::DOUBLE / nullif(count(*) FILTER (coalesce(evidence_text, '') <> ''), 0), 0) AS exact_rate, coalesce(count(*) FILTER (evidence_text <> '' AND strpos(lower(t), lower(evidence_text)) > 0)::DOUBLE / nullif(count(*) FILTER (coalesce(evidence_text, '') <> ''), 0), 0) AS any_case_rate FROM j GROUP BY 1")
def grounding_rates(spark, d):
    """Rates of exact and of case-blind evidence per language."""
    j = _joined(spark, d).withColumn("language", T.filled("mention_language"))
    has = F.coalesce(F.col("evidence_text"), F.lit("")) != ""
    hit = has & (F.instr(F.col("original_text"), F.col("evidence_text")) > 0)
    low = has & (F.instr(F.lower("original_text"), F.lower("evidence_text")) > 0)
    return j.groupBy("language").agg(F.count("*").alias("mentions"), F.count_if(has).alias("with_evidence"), cube.ratio(F.count_if(hit), F.count_if(has)).alias("exact_rate"), cube.ratio(F.count_if(low), F.count_if(has)).alias("any_case_rate"))


@query("mention_keys", f"WITH {T.SQL_MENTS} SELECT mention_id, 'm1_' || substr(sha256('v1|' || coalesce(document_id, '') || '|' || coalesce(CAST(mention_index AS VARCHAR), '') || '|' || coalesce(aspect, '') || '|' || coalesce(evidence_text, '')), 1, 16) AS content_key FROM ments")
def mention_keys(spark, d):
    """Key of a mention's content."""
    m = T.mentions(spark, d, "mention_index", "aspect", "evidence_text")
    parts = [F.lit("v1"), *[X.or_empty(F.col(c).cast("string")) for c in ("document_id", "mention_index", "aspect", "evidence_text")]]
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [p]])
    return m.select("mention_id", F.concat(F.lit("m1_"), F.substring(F.sha2(joined, 256), 1, 16)).alias("content_key"))
