"""Human review around automatic decisions: queues, overlays, gates, repeats, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators import cube, evaluate
from lumenloom.plans.evaluation import _PAIR, pairs
from lumenloom.registry import query
from lumenloom.sources import tables as T

LABELS = ("include", "exclude")
_SQL_LABEL = "lower(trim(coalesce(reviewer_label, '')))"


def _label() -> Column:
    return F.lower(F.trim(F.coalesce("reviewer_label", F.lit(""))))


def reviews(spark, d) -> DataFrame:
    """Reviewers' labels, normalised; '' where a field was left empty."""
    r = T.read(spark, d, "reviewer_labels", "document_id", "reviewer_id", "reviewer_label", "language_observed", "offensive", "reviewer_confidence", "labelled_at")
    return r.withColumn("label", _label())


def latest(spark, d) -> DataFrame:
    """The last label of each document: later rows win."""
    return T.one_per_key(reviews(spark, d).filter("label <> ''"), ["document_id"], F.desc("labelled_at"), F.col("reviewer_id"))


_LATEST = f"latest AS (SELECT *, {_SQL_LABEL} AS label FROM reviewer_labels WHERE {_SQL_LABEL} <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at DESC, reviewer_id) = 1)"


@query("label_violations", f"SELECT 'unknown_label' AS rule, count(*) FILTER ({_SQL_LABEL} NOT IN ('include', 'exclude', '')) AS violations FROM reviewer_labels UNION ALL SELECT 'missing_label', count(*) FILTER ({_SQL_LABEL} = '') FROM reviewer_labels UNION ALL SELECT 'missing_reviewer', count(*) FILTER (coalesce(reviewer_id, '') = '') FROM reviewer_labels UNION ALL SELECT 'offensive_not_0_or_1', count(*) FILTER (offensive IS NOT NULL AND offensive NOT IN (0, 1)) FROM reviewer_labels UNION ALL SELECT 'unknown_confidence', count(*) FILTER (coalesce(reviewer_confidence, '') NOT IN ('', 'high', 'medium', 'low')) FROM reviewer_labels")
def label_violations(spark, d):
    """Rows against the rules of a table, all rules in one pass (F1)."""
    r = reviews(spark, d)
    rules = {
        "unknown_label": ~F.col("label").isin(*LABELS, ""), "missing_label": F.col("label") == "", "missing_reviewer": F.coalesce("reviewer_id", F.lit("")) == "",
        "offensive_not_0_or_1": F.col("offensive").isNotNull() & ~F.col("offensive").isin(0, 1), "unknown_confidence": ~F.coalesce("reviewer_confidence", F.lit("")).isin("", "high", "medium", "low"),
    }
    one = r.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.*")


_OVERLAY = f"""WITH {T.SQL_ASSESS}, {_LATEST}, o AS (SELECT a.document_id, CASE WHEN l.label IS NOT NULL THEN l.label WHEN a.event_connection IN ('explicit', 'supported') AND a.meaningful_content_present THEN 'include' ELSE 'exclude' END AS decision,
CASE WHEN l.label IS NOT NULL THEN 'human_resolved' WHEN coalesce(a.confidence, 0) < 0.8 OR a.requires_review_recommendation THEN 'pending' ELSE 'automatic' END AS review_status, CASE WHEN l.label IS NOT NULL THEN 1.0 ELSE a.confidence END AS confidence, l.reviewer_id FROM assess a LEFT JOIN latest l ON l.document_id = a.document_id AND l.label IN ('include', 'exclude'))"""


def overlay(spark, d) -> DataFrame:
    """Automatic decisions with the reviewers' labels laid over them (F10): later rows win, unknown labels never overrule."""
    a, r = T.assessments(spark, d), latest(spark, d).filter(F.col("label").isin(*LABELS)).select("document_id", "label", "reviewer_id")
    human = F.col("label").isNotNull()
    auto = F.when(F.col("event_connection").isin("explicit", "supported") & F.col("meaningful_content_present"), "include").otherwise("exclude")
    unsure = (F.coalesce("confidence", F.lit(0.0)) < 0.8) | F.col("requires_review_recommendation")
    return a.join(r, "document_id", "left").select("document_id", F.coalesce("label", auto).alias("decision"), F.when(human, "human_resolved").when(unsure, "pending").otherwise("automatic").alias("review_status"), F.when(human, 1.0).otherwise(F.col("confidence")).alias("confidence"), "reviewer_id")


@query("review_overlay", _OVERLAY + " SELECT * FROM o")
def review_overlay(spark, d):
    """Decision, state and confidence of each document after review."""
    return overlay(spark, d)


@query("review_queue", _OVERLAY + f", {T.SQL_CAPS}, notes AS (SELECT document_id, {_SQL_LABEL} AS saved_label, coalesce(language_observed, '') AS saved_note FROM reviewer_labels QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at DESC, reviewer_id) = 1) SELECT o.document_id, o.confidence, c.event_year, c.primary_language, coalesce(n.saved_label, '') AS saved_label, coalesce(n.saved_note, '') AS saved_note FROM o LEFT JOIN caps c USING (document_id) LEFT JOIN notes n USING (document_id) WHERE review_status = 'pending'")
def review_queue(spark, d):
    """What waits for a reviewer, with its context and the last note that it already has."""
    notes = T.one_per_key(reviews(spark, d), ["document_id"], F.desc("labelled_at"), F.col("reviewer_id")).select("document_id", F.col("label").alias("saved_label"), F.col("language_observed").alias("saved_note"))
    q = overlay(spark, d).filter("review_status = 'pending'").select("document_id", "confidence")
    q = q.join(T.captions(spark, d, "event_year", "primary_language").drop("ingested_at"), "document_id", "left").join(notes, "document_id", "left")
    return q.fillna("", ["saved_label", "saved_note"])


@query("topic_gate", _OVERLAY + ", expected AS (SELECT DISTINCT document_id FROM instagram_captions WHERE processing_status = 'ready') SELECT (SELECT count(*) FROM expected) AS expected, (SELECT count(*) FROM expected WHERE document_id NOT IN (SELECT document_id FROM o)) AS missing, (SELECT count(*) FROM o JOIN expected USING (document_id) WHERE review_status = 'pending') AS pending")
def topic_gate(spark, d):
    """Ready documents, those without a decision and those whose decision waits: a gate is open where the last two are 0."""
    e = T.read(spark, d, "instagram_captions", "document_id", "processing_status").filter("processing_status = 'ready'").select("document_id").distinct()
    j = e.join(overlay(spark, d).select("document_id", "review_status"), "document_id", "left")
    return j.agg(F.count("*").alias("expected"), F.count_if(F.col("review_status").isNull()).alias("missing"), F.count_if(F.col("review_status") == "pending").alias("pending"))


@query("pending_navigation", _OVERLAY + ", p AS (SELECT document_id, review_status = 'pending' AS pending, row_number() OVER (ORDER BY document_id) AS position FROM o) SELECT CAST(position // 1000 AS BIGINT) AS block, count(*) AS documents, count(*) FILTER (pending) AS pending, min(document_id) FILTER (pending) AS next_pending FROM p GROUP BY 1")
def pending_navigation(spark, d):
    """Progress and the next open document in blocks of a thousand (N23): ranges are numbered first, so no task ranks all rows."""
    from lumenloom.sources.files import chunk_numbers

    o = overlay(spark, d).select("document_id", (F.col("review_status") == "pending").alias("pending"))
    x = chunk_numbers(o, [F.col("document_id")], 1000, first=1)
    return x.groupBy(F.col("file_number").alias("block")).agg(F.count("*").alias("documents"), F.count_if("pending").alias("pending"), F.min(F.when(F.col("pending"), F.col("document_id"))).alias("next_pending"))


@query("refreshed_worksheet", f"WITH {T.SQL_ASSESS}, {_LATEST} SELECT coalesce(a.document_id, l.document_id) AS document_id, a.confidence AS refreshed_confidence, l.label AS kept_label, CASE WHEN a.document_id IS NULL THEN 'only_in_worksheet' WHEN l.document_id IS NULL THEN 'only_in_refresh' ELSE 'both' END AS alignment FROM assess a FULL JOIN latest l ON a.document_id = l.document_id")
def refreshed_worksheet(spark, d):
    """Refreshed diagnostics beside the columns that reviewers filled in; keys on one side only are shown, not dropped."""
    a, r = T.assessments(spark, d).select("document_id", F.col("confidence").alias("refreshed_confidence"), F.lit(1).alias("a")), latest(spark, d).select("document_id", F.col("label").alias("kept_label"))
    side = F.when(F.col("a").isNull(), "only_in_worksheet").when(F.col("kept_label").isNull(), "only_in_refresh").otherwise("both")
    return a.join(r, "document_id", "full").select("document_id", "refreshed_confidence", "kept_label", side.alias("alignment"))


_GOLD = f"""WITH votes AS (SELECT document_id, count(*) AS n, count(DISTINCT {_SQL_LABEL}) AS kinds, min({_SQL_LABEL}) AS lo FROM reviewer_labels WHERE {_SQL_LABEL} IN ('include', 'exclude') GROUP BY 1), {_LATEST},
gold AS (SELECT v.document_id, CASE WHEN kinds = 1 THEN lo WHEN l.reviewer_confidence = 'high' THEN l.label END AS label, CASE WHEN kinds = 1 AND n = 1 THEN 'single' WHEN kinds = 1 THEN 'consensus' WHEN l.reviewer_confidence = 'high' THEN 'adjudicated' ELSE 'open' END AS origin FROM votes v LEFT JOIN latest l USING (document_id))"""


def gold(spark, d) -> DataFrame:
    """Gold label of each document: what all reviewers say, else the last reviewer's word where it is sure, else open."""
    v = reviews(spark, d).filter(F.col("label").isin(*LABELS)).groupBy("document_id").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    last = latest(spark, d).select("document_id", F.col("label").alias("last"), (F.coalesce("reviewer_confidence", F.lit("")) == "high").alias("sure"))
    same = F.col("lo") == F.col("hi")
    origin = F.when(same & (F.col("n") == 1), "single").when(same, "consensus").when(F.col("sure"), "adjudicated").otherwise("open")
    return v.join(last, "document_id", "left").select("document_id", F.when(same, F.col("lo")).when(F.col("sure"), F.col("last")).alias("label"), origin.alias("origin"))


@query("gold_labels", _GOLD + " SELECT * FROM gold")
def gold_labels(spark, d):
    """Consensus, else the adjudicated label, else open."""
    return gold(spark, d)


@query("gold_breakdown", _GOLD + f", {T.SQL_CAPS}, j AS (SELECT g.*, coalesce(nullif(c.event_year, ''), 'unknown') AS event_year, coalesce(nullif(c.primary_language, ''), 'unknown') AS primary_language, coalesce(nullif(c.language_status, ''), 'unknown') AS language_status FROM gold g LEFT JOIN caps c USING (document_id)), long AS (SELECT 'event_year' AS dimension, event_year AS value, * FROM j UNION ALL SELECT 'primary_language', primary_language, * FROM j UNION ALL SELECT 'language_status', language_status, * FROM j UNION ALL SELECT 'origin', origin, * FROM j) SELECT dimension, value, count(*) AS documents, count(*) FILTER (label = 'include') AS include, count(*) FILTER (label = 'exclude') AS exclude, count(*) FILTER (origin = 'consensus') AS consensus, count(*) FILTER (origin = 'adjudicated') AS adjudicated FROM long GROUP BY ALL")
def gold_breakdown(spark, d):
    """Gold labels by several dimensions in one pass."""
    c = T.captions(spark, d, "event_year", "primary_language", "language_status").drop("ingested_at")
    dims = ["event_year", "primary_language", "language_status"]
    j = gold(spark, d).join(c, "document_id", "left").withColumns({x: T.filled(x) for x in dims})
    say = lambda k, v: F.count_if(F.col(k) == v).alias(v)
    return cube.unpivot_dimensions(j, [*dims, "origin"], F.count("*").alias("documents"), say("label", "include"), say("label", "exclude"), say("origin", "consensus"), say("origin", "adjudicated"))


_REPEATS = f"""WITH r AS (SELECT document_id, reviewer_id, {_SQL_LABEL} AS label, labelled_at, row_number() OVER (PARTITION BY document_id ORDER BY labelled_at, reviewer_id, {_SQL_LABEL}) AS k FROM reviewer_labels WHERE {_SQL_LABEL} <> ''), p AS (SELECT o.document_id, o.reviewer_id, o.label AS original_label, n.label AS repeat_label, o.reviewer_id = n.reviewer_id AS same_reviewer FROM r o JOIN r n ON o.document_id = n.document_id AND o.k = 1 AND n.k > 1)"""


def repeats(spark, d) -> DataFrame:
    """Later labels of a document beside its first one (V4). A document has a handful of labels, so the join cannot explode."""
    r = reviews(spark, d).filter("label <> ''").withColumn("k", F.row_number().over(W.partitionBy("document_id").orderBy("labelled_at", "reviewer_id", "label")))
    o = r.filter("k = 1").select("document_id", "reviewer_id", F.col("label").alias("original_label"))
    n = r.filter("k > 1").select("document_id", F.col("label").alias("repeat_label"), F.col("reviewer_id").alias("again"))
    return o.join(n, "document_id").withColumn("same_reviewer", F.col("reviewer_id") == F.col("again")).drop("again")


@query("repeat_agreement", _REPEATS + " SELECT same_reviewer, count(*) AS repeats, count(*) FILTER (original_label = repeat_label) AS agreements, count(*) FILTER (original_label = repeat_label)::DOUBLE / count(*) AS agreement_rate FROM p GROUP BY 1")
def repeat_agreement(spark, d):
    """How often a later label of a document repeats the first, by the same and by another reviewer (V4)."""
    same = F.count_if(F.col("original_label") == F.col("repeat_label"))
    return repeats(spark, d).groupBy("same_reviewer").agg(F.count("*").alias("repeats"), same.alias("agreements"), cube.ratio(same, F.count("*")).alias("agreement_rate"))


@query("repeat_disagreements", _REPEATS + " SELECT document_id, reviewer_id, original_label, repeat_label, same_reviewer FROM p WHERE original_label <> repeat_label")
def repeat_disagreements(spark, d):
    """The repeats that differ, as they were given: nothing is relabelled (V4)."""
    return repeats(spark, d).filter("original_label <> repeat_label").select("document_id", "reviewer_id", "original_label", "repeat_label", "same_reviewer")


# --- views, operating points, audits --------------------------------------------------------------------------------------------------

_VIEWS = _PAIR + ", v AS (SELECT gold, predicted, confidence < 0.8 AS review FROM pair)"
_F1 = "coalesce(2.0 * count(*) FILTER (gold = 'include' AND {p} = 'include') / nullif(count(*) FILTER (gold = 'include') + count(*) FILTER ({p} = 'include'), 0), 0)"


@query("three_views", _VIEWS + f" SELECT 'automatic_only' AS view, count(*) AS n, count(*) FILTER (gold = predicted) AS correct, {_F1.format(p='predicted')} AS include_f1 FROM v WHERE NOT review UNION ALL SELECT 'routing', count(*), count(*) FILTER (NOT review AND gold = predicted), coalesce(2.0 * count(*) FILTER (NOT review AND gold = 'include' AND predicted = 'include') / nullif(count(*) FILTER (gold = 'include') + count(*) FILTER (NOT review AND predicted = 'include'), 0), 0) FROM v UNION ALL SELECT 'assisted', count(*), count(*) FILTER (review OR gold = predicted), {_F1.format(p='(CASE WHEN review THEN gold ELSE predicted END)')} FROM v")
def three_views(spark, d):
    """The same decisions without those under review, with review as no answer, and with review answered by gold (V7): one pass."""
    p = pairs(spark, d).withColumn("review", F.col("confidence") < 0.8)
    said = {"automatic_only": F.when(~F.col("review"), F.col("predicted")), "routing": F.when(F.col("review"), "review").otherwise(F.col("predicted")), "assisted": F.when(F.col("review"), F.col("gold")).otherwise(F.col("predicted"))}
    long = p.select("gold", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("said")) for k, v in said.items()])).alias("x")).select("gold", "x.*").filter("said IS NOT NULL")
    tp = F.count_if((F.col("gold") == "include") & (F.col("said") == "include"))
    return long.groupBy("view").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("said")).alias("correct"), cube.ratio(2 * tp, F.count_if(F.col("gold") == "include") + F.count_if(F.col("said") == "include")).alias("include_f1"))


_GRID = _PAIR + """, g AS (SELECT low, high FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS low) CROSS JOIN (SELECT unnest([0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS high) WHERE low < high),
m AS (SELECT low, high, count(*) FILTER (confidence >= high AND gold = 'include') AS tp, count(*) FILTER (confidence >= high AND gold <> 'include') AS fp, count(*) FILTER (confidence < low AND gold = 'include') AS fn, count(*) FILTER (confidence < low AND gold <> 'include') AS tn, count(*) FILTER (confidence >= low AND confidence < high) AS review FROM g CROSS JOIN pair GROUP BY ALL),
s AS (SELECT *, review::DOUBLE / (tp + fp + fn + tn + review) AS review_rate, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS inclusion_precision, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS exclusion_precision FROM m)"""


@query("operating_point", _GRID + " SELECT low, high, review_rate, inclusion_precision, exclusion_precision FROM s WHERE inclusion_precision >= 0.5 ORDER BY review_rate, inclusion_precision DESC, exclusion_precision DESC, low, high LIMIT 1")
def operating_point(spark, d):
    """The pair of thresholds with the least review among those good enough (V9): the choice of one row is the feature."""
    g = evaluate.threshold_grid(pairs(spark, d), F.col("confidence"), F.col("gold") == "include", [0.5, 0.6, 0.7, 0.8], [0.7, 0.8, 0.9, 0.95])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("review")
    s = g.select("low", "high", cube.ratio(F.col("review"), n).alias("review_rate"), cube.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("inclusion_precision"), cube.ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("exclusion_precision"))
    return s.filter("inclusion_precision >= 0.5").orderBy("review_rate", F.desc("inclusion_precision"), F.desc("exclusion_precision"), "low", "high").limit(1)


def _route(confidence: str, low: float, high: float) -> Column:
    return F.when(F.col(confidence) >= high, "include").when(F.col(confidence) < low, "exclude").otherwise("review")


_ROUTES = f"WITH {T.SQL_ASSESS}, r AS (SELECT document_id, CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'include' WHEN coalesce(confidence, 0) < 0.7 THEN 'exclude' ELSE 'review' END AS old_route, CASE WHEN coalesce(confidence, 0) >= 0.8 THEN 'include' WHEN coalesce(confidence, 0) < 0.6 THEN 'exclude' ELSE 'review' END AS new_route FROM assess)"


@query("route_changes", _ROUTES + " SELECT * FROM r WHERE old_route <> new_route")
def route_changes(spark, d):
    """Documents that a change of thresholds sends another way."""
    a = T.assessments(spark, d).select("document_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return a.select("document_id", _route("confidence", 0.7, 0.9).alias("old_route"), _route("confidence", 0.6, 0.8).alias("new_route")).filter("old_route <> new_route")


@query("policy_replay", _ROUTES + f", {_LATEST} SELECT old_route, new_route, count(*) AS documents, count(*) FILTER (old_route = 'review' AND new_route <> 'review') AS reviews_saved, count(*) FILTER (new_route = 'include' AND label = 'exclude') AS false_inclusions, count(*) FILTER (new_route = 'exclude' AND label = 'include') AS false_exclusions FROM r LEFT JOIN latest USING (document_id) GROUP BY ALL")
def policy_replay(spark, d):
    """Old and new thresholds side by side with what each saves and costs."""
    a = T.assessments(spark, d).select("document_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    r = a.select("document_id", _route("confidence", 0.7, 0.9).alias("old_route"), _route("confidence", 0.6, 0.8).alias("new_route")).join(latest(spark, d).select("document_id", "label"), "document_id", "left")
    old, new, label = F.col("old_route"), F.col("new_route"), F.col("label")
    return r.groupBy("old_route", "new_route").agg(F.count("*").alias("documents"), F.count_if((old == "review") & (new != "review")).alias("reviews_saved"), F.count_if((new == "include") & (label == "exclude")).alias("false_inclusions"), F.count_if((new == "exclude") & (label == "include")).alias("false_exclusions"))


@query("design_weighted_audit", f"""WITH {T.SQL_ASSESS}, {_LATEST}, a AS (SELECT document_id, CASE WHEN event_connection IN ('explicit', 'supported') AND meaningful_content_present THEN 'include' ELSE 'exclude' END AS decision, coalesce(primary_content_type, 'unknown') AS stratum FROM assess),
j AS (SELECT a.*, l.label, count(*) OVER (PARTITION BY stratum) AS population, count(l.label) OVER (PARTITION BY stratum) AS sample FROM a LEFT JOIN latest l ON l.document_id = a.document_id AND l.label IN ('include', 'exclude')), w AS (SELECT *, population::DOUBLE / sample AS weight FROM j WHERE label IS NOT NULL)
SELECT decision, count(*) AS audited, count(*) FILTER (label = decision) AS confirmed, count(*) FILTER (label = decision)::DOUBLE / count(*) AS confirmation_rate, round(sum(weight), 6) AS weighted_documents, round(sum(CASE WHEN label = decision THEN weight ELSE 0 END) / sum(weight), 9) AS weighted_rate FROM w GROUP BY 1""")
def design_weighted_audit(spark, d):
    """Audited decisions with the weight of their stratum: population over sample (V11, P7). Strata are counted by a grouped aggregate, not by a window over the rows."""
    decision = F.when(F.col("event_connection").isin("explicit", "supported") & F.col("meaningful_content_present"), "include").otherwise("exclude")
    a = T.assessments(spark, d).select("document_id", decision.alias("decision"), F.coalesce("primary_content_type", F.lit("unknown")).alias("stratum"))
    j = a.join(latest(spark, d).filter(F.col("label").isin(*LABELS)).select("document_id", "label"), "document_id", "left")
    s = j.groupBy("stratum").agg(F.try_divide(F.count("*").cast("double"), F.count("label").cast("double")).alias("weight"))
    w = j.filter("label IS NOT NULL").join(s, "stratum")
    hit = F.col("label") == F.col("decision")
    return w.groupBy("decision").agg(F.count("*").alias("audited"), F.count_if(hit).alias("confirmed"), cube.ratio(F.count_if(hit), F.count("*")).alias("confirmation_rate"), F.round(F.sum("weight"), 6).alias("weighted_documents"), F.round(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)) / F.sum("weight"), 9).alias("weighted_rate"))


_ERROR = "CASE WHEN gold = predicted THEN 'correct' WHEN predicted = 'include' AND event_connection = 'supported' THEN 'supported_connection_overread' WHEN predicted = 'include' THEN 'content_overread' WHEN event_connection IN ('weak', 'none') THEN 'connection_missed' ELSE 'content_missed' END"


@query("error_categories", _PAIR + f" SELECT {_ERROR} AS category, count(*) AS documents, round(avg(confidence), 9) AS mean_confidence FROM pair GROUP BY 1")
def error_categories(spark, d):
    """Why decisions and labels differ, first rule that fits."""
    sure = F.col("predicted") == "include"
    c = F.when(F.col("gold") == F.col("predicted"), "correct").when(sure & (F.col("event_connection") == "supported"), "supported_connection_overread").when(sure, "content_overread").when(F.col("event_connection").isin("weak", "none"), "connection_missed").otherwise("content_missed")
    return pairs(spark, d).groupBy(c.alias("category")).agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


@query("disagreement_patterns", _PAIR + f", {T.SQL_CAPS} SELECT gold || '->' || predicted AS pattern, coalesce(nullif(c.primary_language, ''), 'unknown') AS language, CASE WHEN length(coalesce(c.original_text, '')) < 80 THEN 'short' ELSE 'long' END AS length_group, count(*) AS documents FROM pair LEFT JOIN caps c USING (document_id) WHERE gold <> predicted GROUP BY ALL")
def disagreement_patterns(spark, d):
    """Disagreements with their context, counted by pattern."""
    p = pairs(spark, d).filter("gold <> predicted").join(T.captions(spark, d, "primary_language", "original_text").drop("ingested_at"), "document_id", "left")
    long = F.when(F.length(F.coalesce("original_text", F.lit(""))) < 80, "short").otherwise("long")
    return p.groupBy(F.concat("gold", F.lit("->"), "predicted").alias("pattern"), T.filled("primary_language").alias("language"), long.alias("length_group")).agg(F.count("*").alias("documents"))


@query("retry_set", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY assessed_at DESC, confidence DESC NULLS LAST, event_connection, primary_content_type) AS newest, confidence BETWEEN 0 AND 1 AND primary_content_type IS NOT NULL AND event_connection IN ('explicit', 'supported', 'weak', 'none') AS valid FROM relevance_assessments) SELECT document_id, count(*) AS attempts, count(*) FILTER (coalesce(valid, FALSE)) AS valid_attempts, max(assessed_at) FILTER (coalesce(valid, FALSE)) IS NULL AS retry FROM v GROUP BY 1")
def retry_set(spark, d):
    """Documents whose every attempt is invalid are to be tried again; of the others the latest valid attempt counts."""
    a = T.read(spark, d, "relevance_assessments", "document_id", "confidence", "primary_content_type", "event_connection", "assessed_at")
    valid = F.coalesce(F.col("confidence").between(0, 1) & F.col("primary_content_type").isNotNull() & F.col("event_connection").isin("explicit", "supported", "weak", "none"), F.lit(False))
    return a.groupBy("document_id").agg(F.count("*").alias("attempts"), F.count_if(valid).alias("valid_attempts"), (F.count_if(valid) == 0).alias("retry"))


@query("review_progress", f"WITH {T.SQL_MENTS}, {_LATEST} SELECT aspect, count(*) AS mentions, count(label) AS reviewed, count(label)::DOUBLE / count(*) AS progress, row_number() OVER (ORDER BY count(*) DESC, aspect) AS position FROM ments LEFT JOIN latest USING (document_id) WHERE aspect IS NOT NULL GROUP BY 1")
def review_progress(spark, d):
    """How far review has come for each aspect, the best supported first."""
    m = T.mentions(spark, d, "aspect").filter("aspect IS NOT NULL").join(latest(spark, d).select("document_id", "label"), "document_id", "left")
    g = m.groupBy("aspect").agg(F.count("*").alias("mentions"), F.count("label").alias("reviewed"), cube.ratio(F.count("label"), F.count("*")).alias("progress"))
    # one row for each aspect
    return g.withColumn("position", F.row_number().over(W.partitionBy().orderBy(F.desc("mentions"), "aspect")).cast("bigint"))
