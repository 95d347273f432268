"""Copies, ranks, pages and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.functions import text as X
from lumenloom.operators import windows
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
_CANON = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query(
    "document_duplicates",
    f"""WITH d AS (SELECT doc_id, {_CANON.format('text')} AS k FROM documents) SELECT doc_id, CASE WHEN k = '' THEN 'empty' WHEN f <> doc_id THEN 'duplicate' ELSE 'ready' END AS status, CASE WHEN k <> '' AND f <> doc_id THEN f END AS duplicate_of
FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS f FROM d)""",
)
def document_duplicates(spark, d):
    """First-seen duplicates by canonical text; empty texts are neither."""
    df = T.read(spark, d, "documents", "doc_id", "text").select("doc_id", X.canonical(F.col("text")).alias("k"))
    out = windows.mark_duplicates(df, F.col("k"), "doc_id", [F.col("doc_id")], F.col("k") == "")
    return out.select("doc_id", F.when(F.col("k") == "", "empty").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("ready").alias("status"), "duplicate_of")


@query("latest_assessment", f"WITH {T.SQL_ASSESS} SELECT document_id, event_connection, primary_content_type, confidence FROM assess")
def latest_assessment(spark, d):
    """Later rows win, in a total order."""
    return T.assessments(spark, d).select("document_id", "event_connection", "primary_content_type", "confidence")


@query(
    "confidence_bins",
    f"""{_D}, r AS (SELECT mention_id, aspect, row_number() OVER (PARTITION BY aspect ORDER BY confidence, mention_id) AS r, count(*) OVER (PARTITION BY aspect) AS n FROM ments WHERE confidence IS NOT NULL)
SELECT mention_id, aspect, CAST(greatest(0, ceil((r - 1) * 4.0 / greatest(n - 1, 1)) - 1) AS INTEGER) AS quarter, CAST(least(2, floor((r - 1) * 3.0 / greatest(n - 1, 1))) AS INTEGER) AS third FROM r""",
)
def confidence_bins(spark, d):
    """Rank bins with the edges of interpolated quantiles, in quarters and thirds."""
    m = T.mentions(spark, d, "aspect", "confidence").filter("confidence IS NOT NULL")
    m = windows.ranks(m, ["aspect"], ["confidence", "mention_id"])
    return m.select("mention_id", "aspect", windows.quantile_bin(F.col("rank"), F.col("size"), 4).alias("quarter"), windows.quantile_bin(F.col("rank"), F.col("size"), 3).alias("third"))


@query("mention_ordinals", f"{_D} SELECT mention_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY mention_index, mention_id) - 1 AS ordinal, count(*) OVER (PARTITION BY document_id) AS in_document FROM ments")
def mention_ordinals(spark, d):
    """Position and group size inside the document."""
    w = W.partitionBy("document_id")
    m = T.mentions(spark, d, "mention_index")
    return m.select("mention_id", "document_id", (F.row_number().over(w.orderBy("mention_index", "mention_id")) - 1).cast("bigint").alias("ordinal"), F.count("*").over(w).alias("in_document"))


@query("top_authors", f"{_D} SELECT author, count(*) AS posts FROM caps WHERE author IS NOT NULL AND author <> '' GROUP BY 1 ORDER BY posts DESC, author LIMIT 40")
def top_authors(spark, d):
    """A top-k report with a tie-break."""
    return T.captions(spark, d, "author").filter("author <> ''").groupBy("author").agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "author").limit(40)


@query("document_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def document_page(spark, d):
    """Third page of 25, longest first."""
    return windows.page(T.read(spark, d, "documents", "doc_id", "n_chars"), 3, 25, F.desc_nulls_last("n_chars"), F.col("doc_id"))


@query("largest_change", f"{_D}, y AS (SELECT aspect, event_year, count(*) AS n FROM ments WHERE event_year IS NOT NULL AND aspect IS NOT NULL GROUP BY ALL), p AS (SELECT a.aspect, a.event_year AS year_a, b.event_year AS year_b, b.n - a.n AS change FROM y a JOIN y b ON a.aspect = b.aspect AND a.event_year < b.event_year) SELECT aspect, year_a, year_b, change FROM p QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY abs(change) DESC, year_a, year_b) = 1")
def largest_change(spark, d):
    """Row of the absolute maximum per group, over pairs of years (W12, J7: pairs of a bounded dimension)."""
    y = T.mentions(spark, d, "aspect", "event_year").filter("event_year IS NOT NULL AND aspect IS NOT NULL").groupBy("aspect", "event_year").agg(F.count("*").alias("n"))
    a, b = y.select("aspect", F.col("event_year").alias("year_a"), F.col("n").alias("na")), y.select("aspect", F.col("event_year").alias("year_b"), F.col("n").alias("nb"))
    p = a.join(b, "aspect").filter("year_a < year_b").withColumn("change", F.col("nb") - F.col("na"))
    best = F.max_by(F.struct("year_a", "year_b", "change"), F.struct(F.abs("change"), -F.col("year_a"), -F.col("year_b")))
    return p.groupBy("aspect").agg(best.alias("x")).select("aspect", "x.year_a", "x.year_b", "x.change")


@query("evidence_representatives")
def evidence_representatives(spark, d):
    """Longest evidence first, never twice from one document or with one text, five per aspect."""
    m = T.mentions(spark, d, "aspect", "evidence_text").filter("aspect IS NOT NULL AND evidence_text <> ''")
    return windows.greedy_representatives(m, ["aspect"], "document_id", "evidence_text", X.canonical(F.col("evidence_text")))


@query("mentions_without_caption", f"{_D} SELECT mention_id FROM ments m WHERE NOT EXISTS (SELECT 1 FROM caps c WHERE c.document_id = m.document_id)")
def mentions_without_caption(spark, d):
    """Ids that point nowhere."""
    return T.mentions(spark, d).join(T.captions(spark, d).select("document_id"), "document_id", "left_anti").select("mention_id")


@query("captions_assessed", f"{_D} SELECT document_id FROM caps WHERE document_id IN (SELECT document_id FROM relevance_assessments)")
def captions_assessed(spark, d):
    """Semi join."""
    return T.captions(spark, d).join(T.read(spark, d, "relevance_assessments", "document_id"), "document_id", "left_semi").select("document_id")


@query(
    "id_reconciliation",
    "WITH e AS (SELECT DISTINCT document_id FROM relevance_assessments), r AS (SELECT document_id, count(*) AS n FROM reviewer_labels GROUP BY 1) SELECT document_id, CASE WHEN e.document_id IS NULL THEN 'unexpected' WHEN r.document_id IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM e FULL JOIN r USING (document_id)",
)
def id_reconciliation(spark, d):
    """Expected against returned ids: unexpected, missing, repeated."""
    e = T.read(spark, d, "relevance_assessments", "document_id").distinct().withColumn("e", F.lit(True))
    r = T.read(spark, d, "reviewer_labels", "document_id").groupBy("document_id").agg(F.count("*").alias("n"))
    return e.join(r, "document_id", "full").select("document_id", F.when(F.col("e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("ok").alias("status"))


@query("id_sets", "SELECT 'both' AS part, count(*) AS ids FROM (SELECT document_id FROM relevance_assessments INTERSECT SELECT document_id FROM reviewer_labels) UNION ALL SELECT 'assessed_only', count(*) FROM (SELECT document_id FROM relevance_assessments EXCEPT SELECT document_id FROM reviewer_labels) UNION ALL SELECT 'labelled_only', count(*) FROM (SELECT document_id FROM reviewer_labels EXCEPT SELECT document_id FROM relevance_assessments)")
def id_sets(spark, d):
    """A partition of ids by two sets."""
    a, b = T.read(spark, d, "relevance_assessments", "document_id"), T.read(spark, d, "reviewer_labels", "document_id")
    one = lambda name, df: df.agg(F.count("*").alias("ids")).select(F.lit(name).alias("part"), "ids")
    return one("both", a.intersect(b)).unionByName(one("assessed_only", a.subtract(b))).unionByName(one("labelled_only", b.subtract(a)))


@query(
    "document_union",
    f"""WITH {T.SQL_CAPS}, blogs AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1)
SELECT 'instagram' AS origin, document_id, coalesce(nullif(event_year, ''), 'Unknown') AS event_year, length(original_text) AS chars FROM caps UNION ALL SELECT 'review', document_id, coalesce(nullif(event_year, ''), 'Unknown'), length(original_text) FROM blogs""",
)
def document_union(spark, d):
    """Two sources in one schema."""
    a = T.captions(spark, d, "event_year", "original_text").withColumn("origin", F.lit("instagram"))
    b = T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "event_year", "original_text", "ingested_at"), ["document_id"], F.col("ingested_at")).withColumn("origin", F.lit("review"))
    return a.unionByName(b).select("origin", "document_id", T.filled("event_year", "Unknown").alias("event_year"), F.length("original_text").cast("bigint").alias("chars"))
