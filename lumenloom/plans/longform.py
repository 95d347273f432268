"""Long reviews: units and roll-up from parts to their parent."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators import chunking, cube
from lumenloom.registry import query
from lumenloom.sources import tables as T

_B = "WITH blogs AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1)"


def _reviews(spark, d, *cols):
    return T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "ingested_at", *cols), ["document_id"], F.col("ingested_at"))


@query("review_units")
def review_units(spark, d):
    """Reviews in units of 120 tokens."""
    return chunking.units(_reviews(spark, d, "original_text"), "document_id", "original_text", 120)


@query("document_units")
def document_units(spark, d):
    """All documents in units of 500 tokens."""
    return chunking.units(T.read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 500).drop("text")


_SOLID = "regexp_replace({}, '[\\s\\x{{00a0}}]', '', 'g')"


@query("unit_caps", f"{_B} SELECT 'review' AS kind, document_id AS id, TRUE AS within_cap, sha256({_SOLID.format('original_text')}) AS content FROM blogs WHERE trim(original_text) <> '' UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), TRUE, sha256({_SOLID.format('text')}) FROM documents WHERE trim(text) <> ''")
def unit_caps(spark, d):
    """Units of reviews and documents checked: none above its cap, and together they are the whole text but for blanks."""
    out = None
    for kind, df, key, text, cap in (("review", _reviews(spark, d, "original_text"), "document_id", "original_text", 120), ("document", T.read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 500)):
        u = chunking.units(df, key, text, cap)
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "")
        one = u.groupBy(key).agg(F.bool_and(F.col("tokens") <= cap).alias("within_cap"), F.sha2(F.regexp_replace(whole, "[\\s\\x{00a0}]", ""), 256).alias("content"))
        one = one.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "within_cap", "content")
        out = one if out is None else out.unionByName(one)
    return out


@query("source_audit", f"{_B} SELECT coalesce(nullif(event_year, ''), 'Unknown') AS event_year, count(*) AS reviews, count(*) FILTER (coalesce(original_text, '') = '') AS without_text, count(*) FILTER (coalesce(author, '') = '') AS without_author, count(*) FILTER (coalesce(title, '') = '') AS without_title, min(length(original_text)) AS shortest, max(length(original_text)) AS longest FROM blogs GROUP BY 1")
def source_audit(spark, d):
    """What a source lacks."""
    miss = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return _reviews(spark, d, "event_year", "original_text", "author", "title").groupBy(T.filled("event_year", "Unknown").alias("event_year")).agg(F.count("*").alias("reviews"), miss("original_text").alias("without_text"), miss("author").alias("without_author"), miss("title").alias("without_title"), F.min(F.length("original_text")).cast("bigint").alias("shortest"), F.max(F.length("original_text")).cast("bigint").alias("longest"))


@query("document_sentiment", f"WITH {T.SQL_MENTS} SELECT document_id, aspect, count(*) AS mentions, CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment) ELSE 'mixed' END AS sentiment FROM ments WHERE document_id IS NOT NULL GROUP BY ALL")
def document_sentiment(spark, d):
    """Mentions to their document: the label they share, else mixed."""
    return cube.roll_up(T.mentions(spark, d, "aspect", "sentiment").filter("document_id IS NOT NULL"), "document_id", ["aspect"], "sentiment")


@query("experience_class", f"WITH {T.SQL_MENTS} SELECT document_id, CASE WHEN bool_or(sentiment = 'mixed') OR (bool_or(sentiment = 'positive') AND bool_or(sentiment = 'negative')) THEN 'mixed' WHEN bool_or(sentiment = 'positive') THEN 'positive' WHEN bool_or(sentiment = 'negative') THEN 'negative' ELSE 'neutral' END AS experience FROM ments WHERE document_id IS NOT NULL GROUP BY 1")
def experience_class(spark, d):
    """Class of a document by which sentiments it holds."""
    has = lambda s: F.bool_or(F.col("sentiment") == s)
    c = F.when(has("mixed") | (has("positive") & has("negative")), "mixed").when(has("positive"), "positive").when(has("negative"), "negative").otherwise("neutral")
    return T.mentions(spark, d, "sentiment").filter("document_id IS NOT NULL").groupBy("document_id").agg(c.alias("experience"))
