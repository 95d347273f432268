"""Stratified, proportional, weighted and leakage-free samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators import sampling
from lumenloom.registry import query
from lumenloom.sources import tables as T

_CAPS = f"WITH {T.SQL_CAPS}"
_STRATA = "SELECT coalesce(nullif(lang, ''), 'unknown') AS stratum, count(*) AS n FROM documents GROUP BY 1"
_QUOTA = f"""s AS ({_STRATA}), f AS (SELECT *, CAST(floor(n::DOUBLE * 200 / (SELECT sum(n) FROM s) + 1e-9) AS BIGINT) AS fl FROM s), q AS (SELECT stratum, n, fl + CASE WHEN row_number() OVER (ORDER BY round(n::DOUBLE * 200 / (SELECT sum(n) FROM s) - fl, 9) DESC, stratum) <= 200 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f)"""


def _quotas(df):
    return sampling.proportional(df.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "n", 200)


@query("allocation", f"WITH {_QUOTA} SELECT stratum, n, CAST(quota AS BIGINT) AS quota FROM q")
def allocation(spark, d):
    """200 documents over the languages, largest remainder first."""
    return _quotas(T.read(spark, d, "documents", "lang").select(T.filled("lang").alias("stratum")))


@query("proportional_sample", f"WITH {_QUOTA} SELECT doc_id, stratum, position FROM (SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS stratum, row_number() OVER (PARTITION BY coalesce(nullif(lang, ''), 'unknown') ORDER BY sha256('audit-1|' || doc_id), doc_id) AS position FROM documents) JOIN q USING (stratum) WHERE position <= quota")
def proportional_sample(spark, d):
    """The allocation drawn."""
    df = T.read(spark, d, "documents", "doc_id", "lang")
    return sampling.stratified(df, T.filled("lang"), "doc_id", _quotas(df.select(T.filled("lang").alias("stratum"))).select("stratum", "quota"), "audit-1").select("doc_id", "stratum", "position")


@query("quota_sample", f"{_CAPS} SELECT document_id, stratum, position FROM (SELECT document_id, coalesce(nullif(language_status, ''), 'unknown') AS stratum, row_number() OVER (PARTITION BY coalesce(nullif(language_status, ''), 'unknown') ORDER BY sha256('pilot|' || document_id), document_id) AS position FROM caps) WHERE position <= 5")
def quota_sample(spark, d):
    """The same number of each stratum."""
    c = T.captions(spark, d, "language_status")
    q = c.select(T.filled("language_status").alias("stratum")).distinct().withColumn("quota", F.lit(5))
    return sampling.stratified(c, T.filled("language_status"), "document_id", q, "pilot").select("document_id", "stratum", "position")


@query("fresh_holdout", f"{_CAPS} SELECT document_id FROM caps c WHERE NOT EXISTS (SELECT 1 FROM reviewer_labels r WHERE r.document_id = c.document_id) ORDER BY sha256('holdout|' || document_id), document_id LIMIT 100")
def fresh_holdout(spark, d):
    """100 captions nobody has labelled."""
    c = T.captions(spark, d).join(T.read(spark, d, "reviewer_labels", "document_id"), "document_id", "left_anti").select("document_id")
    return c.orderBy(sampling.draw("holdout", "document_id"), "document_id").limit(100)


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(original_text, '')), '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '#[\\p{L}\\p{N}_]+', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("leakage_free_frame", f"""{_CAPS}, k AS (SELECT document_id, {_KEY} AS key, primary_language FROM caps), dev AS (SELECT DISTINCT key FROM k WHERE document_id IN (SELECT document_id FROM reviewer_labels)),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY document_id) AS rn FROM k WHERE length(key) >= 8 AND document_id NOT IN (SELECT document_id FROM reviewer_labels) AND key NOT IN (SELECT key FROM dev)), l AS (SELECT coalesce(nullif(primary_language, ''), 'unknown') AS l, count(*) AS n FROM f WHERE rn = 1 GROUP BY 1)
SELECT document_id, CASE WHEN n < 30 THEN 'other' ELSE l END AS language_group FROM f JOIN l ON l.l = coalesce(nullif(primary_language, ''), 'unknown') WHERE rn = 1""")
def leakage_free_frame(spark, d):
    """Captions that share neither id nor text with the labelled ones, one per text, rare languages together (P5)."""
    c = T.captions(spark, d, "original_text", "primary_language").select("document_id", X.leakage_key(F.col("original_text")).alias("key"), T.filled("primary_language").alias("l"))
    dev = T.read(spark, d, "reviewer_labels", "document_id")
    used = c.join(dev, "document_id", "left_semi").select("key").distinct()
    f = c.filter(F.length("key") >= 8).join(dev, "document_id", "left_anti").join(used, "key", "left_anti")
    f = f.groupBy("key").agg(F.min(F.struct("document_id", "l")).alias("x")).select("x.document_id", "x.l")
    n = f.groupBy("l").agg(F.count("*").alias("n"))
    return f.join(F.broadcast(n), "l").select("document_id", F.when(F.col("n") < 30, "other").otherwise(F.col("l")).alias("language_group"))


@query("weighted_sample", "SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln((('0x' || substr(sha256('enrich|' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / n_chars, doc_id LIMIT 100")
def weighted_sample(spark, d):
    """100 documents, longer ones likelier."""
    df = T.read(spark, d, "documents", "doc_id", "n_chars")
    return sampling.weighted(df, F.col("n_chars"), "doc_id", 100, "enrich").select("doc_id")


@query("coverage_sample")
def coverage_sample(spark, d):
    """Twenty mentions that show as many aspects, sentiments and languages as possible."""
    m = T.mentions(spark, d, "aspect", "sentiment", "mention_language")
    rows = sampling.coverage_sample(m, "mention_id", "document_id", ["aspect", "sentiment", "mention_language"], 20)
    return spark.createDataFrame([(r["mention_id"], r["document_id"]) for r in rows], "mention_id string, document_id string")
