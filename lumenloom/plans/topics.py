"""Term weights, centroids, neighbours, groupings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators import topics
from lumenloom.registry import query
from lumenloom.sources import tables as T

_WORDS = "SELECT aspect, mention_id, unnest(regexp_extract_all(lower(coalesce(target, '') || ' ' || coalesce(english_gloss, '')), '[a-z]{3,}')) AS term FROM ments"
_M = f"WITH {T.SQL_MENTS}, w AS ({_WORDS})"


def _terms(spark, d):
    m = T.mentions(spark, d, "aspect", "target", "english_gloss")
    text = F.lower(F.concat(F.coalesce("target", F.lit("")), F.lit(" "), F.coalesce("english_gloss", F.lit(""))))
    return m.select("aspect", F.explode(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))


@query("class_terms", _M + ", t AS (SELECT aspect, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM t GROUP BY 1), a AS (SELECT sum(tf)::DOUBLE / count(DISTINCT aspect) AS a FROM t) SELECT aspect, term, tf, round(tf * ln(1 + a / f), 8) AS weight FROM t JOIN f USING (term) CROSS JOIN a QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY round(tf * ln(1 + a / f), 8) DESC, term) <= 10")
def class_terms(spark, d):
    """Terms of each aspect by class weights, ten each (C4)."""
    x = topics.class_tf_idf(_terms(spark, d), "aspect", "term").withColumn("weight", F.round("weight", 8))
    w = W.partitionBy("aspect").orderBy(F.desc("weight"), "term")
    return x.withColumn("r", F.row_number().over(w)).filter("r <= 10").drop("r")


@query("term_weights", _M + ", t AS (SELECT aspect, term, count(*) AS tf FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), x AS (SELECT *, tf * (ln((1 + (SELECT count(DISTINCT aspect) FROM t)) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f USING (term)) SELECT aspect, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY aspect)), 8) AS weight FROM x")
def term_weights(spark, d):
    """Smooth TF-IDF rows of unit length."""
    return topics.tf_idf(_terms(spark, d), "aspect", "term").withColumn("weight", F.round("weight", 8))


@query("label_centroids", "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS v FROM p GROUP BY 1) SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def label_centroids(spark, d):
    """Cosines between the centroids of labels."""
    c = topics.centroids(T.read(spark, d, "embeddings"), "label", "embedding")
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("va")), c.select(F.col("label").alias("b"), F.col("centroid").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(topics.dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("nearest_vectors", "WITH q AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT q_id, e.vec_id AS t_id, list_dot_product(q.v, e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS c FROM q JOIN embeddings e ON e.vec_id <> q_id) SELECT q_id, t_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY q_id ORDER BY round(c, 12) DESC, t_id) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(c, 12) DESC, t_id) <= 10")
def nearest_vectors(spark, d):
    """Every fiftieth vector against all rows, exact."""
    e = T.read(spark, d, "embeddings", "vec_id", "embedding")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"))
    n = topics.nearest(q, e.select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("vector")), 11)
    w = W.partitionBy("q_id").orderBy(F.desc(F.round("cosine", 12)), "t_id")
    return n.filter("q_id <> t_id").withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 10").withColumn("cosine", F.round("cosine", 6))


@query("grouping_agreement", "WITH c AS (SELECT primary_content_type AS a, event_connection AS b, count(*)::DOUBLE AS n FROM relevance_assessments GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), sa AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) AS ari FROM s, sa, sb")
def grouping_agreement(spark, d):
    """Adjusted Rand index of two groupings."""
    return topics.rand_index(T.read(spark, d, "relevance_assessments"), "primary_content_type", "event_connection").select(F.round("ari", 9).alias("ari"))


@query("topic_profile", "WITH g AS (SELECT CASE WHEN label = 9 THEN -1 ELSE label END AS topic, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) FILTER (topic <> -1) AS topics, CAST(coalesce(sum(n) FILTER (topic = -1), 0) AS BIGINT) AS outliers, coalesce(sum(n) FILTER (topic = -1), 0)::DOUBLE / sum(n) AS outlier_share, median(n) FILTER (topic <> -1) AS median_size, max(n) FILTER (topic <> -1) AS largest, min(n) FILTER (topic <> -1) AS smallest, count(*) FILTER (topic <> -1 AND n < 30) AS under_30, max(n) FILTER (topic <> -1) > sum(n) / 2 AS giant FROM g")
def topic_profile(spark, d):
    """Sizes of topics with one of them as outliers."""
    return topics.topic_sizes(T.read(spark, d, "embeddings", "label").withColumn("topic", F.when(F.col("label") == 9, -1).otherwise(F.col("label"))), "topic")


@query("content_crosswalk", f"WITH {T.SQL_ASSESS}, c AS (SELECT event_connection, primary_content_type, count(*) AS n FROM assess GROUP BY ALL) SELECT event_connection, primary_content_type, n, n::DOUBLE / sum(n) OVER (PARTITION BY primary_content_type) AS share, row_number() OVER (PARTITION BY primary_content_type ORDER BY n DESC, event_connection) = 1 AS main FROM c")
def content_crosswalk(spark, d):
    """Contribution of one grouping to another."""
    return topics.crosswalk(T.assessments(spark, d), "event_connection", "primary_content_type")


@query("embedding_clusters")
def embedding_clusters(spark, d):
    """Clusters with a cut-off for outliers."""
    return topics.kmeans(T.read(spark, d, "embeddings", "vec_id", "embedding"), "embedding", 10, 0.6).select("vec_id", "topic")


@query("theme_policy", f"WITH {T.SQL_MENTS}, a AS (SELECT aspect, count(*) AS mentions, count(DISTINCT document_id) AS documents FROM ments WHERE aspect IS NOT NULL GROUP BY 1) SELECT aspect, mentions, documents, mentions >= 60 AND documents >= 40 AS clustered, CAST(least(50, greatest(10, ceil(sqrt(mentions)))) AS BIGINT) AS min_size, CAST(greatest(3, floor(least(50, greatest(10, ceil(sqrt(mentions)))) / 3)) AS BIGINT) AS min_samples FROM a")
def theme_policy(spark, d):
    """Whether an aspect has the support for clustering, and with which sizes."""
    a = T.mentions(spark, d, "aspect").filter("aspect IS NOT NULL").groupBy("aspect").agg(F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"))
    size = F.least(F.lit(50), F.greatest(F.lit(10), F.ceil(F.sqrt("mentions"))))
    return a.select("aspect", "mentions", "documents", ((F.col("mentions") >= 60) & (F.col("documents") >= 40)).alias("clustered"), size.cast("bigint").alias("min_size"), F.greatest(F.lit(3), F.floor(size / 3)).cast("bigint").alias("min_samples"))


@query("aspect_term_overlap", _M + ", s AS (SELECT aspect, list(DISTINCT term) AS terms FROM w GROUP BY 1) SELECT a.aspect AS a, b.aspect AS b, len(list_intersect(a.terms, b.terms))::DOUBLE / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) AS jaccard FROM s a JOIN s b ON a.aspect < b.aspect")
def aspect_term_overlap(spark, d):
    """Jaccard of term sets over pairs of aspects, by counting shared terms."""
    t = _terms(spark, d).distinct()
    size = t.groupBy("aspect").agg(F.count("*").alias("n"))
    a, b = t.select("term", F.col("aspect").alias("a")), t.select("term", F.col("aspect").alias("b"))
    both = a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sa, sb = size.select(F.col("aspect").alias("a"), F.col("n").alias("na")), size.select(F.col("aspect").alias("b"), F.col("n").alias("nb"))
    grid = sa.join(F.broadcast(sb), F.col("a") < F.col("b"))
    j = grid.join(both, ["a", "b"], "left").fillna(0, ["both"])
    return j.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both")).cast("double")).alias("jaccard"))


@query("nearest_in_group", "WITH q AS (SELECT vec_id AS q_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT q_id, e.vec_id AS t_id, round(list_dot_product(q.v, e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS cosine FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.q_id) SELECT q_id, t_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, t_id) AS rank FROM x QUALIFY rank <= 3")
def nearest_in_group(spark, d):
    """Every fiftieth vector against all rows of its own group, exact (W9): the three best of each task are kept before the shuffle."""
    e = T.read(spark, d, "embeddings", "vec_id", "label", "embedding").select("vec_id", "label", topics.unit(F.col("embedding")).alias("v"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "label", F.col("v").alias("qv"))
    j = e.join(q, "label").filter("q_id <> vec_id").select("q_id", F.col("vec_id").alias("t_id"), F.round(topics.dot(F.col("qv"), F.col("v")), 9).alias("cosine"))
    w = W.partitionBy("q_id").orderBy(F.desc("cosine"), "t_id")
    return j.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3").withColumn("cosine", F.round("cosine", 6))
