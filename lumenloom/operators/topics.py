"""Vectors, term weights and the comparison of groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators.cube import ratio


#: Query vectors that may be broadcast.
QUERIES = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean vector per group (A23): sums per dimension, partial before the shuffle, then put together by position."""
    per = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return v.select(group, unit(F.col("v")).alias("centroid"))


def nearest(queries: DataFrame, targets: DataFrame, k: int, q_id: str = "q_id", t_id: str = "t_id") -> DataFrame:
    """The k targets of highest cosine for each query (W9). ``queries`` (id, vector) is a stated set: up to ``QUERIES`` of them are
    broadcast and the targets stream past them; more meet the targets block by block of partitions. Each task keeps its k best
    before the shuffle."""
    q = queries.select(q_id, unit(F.col("vector")).alias("qv"))
    t = targets.select(t_id, unit(F.col("vector")).alias("tv"))
    q = F.broadcast(q) if queries.count() <= QUERIES else q
    x = t.crossJoin(q).select(q_id, t_id, dot(F.col("qv"), F.col("tv")).alias("cosine"))
    w = W.partitionBy(q_id).orderBy(F.desc(F.round("cosine", 12)), t_id)
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def tf_idf(terms: DataFrame, group: str, term: str) -> DataFrame:
    """Smooth inverse frequency over groups times counts, rows of unit length."""
    tf = terms.groupBy(group, term).agg(F.count("*").alias("tf"))
    df_ = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = tf.select(group).distinct().agg(F.count("*").alias("n"))
    x = tf.join(df_, term).crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df")).cast("double")) + 1))
    return x.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(group)))).select(group, term, "tf", "df", "weight")


def class_tf_idf(terms: DataFrame, group: str, term: str) -> DataFrame:
    """Count in the class times log(1 + mean class size / count anywhere) (C4)."""
    tf = terms.groupBy(group, term).agg(F.count("*").alias("tf"))
    all_ = tf.groupBy(term).agg(F.sum("tf").alias("f"))
    size = tf.agg((F.sum("tf") / F.countDistinct(group).cast("double")).alias("a"))
    return tf.join(all_, term).crossJoin(F.broadcast(size)).select(group, term, "tf", (F.col("tf") * F.log(1 + F.col("a") / F.col("f"))).alias("weight"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two groupings from their contingency counts."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    s = c.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    sa = c.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    sb = c.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    x = s.crossJoin(sa).crossJoin(sb).withColumn("e", F.col("sa") * F.col("sb") / two(F.col("t")))
    return x.select(F.try_divide(F.col("s") - F.col("e"), (F.col("sa") + F.col("sb")) / 2 - F.col("e")).alias("ari"))


def topic_sizes(df: DataFrame, topic: str, outlier: int = -1) -> DataFrame:
    """Number, outliers and sizes of topics."""
    g = df.groupBy(topic).agg(F.count("*").alias("n"))
    real, n = F.col(topic) != outlier, F.col("n")
    size = F.when(real, n)
    return g.agg(F.count_if(real).alias("topics"), F.coalesce(F.sum(F.when(~real, n)), F.lit(0)).alias("outliers"), ratio(F.sum(F.when(~real, n).otherwise(0)), F.sum(n)).alias("outlier_share"), F.median(size).alias("median_size"), F.max(size).alias("largest"), F.min(size).alias("smallest"), F.count_if(real & (n < 30)).alias("under_30"), (F.max(size) > F.sum(n) / 2).alias("giant"))


def crosswalk(df: DataFrame, old: str, new: str) -> DataFrame:
    """How groups of one grouping go into those of another, with shares of the new one and the main source."""
    c = df.groupBy(old, new).agg(F.count("*").alias("n"))
    w = W.partitionBy(new)
    return c.withColumn("share", ratio(F.col("n"), F.sum("n").over(w))).withColumn("main", F.row_number().over(w.orderBy(F.desc("n"), old)) == 1)


def kmeans(df: DataFrame, vector: str, k: int, cut: float, seed: int = 1) -> DataFrame:
    """Clusters by k-means over unit vectors; rows farther than ``cut`` (cosine distance) from their centre are outliers, -1."""
    if df.isEmpty():
        return df.withColumn("topic", F.lit(-1))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("__u", unit(F.col(vector))).withColumn("features", array_to_vector("__u"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="topic").fit(x)
    centre = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    y = model.transform(x).withColumn("__c", unit(F.element_at(centre, F.col("topic") + 1)))
    near = dot(vector_to_array("features"), F.col("__c"))
    return y.withColumn("topic", F.when(1 - near > cut, -1).otherwise(F.col("topic"))).drop("__u", "features", "__c")
