"""The domain tables as the operators read them: one row per key, '' and NULL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table; naming columns prunes the scan."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def filled(c: Column | str, other: str = "unknown") -> Column:
    """A string with NULL and '' replaced."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def one_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order: what was delivered again is dropped."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def captions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Captions, the first delivery of each."""
    cols = list(dict.fromkeys(["document_id", "ingested_at", *columns]))
    return one_per_key(read(spark, sf_dir, "instagram_captions", *cols), ["document_id"], F.col("ingested_at"))


def mentions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Mentions, the first delivery of each."""
    cols = list(dict.fromkeys(["mention_id", "document_id", "created_at", *columns]))
    return one_per_key(read(spark, sf_dir, "absa_mentions", *cols), ["mention_id"], F.col("created_at"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance assessments, the latest of each document: later rows win."""
    return one_per_key(read(spark, sf_dir, "relevance_assessments"), ["document_id"], F.desc("assessed_at"), F.desc_nulls_last("confidence"), F.col("event_connection"), F.col("primary_content_type"))


# The same in SQL, as common table expressions for the statements that check the queries.
SQL_CAPS = "caps AS (SELECT * FROM instagram_captions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1)"
SQL_MENTS = "ments AS (SELECT * FROM absa_mentions QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY created_at) = 1)"
SQL_ASSESS = "assess AS (SELECT * FROM relevance_assessments QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY assessed_at DESC, confidence DESC NULLS LAST, event_connection, primary_content_type) = 1)"
