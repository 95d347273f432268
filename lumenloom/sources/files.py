"""Readers and writers: JSON of several shapes, JSON lines, keyed upserts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A post as exported: two historical shapes in one schema, unknown fields are left out.
POST = "ownerId string, author struct<id:string>, url string, caption string, hashtag string, timestamp string, takenAt string, likesCount bigint, location struct<name:string,city:string>"


def posts(df: DataFrame, payload: Column, keep: list[str]) -> DataFrame:
    """JSON payloads of either shape as one table; what is no JSON has ``malformed`` and NULL fields."""
    schema = f"struct<{POST.replace(' string', ':string').replace(' bigint', ':bigint').replace(' struct', ':struct')}>"
    x = df.select(*keep, F.from_json(payload, schema, {"mode": "PERMISSIVE"}).alias("p"), payload.alias("raw"))
    ok = F.try_parse_json("raw").isNotNull()
    return x.select(*keep, F.coalesce("p.ownerId", "p.author.id").alias("author_id"), F.col("p.url").alias("url"), F.col("p.caption").alias("caption"), F.lower("p.hashtag").alias("hashtag"), F.coalesce("p.timestamp", "p.takenAt").alias("posted"), F.col("p.likesCount").alias("likes"), F.col("p.location.name").alias("place"), (~ok | F.col("raw").isNull()).alias("malformed"))


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every column a string and nothing read as missing."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), multiLine=True, escape='"', nullValue="\u0000", emptyValue="")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines split at line feeds only; lines that are no JSON are kept in ``malformed``."""
    lines = spark.read.text(path, lineSep="\n")
    x = lines.select("value", F.from_json("value", schema + ", malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}).alias("j"))
    return x.select("j.*")


def write_requests(df: DataFrame, path: str, body: Column, size: int) -> None:
    """One JSON object a line, at most ``size`` lines a file."""
    df.select(F.to_json(body).alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", size).text(path)


def write_pair(df: DataFrame, path: str) -> None:
    """Parquet, and CSV with nested columns as JSON (S6). Existing results are never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").csv(f"{path}/csv", header=True, quoteAll=True, escape='"')


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not among the fresh ones, and the fresh ones."""
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def cache_key(*parts: Column) -> Column:
    """Key of a cached answer: SHA-256 over the parts joined by '|' (S11)."""
    return F.sha2(F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [F.coalesce(p.cast("string"), F.lit(""))]]), 256)


def to_score(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests without a cached answer."""
    return requests.join(cache.select(key), key, "left_anti")


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that differ from a frozen manifest or are missing in it or from it."""
    a, b = now.select("path", F.col("sha256").alias("now")), frozen.select("path", F.col("sha256").alias("frozen"))
    return a.join(b, "path", "full").filter(~F.col("now").eqNullSafe(F.col("frozen"))).select("path", F.when(F.col("frozen").isNull(), "new").when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


def append_manifest(df: DataFrame, path: str) -> None:
    """Append-only log of runs."""
    df.write.mode("append").json(path)


def chunk_numbers(df: DataFrame, order: list[Column], size: int, parts: int = 64, first: int = 0) -> DataFrame:
    """``file_number`` of each row in a total order, ``size`` rows a file (S10), rows counted from ``first``: ranges first, then ranks inside them."""
    ranged = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy().orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).select("__p", F.coalesce("base", F.lit(0)).alias("base"))
    w = W.partitionBy("__p").orderBy(*order)
    return ranged.withColumn("__r", F.row_number().over(w)).join(F.broadcast(before), "__p").withColumn("file_number", F.floor((F.col("base") + F.col("__r") - 1 + first) / size).cast("bigint")).drop("__p", "__r", "base")


def collect_ids(spark: SparkSession, path: str, patterns: list[str], names: tuple[str, ...] = ("document_id", "record_id")) -> DataFrame:
    """Distinct ids from all CSV files below a path that match one of the patterns; the first of the names that a file's header has is its id.

    The header is the first line of each file; rows of all files are read in one scan.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}").text(path, wholetext=True)
    rows = lines.select(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n").alias("l")).select(F.split(F.element_at("l", 1), ",").alias("h"), F.explode(F.slice("l", 2, F.size("l"))).alias("row"))
    bare = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    at = F.coalesce(*[F.nullif(F.array_position(F.transform("h", bare), n), F.lit(0)) for n in names])
    return rows.filter(F.trim("row") != "").select(bare(F.try_element_at(F.split("row", ","), at.cast("int"))).alias("id")).filter("id IS NOT NULL AND id <> ''").distinct()


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of tables whose keys are unique on both sides; anything else is refused when rows are read."""
    check = lambda df, side: df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in df.columns if c not in keys]).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"keys of the {side} side are not unique"))).otherwise(F.lit(True))).filter("__ok").drop("__n", "__ok")
    return check(left, "left").join(check(right, "right"), keys)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, refused where columns are missing (F1)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df


def replace_atomically(df: DataFrame, path: str, token: str | None = None) -> str:
    """Write a table as a new version and switch the pointer to it; the version before stays as a backup.

    ``token`` is the version that the caller has read: where another one has been written since, nothing is replaced.
    Works on any file system that Spark can write; readers use ``current``.
    """
    import uuid

    spark = df.sparkSession
    if token != version(spark, path):
        raise ValueError("the table was replaced since it was read")
    new = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/{new}")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # the pointer is a directory whose name is the version: made in one step, the old one is removed afterwards
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer/{new}"))
    if token is not None:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer/{token}"), True)
    return new


def version(spark: SparkSession, path: str) -> str | None:
    """The version that a replaced table has now; None before the first."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p)))
    return names[-1][1] if names else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was last replaced."""
    return spark.read.parquet(f"{path}/{version(spark, path)}")
