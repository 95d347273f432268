"""Raw exports into tables, keyed merges, sinks and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.registry import query
from lumenloom.sources import files, scratch
from lumenloom.sources import tables as T


@query("parsed_posts", "SELECT record_id, coalesce(json_extract_string(payload, '$.ownerId'), json_extract_string(payload, '$.author.id')) AS author_id, json_extract_string(payload, '$.url') AS url, lower(json_extract_string(payload, '$.hashtag')) AS hashtag, CAST(json_extract_string(payload, '$.likesCount') AS BIGINT) AS likes, json_extract_string(payload, '$.location.name') AS place, md5(json_extract_string(payload, '$.caption')) AS caption_md5 FROM raw_posts")
def parsed_posts(spark, d):
    """Two historical shapes in one table."""
    p = files.posts(T.read(spark, d, "raw_posts", "record_id", "payload"), F.col("payload"), ["record_id"])
    return p.select("record_id", "author_id", "url", "hashtag", "likes", "place", F.md5("caption").alias("caption_md5"))


@query("export_profile", "SELECT export_name, count(*) AS records, CAST(epoch(min(exported_at)) AS BIGINT) AS first_export, CAST(epoch(max(exported_at)) AS BIGINT) AS last_export, count(DISTINCT json_extract_string(payload, '$.ownerId')) AS authors FROM raw_posts GROUP BY 1")
def export_profile(spark, d):
    """What each export holds."""
    p = files.posts(T.read(spark, d, "raw_posts"), F.col("payload"), ["record_id", "export_name", "exported_at"])
    return p.groupBy("export_name").agg(F.count("*").alias("records"), F.unix_timestamp(F.min("exported_at")).alias("first_export"), F.unix_timestamp(F.max("exported_at")).alias("last_export"), F.countDistinct("author_id").alias("authors"))


@query("upserted_assessments", "WITH fresh AS (SELECT * FROM relevance_assessments WHERE assessed_at >= TIMESTAMPTZ '2026-03-01' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY assessed_at DESC, confidence DESC NULLS LAST, event_connection, primary_content_type) = 1), old AS (SELECT * FROM relevance_assessments WHERE assessed_at < TIMESTAMPTZ '2026-03-01' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY assessed_at DESC, confidence DESC NULLS LAST, event_connection, primary_content_type) = 1) SELECT document_id, confidence FROM old WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT document_id, confidence FROM fresh")
def upserted_assessments(spark, d):
    """Fresh rows replace old ones by key."""
    a = T.read(spark, d, "relevance_assessments")
    one = lambda x: T.one_per_key(x, ["document_id"], F.desc("assessed_at"), F.desc_nulls_last("confidence"), F.col("event_connection"), F.col("primary_content_type"))
    cut = F.lit("2026-03-01").cast("timestamp")
    return files.upsert(one(a.filter(F.col("assessed_at") < cut)), one(a.filter(F.col("assessed_at") >= cut)), ["document_id"]).select("document_id", "confidence")


@query("uncached_requests", "SELECT document_id, sha256('v1|' || document_id) AS key FROM (SELECT DISTINCT document_id FROM instagram_captions) WHERE document_id NOT IN (SELECT document_id FROM relevance_assessments)")
def uncached_requests(spark, d):
    """Captions without an answer in the keyed table."""
    key = files.cache_key(F.lit("v1"), F.col("document_id"))
    req = T.read(spark, d, "instagram_captions", "document_id").distinct().withColumn("key", key)
    return files.to_score(req, T.read(spark, d, "relevance_assessments", "document_id").withColumn("key", key), "key")


# --- sinks and readers, written in the shared folder and read back -----------------------------------------------------------------------

_B = "WITH b AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1)"


def _reviews(spark, d, *columns: str):
    return T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "ingested_at", *columns), ["document_id"], F.col("ingested_at")).select("document_id", *columns)


@query("csv_round_trip", _B + " SELECT document_id, coalesce(author, '') AS author, coalesce(title, '') AS title, sha256(coalesce(original_text, '')) AS content FROM b")
def csv_round_trip(spark, d):
    """Reviews as CSV, every column a string, nothing read as missing: line feeds, quotes and empty fields come back as they were."""
    path = scratch.folder(spark)
    columns = ["document_id", "author", "title", "original_text"]
    _reviews(spark, d, *columns[1:]).fillna("").write.csv(path, header=True, quoteAll=True, escape='"')
    r = files.read_csv_strings(spark, path, columns)
    return r.select("document_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("author", "title")], F.sha2(F.coalesce("original_text", F.lit("")), 256).alias("content"))


@query("paired_sink", "WITH c AS (SELECT * FROM instagram_captions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1) SELECT document_id, len(coalesce(hashtags, [])) AS tags, CASE WHEN len(hashtags) > 0 THEN hashtags[1] END AS first_tag FROM c")
def paired_sink(spark, d):
    """Captions written as Parquet and as CSV with lists as JSON, and the lists read back from the CSV."""
    path = scratch.folder(spark)
    files.write_pair(T.captions(spark, d, "hashtags").select("document_id", "hashtags"), path)
    r = files.read_csv_strings(spark, f"{path}/csv", ["document_id", "hashtags"])
    tags = F.coalesce(F.from_json("hashtags", "array<string>"), F.array().cast("array<string>"))
    return r.select("document_id", F.size(tags).cast("bigint").alias("tags"), F.try_element_at(tags, F.lit(1)).alias("first_tag"))


@query("json_lines_round_trip", _B + " SELECT document_id, sha256(coalesce(original_text, '') || chr(8232) || 'x') AS content, FALSE AS malformed FROM b UNION ALL SELECT NULL, NULL, TRUE")
def json_lines_round_trip(spark, d):
    """Reviews as JSON lines with line separators inside the data, and one line that is no JSON: only line feeds end a record."""
    path = scratch.folder(spark)
    r = _reviews(spark, d, "original_text").select(F.to_json(F.struct("document_id", F.concat(F.coalesce("original_text", F.lit("")), F.lit(" x")).alias("t"))).alias("value"))
    r.unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    back = files.read_json_lines(spark, path, "document_id string, t string")
    return back.select("document_id", F.sha2("t", 256).alias("content"), F.col("malformed").isNotNull().alias("malformed"))


@query("request_files", "WITH c AS (SELECT count(DISTINCT document_id) AS n FROM instagram_captions) SELECT CAST(n AS BIGINT) AS requests, TRUE AS files_within_size, TRUE AS all_parse FROM c")
def request_files(spark, d):
    """One request a caption, at most 500 a file, written and read back."""
    path = scratch.folder(spark)
    c = T.captions(spark, d, "original_text")
    files.write_requests(c, path, F.struct(F.col("document_id").alias("custom_id"), F.struct(F.coalesce("original_text", F.lit("")).alias("text")).alias("body")), 500)
    r = spark.read.text(path).select(F.input_file_name().alias("f"), F.get_json_object("value", "$.custom_id").isNotNull().alias("ok"))
    per = r.groupBy("f").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
    return per.agg(F.sum("n").alias("requests"), F.bool_and(F.col("n") <= 500).alias("files_within_size"), F.bool_and("ok").alias("all_parse"))


@query("request_numbers", "WITH c AS (SELECT DISTINCT document_id FROM instagram_captions), r AS (SELECT (row_number() OVER (ORDER BY document_id) - 1) // 500 AS file_number FROM c) SELECT CAST(file_number AS BIGINT) AS file_number, count(*) AS requests FROM r GROUP BY 1")
def request_numbers(spark, d):
    """File number of each request in a total order, by ranges first."""
    c = T.read(spark, d, "instagram_captions", "document_id").distinct()
    return files.chunk_numbers(c, [F.col("document_id")], 500).groupBy("file_number").agg(F.count("*").alias("requests"))


@query("run_manifest", "SELECT * FROM (VALUES ('first', (SELECT count(*) FROM nation)), ('second', (SELECT count(*) FROM region))) t(run, \"rows\")")
def run_manifest(spark, d):
    """Two runs appended to a manifest and read back."""
    path = scratch.folder(spark)
    for run, table in (("first", "nation"), ("second", "region")):
        files.append_manifest(T.read(spark, d, table).agg(F.count("*").alias("rows")).withColumn("run", F.lit(run)), path)
    return spark.read.schema("run string, rows bigint").json(path).select("run", "rows")


@query("bundle_verification", "SELECT 'changed' AS state, 1 AS files UNION ALL SELECT 'new', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'same', 1")
def bundle_verification(spark, d):
    """Files against a frozen list of hashes: unchanged, changed, new and missing ones."""
    path = scratch.folder(spark)
    for name, rows in (("a", 1), ("b", 2), ("c", 3)):
        spark.range(rows).select(F.lit(name).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    now = files.file_manifest(spark, path, "part-*").select(F.regexp_extract("path", "([abc])/part", 1).alias("path"), "sha256")
    frozen = now.filter("path <> 'c'").withColumn("sha256", F.when(F.col("path") == "b", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("d", "0")], "path string, sha256 string"))
    states = files.changed_files(now, frozen).select("state").unionByName(now.join(frozen, ["path", "sha256"]).select(F.lit("same").alias("state")))
    return states.groupBy("state").agg(F.count("*").cast("int").alias("files"))


@query("collected_ids", "SELECT DISTINCT document_id AS id FROM reviewer_labels WHERE reviewer_id = 'rev_a' UNION SELECT DISTINCT document_id FROM relevance_assessments WHERE event_connection = 'none'")
def collected_ids(spark, d):
    """Ids from CSV files in nested folders, found by patterns, whatever their id column is called."""
    path = scratch.folder(spark)
    T.read(spark, d, "reviewer_labels", "document_id", "reviewer_id").filter("reviewer_id = 'rev_a'").write.csv(f"{path}/x/labels", header=True)
    T.read(spark, d, "relevance_assessments", "document_id", "event_connection").filter("event_connection = 'none'").select("event_connection", F.col("document_id").alias("record_id")).write.csv(f"{path}/y/z/checks", header=True)
    return files.collect_ids(spark, path, ["part-*.csv"])


@query("validated_join", "WITH c AS (SELECT document_id, event_year FROM instagram_captions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1), a AS (SELECT document_id, confidence FROM relevance_assessments QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY assessed_at DESC, confidence DESC NULLS LAST, event_connection, primary_content_type) = 1) SELECT document_id, event_year, confidence FROM c JOIN a USING (document_id)")
def validated_join(spark, d):
    """A join that refuses keys that are not unique."""
    return files.one_to_one(T.captions(spark, d, "event_year").select("document_id", "event_year"), T.assessments(spark, d).select("document_id", "confidence"), ["document_id"])


@query("replaced_table", "SELECT count(*) AS \"rows\", TRUE AS stale_write_refused FROM region")
def replaced_table(spark, d):
    """A table replaced twice; a writer that read the first version is refused."""
    path = scratch.folder(spark)
    first = files.replace_atomically(T.read(spark, d, "nation"), path)
    files.replace_atomically(T.read(spark, d, "region"), path, first)
    try:
        files.replace_atomically(T.read(spark, d, "nation"), path, first)
        refused = False
    except ValueError:
        refused = True
    return files.current(spark, path).agg(F.count("*").alias("rows")).withColumn("stale_write_refused", F.lit(refused))
