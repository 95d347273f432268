"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import abuse, copies, language, lookalike, mixing, mojibake, packing, pii, residue
from lumenloom.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _pieces(df: DataFrame) -> DataFrame:
    """Spread rows over the cores before a stage of Python: a small file is one split."""
    spark = df.sparkSession
    want = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


_networks: dict[str, tuple[str, dict]] = {}


def _fitted(train: Callable, *samples: list) -> dict:
    """A network fitted on bounded samples; queries one after another that draw the same samples fit it once."""
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    name = f"{train.__module__}.{train.__qualname__}"
    if _networks.get(name, ("",))[0] != key:
        _networks[name] = key, train(*samples)
    return _networks[name][1]


# --- 1 ---------------------------------------------------------------------------------------------------------------------------------


def _p1_network(spark: SparkSession, sf_dir: str) -> dict:
    caps = _read(spark, sf_dir, "instagram_captions", "document_id", "original_text", "primary_language", "language_status")
    sure = caps.filter(~F.coalesce(F.lower(F.trim("language_status")), F.lit("")).isin("mixed", "undetermined", "no_text", "insufficient_text"))
    return _fitted(language.train, language.sample_rows(sure, "original_text", language.known(F.col("primary_language")), "document_id"))


def _p1_labelled(spark: SparkSession, sf_dir: str, stretches: bool) -> DataFrame:
    """Captions with ``found`` (parts; with ``stretches`` these too), every whole text read by the network."""
    caps = _read(spark, sf_dir, "instagram_captions", "document_id", "original_text", "primary_language", "language_status")
    return _pieces(caps.filter(F.length("original_text") > 0)).withColumn("found", language.detector(spark, _p1_network(spark, sf_dir), stretches)("original_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _p1_labelled(spark, sf_dir, stretches=False)
    df = df.select("document_id", language.known(F.col("primary_language")).alias("label"), (F.coalesce(F.lower(F.trim("language_status")), F.lit("")) == "mixed").alias("marked"), F.col("found.parts").alias("parts"))
    names = F.transform("parts", lambda x: x["language"])
    has = F.coalesce(F.array_contains(names, F.col("label")), F.lit(False))
    wrong = F.when(F.size("parts") >= 2, ~has | ~F.col("marked")).otherwise((F.size("parts") == 1) & ~has)
    return df.filter(wrong).select("document_id", F.explode(names).alias("language")).distinct()


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _p1_labelled(spark, sf_dir, stretches=True)
    df = df.select("document_id", F.posexplode("found.stretches").alias("stretch_index", "s"))
    return df.select("document_id", "stretch_index", "s.stretch_text", "s.language", "s.letters", F.round("s.confidence", 4).alias("confidence")).distinct()


# --- 2 -----------------------------------------------------------------------------------------------------------------------------------


def _p2_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Every text field of the problem, and the name parts learned from all of them."""
    captions = _read(spark, sf_dir, "instagram_captions", "document_id", "original_text").withColumnsRenamed({"document_id": "record_id", "original_text": "t"})
    mentions = _read(spark, sf_dir, "absa_mentions", "mention_id", "evidence_text").withColumnsRenamed({"mention_id": "record_id", "evidence_text": "t"})
    parts = pii.learn_parts([captions.select("t"), mentions.select("t")])
    both = captions.select(F.lit("instagram_captions").alias("record_table"), "record_id", F.lit("original_text").alias("field_name"), "t")
    both = both.unionByName(mentions.select(F.lit("absa_mentions").alias("record_table"), "record_id", F.lit("evidence_text").alias("field_name"), "t"))
    return both, parts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, parts = _p2_texts(spark, sf_dir)
    found = pii.detect(_pieces(both.filter(F.length("t") > 0)), "t", parts)
    return found.select("record_table", "record_id", F.explode(F.array_distinct(F.col("pii.pii_type"))).alias("pii_type")).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, parts = _p2_texts(spark, sf_dir)
    return pii.detect(_pieces(both), "t", parts).select("record_table", "record_id", "field_name", "redacted_text", F.coalesce(F.size("pii"), F.lit(0)).alias("replaced")).distinct()


# --- 3 ---------------------------------------------------------------------------------------------------------------------------------


def _p3_scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    caps = _read(spark, sf_dir, "instagram_captions", "document_id", "original_text", *more)
    texts = caps.select("document_id", "original_text")
    params = _fitted(abuse.train, abuse.sample_rows(_read(spark, sf_dir, "reviewer_labels", "document_id", "offensive"), texts), abuse.sample_plain(texts))
    return _pieces(caps).withColumn("score", abuse.scorer(spark, params)("original_text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3_scored(spark, sf_dir).filter(F.col("score") > abuse.THRESHOLD).select("document_id").distinct()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3_scored(spark, sf_dir).groupBy("document_id").agg(F.round(F.max("score"), 4).alias("score"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source, year of collection and language; a post delivered twice counts once. The language is that of the text (problem 1), not its label."""
    df = _p3_scored(spark, sf_dir, "source", "ingested_at").withColumn("found", language.detector(spark, _p1_network(spark, sf_dir), stretches=False)("original_text"))
    main = F.coalesce(F.try_element_at("found.parts", F.lit(1))["language"], F.lit("none"))
    one = df.groupBy("document_id").agg(F.max("score").alias("score"), F.min(F.struct("ingested_at", "source", main.alias("language"))).alias("first"))
    return one.groupBy(F.coalesce("first.source", F.lit("unknown")).alias("source"), F.year("first.ingested_at").alias("collection_year"), F.col("first.language").alias("language")).agg(
        F.count("*").alias("captions"), F.count_if(F.col("score") > abuse.THRESHOLD).alias("abusive"), F.round(F.avg((F.col("score") > abuse.THRESHOLD).cast("double")), 6).alias("rate")
    )


# --- 4 -----------------------------------------------------------------------------------------------------------------------------------


def _p4_parts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, object]]:
    return [
        ("instagram_captions", _read(spark, sf_dir, "instagram_captions", "document_id", "original_text", "linguistic_text"), "document_id", copies.caption_key()),
        ("raw_posts", _read(spark, sf_dir, "raw_posts", "record_id", "payload"), "record_id", copies.json_key(F.col("payload"))),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (copies.copy_pairs(df, i, k).select(F.lit(t).alias("record_table"), "keep_id", "copy_id") for t, df, i, k in _p4_parts(spark, sf_dir))
    return a.unionByName(b)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (
        copies.group_copies(df, i, k).filter("member_id = keep_id").select(F.lit(t).alias("record_table"), "keep_id", F.col("copies").cast("bigint").alias("copies")) for t, df, i, k in _p4_parts(spark, sf_dir)
    )
    return a.unionByName(b)


_SQL_LD = "lower(upper(regexp_replace(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'), '[ßẞ]', 'ss', 'g')))"
_SQL_P4 = f"""
WITH caps AS (SELECT DISTINCT 'instagram_captions' AS record_table, document_id AS id, {_SQL_LD.format('original_text')} AS o, {_SQL_LD.format('linguistic_text')} AS l FROM instagram_captions),
tree AS (SELECT record_id, fullkey, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE {_SQL_LD.format("json_extract_string(atom, '$')")} END AS v FROM raw_posts, json_tree(payload)),
raws AS (SELECT 'raw_posts' AS record_table, record_id AS id, string_agg(fullkey || '=' || v, chr(2) ORDER BY fullkey) AS o, '' AS l FROM tree GROUP BY record_id),
both_ AS (SELECT * FROM caps WHERE o <> '' UNION ALL SELECT * FROM raws),
grouped AS (SELECT record_table, id, min(id) OVER (PARTITION BY record_table, o, l) AS keep_id, count(*) OVER (PARTITION BY record_table, o, l) AS copies FROM both_)
"""


# --- 5 -----------------------------------------------------------------------------------------------------------------------------------


def _p5_vocabulary(spark: SparkSession, sf_dir: str) -> lookalike.Words:
    return lookalike.vocabulary([_read(spark, sf_dir, "instagram_captions", "original_text"), _read(spark, sf_dir, "absa_mentions", "evidence_text")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _p5_vocabulary(spark, sf_dir)
    words = spark.sparkContext.broadcast(list(known))
    no = lookalike.not_ascii

    @F.pandas_udf("array<string>")
    def fields(texts: pd.Series, tags: pd.Series, more: pd.Series) -> pd.Series:
        listed = lookalike._worker_trie(words)
        out = []
        for t, h, own in zip(texts, tags, more, strict=True):
            trie, found = lookalike.joined(listed, own), []
            if t and lookalike.canonical(t, trie) != t:
                found.append("original_text")
            if h is not None and any(x and lookalike.canonical(x, trie) != x for x in h):
                found.append("hashtags")
            # a garbled caption is a case of problem 6 instead
            out.append([] if found and t and mojibake.repair(t)[1] else found)
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def differs(texts: pd.Series, more: pd.Series) -> pd.Series:
        trie = lookalike._worker_trie(words)
        return pd.Series([bool(t) and lookalike.canonical(t, lookalike.joined(trie, own)) != t and not mojibake.repair(t)[1] for t, own in zip(texts, more, strict=True)], dtype=bool)

    caps = _read(spark, sf_dir, "instagram_captions", "document_id", "original_text", "hashtags")
    caps = _pieces(caps.filter(no(F.col("original_text")) | F.exists("hashtags", no)))
    caps = lookalike.with_own(caps, F.concat(F.array("original_text"), F.coalesce("hashtags", F.array().cast("array<string>"))), known)
    a = caps.select(F.lit("instagram_captions").alias("record_table"), F.col("document_id").alias("record_id"), F.explode(fields.asNondeterministic()("original_text", "hashtags", "__own")).alias("field_name"))
    ment = _pieces(_read(spark, sf_dir, "absa_mentions", "mention_id", "evidence_text").filter(no(F.col("evidence_text"))))
    ment = lookalike.with_own(ment, F.array("evidence_text"), known)
    b = ment.filter(differs.asNondeterministic()("evidence_text", "__own")).select(F.lit("absa_mentions").alias("record_table"), F.col("mention_id").alias("record_id"), F.lit("evidence_text").alias("field_name"))
    return a.unionByName(b).distinct()


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the problem in its consistent form: texts in ``canonical_text``, hashtags in ``canonical_tags``."""
    words = _p5_vocabulary(spark, sf_dir)
    caps = _pieces(_read(spark, sf_dir, "instagram_captions", "document_id", "original_text", "hashtags"))
    ment = _pieces(_read(spark, sf_dir, "absa_mentions", "mention_id", "evidence_text"))
    caps = lookalike.normalize_all(lookalike.normalize(caps, "original_text", words), "hashtags", words)
    fields = [
        ("instagram_captions", "document_id", "original_text", caps.withColumn("canonical_tags", F.lit(None).cast("array<string>"))),
        ("instagram_captions", "document_id", "hashtags", caps.withColumn("canonical_text", F.lit(None).cast("string"))),
        ("absa_mentions", "mention_id", "evidence_text", lookalike.normalize(ment, "evidence_text", words).withColumn("canonical_tags", F.lit(None).cast("array<string>"))),
    ]
    out = None
    for table, key, field, df in fields:
        one = df.select(F.lit(table).alias("record_table"), F.col(key).alias("record_id"), F.lit(field).alias("field_name"), "canonical_text", "canonical_tags")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


# --- 6 -----------------------------------------------------------------------------------------------------------------------------------


def _p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_read(spark, sf_dir, t, "document_id", "original_text").withColumn("record_table", F.lit(t)) for t in ("instagram_captions", "blog_reviews")]
    both = parts[0].unionByName(parts[1]).filter(lookalike.not_ascii(F.col("original_text")))
    return mojibake.restore(_pieces(both)).filter("was_garbled")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_rows(spark, sf_dir).select("record_table", F.col("document_id").alias("record_id")).distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_rows(spark, sf_dir).select("record_table", F.col("document_id").alias("record_id"), "restored_text", "fully_restored").distinct()


# --- 7 ---------------------------------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their tokens, written once: counting tokens is the dear part and is used several times."""
    packing.share(spark)
    docs = _pieces(_read(spark, sf_dir, "documents", "doc_id", "text", *columns))
    return _kept(docs.select("doc_id", *columns, packing.count_tokens(F.col("text")).alias("tokens")))


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder that the session names; only a local session may go without and gets one of its own."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sized(spark, sf_dir)
    out = None
    for spec in sorted(_read(spark, sf_dir, "container_specs").collect(), key=lambda r: r["capacity_tokens"]):  # a small table of capacities
        one = packing.fill(docs, "doc_id", "tokens", spec["capacity_tokens"]).select(F.lit(spec["spec_name"]).alias("spec_name"), "container_id", F.col("item_id").alias("doc_id"), "piece", F.col("size").alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.limit(0).select(F.lit("").alias("spec_name"), F.lit(0).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece"), "tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _read(spark, sf_dir, "container_specs")
    used = p7_containers(spark, sf_dir).groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t"))
    j = used.join(F.broadcast(specs), "spec_name").groupBy("spec_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return j.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


# --- 8 ---------------------------------------------------------------------------------------------------------------------------------


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir, "source"), _read(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p8_mix(spark, sf_dir), _read(spark, sf_dir, "mix_targets"))


# --- 9 -----------------------------------------------------------------------------------------------------------------------------------


def _p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_read(spark, sf_dir, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(_p9_documents(spark, sf_dir)).select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.find_residue(_p9_documents(spark, sf_dir))
    return found.select("doc_id", F.explode("kinds").alias("k")).select("doc_id", F.col("k.kind").alias("kind"), F.round("k.coverage", 6).alias("coverage"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_redacted, p3_found, p3_scores, p3_rates, p4_found, p4_groups, p5_found, p5_canonical, p6_found, p6_restored, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_kinds)}

ORACLE: dict[str, str] = {
    "p4_found": _SQL_P4 + "SELECT record_table, keep_id, id AS copy_id FROM grouped WHERE id <> keep_id",
    "p4_groups": _SQL_P4 + "SELECT record_table, keep_id, CAST(copies AS BIGINT) AS copies FROM grouped WHERE id = keep_id",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
