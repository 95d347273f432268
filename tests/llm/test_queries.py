"""The queries of this subpackage on the smallest tables: schemas, keys, and what holds for every result."""

import os

import pytest
from pyspark.sql import functions as F

from lumenloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_containers_hold_every_token_once(spark):
    df = queries.p7_containers(spark, SF).persist()
    assert df.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t")).join(spark.read.parquet(f"{SF}/container_specs.parquet"), "spec_name").filter("t > capacity_tokens").count() == 0
    per = {r["spec_name"]: r["t"] for r in df.groupBy("spec_name").agg(F.sum("tokens").alias("t")).collect()}
    assert len(per) == 4 and len(set(per.values())) == 1
    assert df.groupBy("spec_name", "doc_id", "piece").count().filter("count > 1").count() == 0


def test_shares_are_reported_for_every_target(spark):
    shares = queries.p8_shares(spark, SF)
    assert shares.count() == spark.read.parquet(f"{SF}/mix_targets.parquet").count()
    assert shares.filter("most_repeats > 0").join(spark.read.parquet(f"{SF}/mix_targets.parquet").select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).filter("most_repeats > max_repeats").count() == 0


def test_networks_are_fitted_once(spark, monkeypatch):
    calls = []
    train = lambda rows: calls.append(1) or {"n": len(rows)}
    assert queries._fitted(train, [("a", 1)]) is queries._fitted(train, [("a", 1)]) and len(calls) == 1
    queries._fitted(train, [("b", 1)])
    assert len(calls) == 2


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
    with pytest.raises(ValueError, match="checkpoint"):
        queries._kept(Frame())


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """The tables without rows, and with rows that are NULL, empty, repeated or very long."""
    empty, odd = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("odd")
    long = "word " * 20_000
    for name in ("instagram_captions", "absa_mentions", "blog_reviews", "reviewer_labels", "raw_posts", "documents", "container_specs", "mix_targets"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
        if name in ("container_specs", "mix_targets"):
            df.write.parquet(f"{odd}/{name}.parquet")
            continue
        key = next(c for c in ("doc_id", "record_id", "mention_id", "document_id") if c in df.columns)
        text = next((c for c in ("original_text", "evidence_text", "payload", "text") if c in df.columns), None)
        some = df.limit(3)
        none = some.select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        rows = some.unionByName(none).unionByName(some)
        if text:
            for i, value in enumerate(("", long, "​", "🏅" * 3000)):
                new = (F.lit(-1 - i) if dict(df.dtypes)[key] == "bigint" else F.concat(F.lit(f"x{i}"), F.col(key))).cast(dict(df.dtypes)[key])
                rows = rows.unionByName(some.limit(1).withColumn(text, F.lit(value)).withColumn(key, new))
        rows = rows.filter(F.col(key).isNotNull()).dropDuplicates() if name == "documents" else rows
        if name == "documents":
            rows = rows.dropDuplicates([key])
        rows.withColumn("kinds", F.lit(1)).withColumn("tokens", F.lit(2)).withColumn("score", F.lit(3)).write.parquet(f"{odd}/{name}.parquet")
    return str(empty), str(odd)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_and_odd_rows(spark, bare, name, monkeypatch):
    # few rounds: this is about rows, not about what is learned
    fit_language, fit_abuse = queries.language.train, queries.abuse.train
    monkeypatch.setattr(queries.language, "train", lambda rows: fit_language(rows, steps=(2, 2)))
    monkeypatch.setattr(queries.abuse, "train", lambda rows, others: fit_abuse(rows, others, epochs=1))
    empty, odd = bare
    nothing = queries.QUERIES[name](spark, empty).collect()
    assert nothing == [] or name in ("p8_shares", "p7_fill")
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == len(set(map(str, rows)))
