from pyspark.sql import functions as F

from lumenloom.streaming import incremental


def test_redelivered_captions_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-01 10:30:00")], "document_id string, t string")
    df = df.select("document_id", F.lit("s").alias("source"), F.to_timestamp("t").alias("ingested_at"))
    df.write.parquet(str(tmp_path / "in"))
    s = incremental.new_captions(spark, str(tmp_path / "in"), df.schema)
    incremental.upsert_batches(s, str(tmp_path / "out"), ["document_id"], str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_key_of_an_earlier_batch_is_not_written_again(spark, tmp_path):
    schema = "k string, v int"
    for i, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2), ("c", 2)], [("c", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.upsert_batches(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 2)}
