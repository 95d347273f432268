"""Extension, not part of the reference: new deliveries as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def new_captions(spark: SparkSession, folder: str, schema, watermark: str = "30 days") -> DataFrame:
    """Captions as they arrive, each once: a second delivery inside the watermark is dropped."""
    s = spark.readStream.schema(schema).parquet(folder)
    return s.withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["document_id"])


def hourly_counts(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Arrivals by hour and source; late rows inside the watermark still count."""
    return stream.withWatermark("ingested_at", watermark).groupBy(F.window("ingested_at", "1 hour"), "source").agg(F.count("*").alias("captions"))


def upsert_batches(stream: DataFrame, target: str, keys: list[str], checkpoint: str):
    """Write a stream so that each key is there once, the first that arrived: every micro-batch is one folder, committed by name.

    A batch leaves out the keys that earlier batches have written; run again after a lost executor it writes the same
    folder again, as its own folder does not count as earlier.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if epoch:
            spark = batch.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                before = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).option("basePath", target).parquet(target).filter(F.col("batch") < epoch)
                fresh = fresh.join(before.select(*keys), keys, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
