"""Written tables in the shared folder of the session, for sources and sinks that must be read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/lumenloom-{uuid.uuid4().hex}"
