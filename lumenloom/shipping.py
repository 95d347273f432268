"""Python workers need this package: it is added to the application once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_lumenloom_shipped"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of a session (Spark's file server hands it out); further calls do nothing."""
    sc = spark.sparkContext
    if not getattr(sc, _MARK, False):
        here = Path(__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="lumenloom-"), "lumenloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, Path("lumenloom") / p.relative_to(here))
        sc.addPyFile(target)
        setattr(sc, _MARK, True)
    return spark
