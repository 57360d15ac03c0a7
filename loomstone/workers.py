"""Letting Python workers import this package from where the driver has it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def reachable(spark: SparkSession | None = None) -> SparkSession | None:
    """Add the package's folder to the workers' path, for functions made from here on; the session, or the active one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))
    return spark
