"""Versions of the driver's tables, derived by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 0 of ``orders``: key and status."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))


def left_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh key deleted, every tenth updated, some negative keys added."""
    base, k = base_version(spark, sf_dir), F.col("k")
    kept = base.where(k % 7 != 0).select("k", F.when(k % 10 == 0, "L").otherwise(F.col("v")).alias("v"))
    return kept.unionAll(base.where(k % 50 == 0).select((-k).alias("k"), F.lit("NL").alias("v")))


def right_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that partly agree and partly conflict with the left version."""
    base, k = base_version(spark, sf_dir), F.col("k")
    value = F.when(k % 20 == 0, "L").when(k % 10 == 0, "R").when(k % 11 == 0, "R2").otherwise(F.col("v"))
    kept = base.where(k % 13 != 0).select("k", value.alias("v"))
    return kept.unionAll(base.where(k % 70 == 0).select((-k).alias("k"), F.lit("NR").alias("v")))
