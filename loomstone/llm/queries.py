"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import compression_quality, decontam, langid, license_scan, minhash, mixing, quality_rules, sstable, suffix_dedup, token_counts
from loomstone.workers import reachable

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def _against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ARROW_BYTES, ARROW_DEFAULT, ARROW_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(4 << 20)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound the batches that they get by bytes, unless the session does."""
    if spark.conf.get(ARROW_BYTES, ARROW_DEFAULT).rstrip("b") == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, ARROW_BOUND)
    return reachable(spark)


def queries() -> dict[str, Query]:
    """One query per operator, over whole tables."""
    return {name: (lambda spark, sf_dir, query=query: query(ready(spark), sf_dir)) for name, query in _queries().items()}


def _queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _over_documents(quality_rules.verdicts),
        "op2_token_shards": _over_documents(sstable.token_rows),
        "op3_license_scan": _over_documents(license_scan.scan),
        "op4_token_counts": _over_documents(token_counts.token_counts),
        "op5_suffix_dedup": _over_documents(suffix_dedup.deduplicate),
        "op6_decontamination": _against_benchmark,
        "op7_source_mix": _over_documents(mixing.taken_rows),
        "op8_near_duplicates": _over_documents(minhash.components),
        "op9_language_id": _over_documents(langid.predictions),
        "op10_quality_classifier": _with_labels,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op1_quality_rules": quality_rules.sql(),
        "op5_suffix_dedup": suffix_dedup.SQL,
        "op6_decontamination": decontam.SQL,
        "op7_source_mix": mixing.SQL,
        "op8_near_duplicates": minhash.SQL,
    }
