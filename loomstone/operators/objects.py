"""Versioned objects: listings, byte ranges, version histories and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.diff import diff_versions
from loomstone.operators.merge import align, is_conflict


def list_objects(objects: DataFrame, prefix: str = "", limit: int = 1000, after: str | None = None) -> DataFrame:
    """Keys with a prefix, in order, behind a continuation key."""
    found = objects.where(F.startswith(F.col("key"), F.lit(prefix)))
    return (found.where(F.col("key") > F.lit(after)) if after is not None else found).orderBy("key").limit(limit)


def list_delimited(objects: DataFrame, prefix: str, delimiter: str, limit: int, after: str | None = None) -> DataFrame:
    """Objects and common prefixes of a page. The limit counts objects before they are grouped."""
    rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
    at = F.position(F.lit(delimiter), rest)
    entry = F.when(at > 0, F.concat(F.lit(prefix), F.substr(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col("key"))
    page = list_objects(objects, prefix, limit, after).select(entry.alias("entry"), F.when(at > 0, "prefix").otherwise("object").alias("kind"))
    return page.groupBy("entry", "kind").agg(F.count("*").alias("n_objects"))


def versions(history: DataFrame, per_key: int | None = None) -> DataFrame:
    """Versions of each key, newest first."""
    order = Window.partitionBy("key").orderBy(F.col("generation").desc(), F.col("version_id").desc())
    numbered = history.withColumn("nth", F.row_number().over(order))
    return numbered.where(F.col("nth") <= per_key) if per_key else numbered


def live(history: DataFrame) -> DataFrame:
    """The current version of each key that isn't deleted: one aggregation, no sort."""
    others = [c for c in history.columns if c != "key"]
    newest = F.max_by(F.struct(*others), F.struct("generation", "version_id")).alias("_v")
    return history.groupBy("key").agg(newest).select("key", *[F.col("_v")[c].alias(c) for c in others]).where(~F.col("deleted"))


def object_range(objects: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Bytes start..end (end excluded) of one object."""
    return objects.where(F.col("key") == F.lit(key)).select("key", F.substring("payload", start + 1, end - start).alias("payload"))


def object_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose version differs: (key, from_version, to_version)."""
    found = diff_versions(old, new, ["key"], "version_id")
    return found.select("key", F.col("old").alias("from_version"), F.col("new").alias("to_version"))


def merge_objects(base: DataFrame, ours: DataFrame, theirs: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of object versions. ``fail`` keeps ours and lists conflicts; they must be empty to publish."""
    if policy not in ("fail", "ours", "theirs"):
        raise ValueError(f"unknown policy {policy}")
    aligned = align(base, ours, theirs, "key", "version_id")
    winner = F.col("right") if policy == "theirs" else F.col("left")
    changed_right = F.col("left").eqNullSafe(F.col("base"))
    merged = aligned.select("key", F.when(is_conflict(), winner).when(changed_right, F.col("right")).otherwise(F.col("left")).alias("version_id"))
    return merged.where(F.col("version_id").isNotNull()), aligned.where(is_conflict())
