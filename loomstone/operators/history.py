"""Commit graphs: ancestry, logs and merge bases by level-wise expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.staging import fresh_path, staged


def ancestors(spark: SparkSession, edges: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """(id, depth) of every commit reachable from ``start``, at its least depth. ``edges`` has (child, parent).

    Levels are added one by one to a table in the shared folder until none is new;
    each holds the parents of the last one that no level holds yet, so every commit
    is visited once. Without a ``depth`` the whole history is walked.
    """
    path, kind = fresh_path(spark, "ancestors"), dict(edges.dtypes)["child"]
    links = staged(edges.where("parent IS NOT NULL").select("child", F.col("parent").cast(kind).alias("parent")).distinct(), "edges")
    level, found = 0, spark.range(1).select(F.lit(start).cast(kind).alias("id"))
    while True:
        found.select("id", F.lit(level).alias("depth")).write.mode("append").parquet(path)
        seen = spark.read.schema(f"id {kind}, depth int").parquet(path)
        last = seen.where(F.col("depth") == level)
        if level == depth or last.isEmpty():
            return seen
        parents = links.join(last, links["child"] == last["id"], "left_semi").select(F.col("parent").alias("id")).distinct()
        found, level = parents.join(seen.select("id"), "id", "left_anti"), level + 1


def is_ancestor(spark: SparkSession, edges: DataFrame, ancestor, descendant, depth: int | None = None) -> bool:
    """Whether one commit is reachable from another; a commit is its own ancestor."""
    return bool(ancestors(spark, edges, descendant, depth).where(F.col("id") == F.lit(ancestor)).limit(1).count())


def merge_base(spark: SparkSession, commits: DataFrame, edges: DataFrame, a, b, depth: int | None = None) -> DataFrame:
    """Best common ancestor: greatest generation, then least sum of distances, then least id."""
    left = ancestors(spark, edges, a, depth).withColumnRenamed("depth", "d_a")
    right = ancestors(spark, edges, b, depth).withColumnRenamed("depth", "d_b")
    common = left.join(right, "id").join(commits.select("id", "generation"), "id")
    return common.orderBy(F.col("generation").desc(), F.col("d_a") + F.col("d_b"), "id").limit(1)


def log(spark: SparkSession, edges: DataFrame, start, limit: int) -> DataFrame:
    """Ancestors breadth first: by depth, then id."""
    return ancestors(spark, edges, start).orderBy("depth", "id").limit(limit)


def retained(versions: DataFrame, keep: int, head: str) -> DataFrame:
    """The newest versions and the head. Without a time a version sorts last; ties by id."""
    newest = versions.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(keep)
    return newest.unionByName(versions.where(F.col("id") == F.lit(head))).distinct()


def younger_than(versions: DataFrame, since, head: str) -> DataFrame:
    """Versions since a time, those without one, and the head."""
    return versions.where((F.col("created_at") >= F.lit(since)) | F.col("created_at").isNull() | (F.col("id") == F.lit(head)))
