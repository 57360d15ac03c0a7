"""Graphs of content-addressed nodes: walks, collection and copies by set operations.

Nodes are rows (cid, kind, children): a digest, a type and the digests that the
node refers to. A walk goes level by level over nodes not seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.integrity import missing
from loomstone.staging import Staged, fresh_path


class LimitExceeded(RuntimeError):
    """The graph is larger or deeper than it may be."""


def walk(nodes: DataFrame, roots: DataFrame, most_nodes: int | None = None, most_levels: int | None = None) -> DataFrame:
    """(cid, kind, level) of every node reachable from ``roots`` (cid), at its least level; a node that is referred to and missing is an error."""
    spark = nodes.sparkSession
    path, kind = fresh_path(spark, "walk"), dict(nodes.dtypes)["cid"]
    known = nodes.select("cid", "kind", "children")
    level, wanted = 0, roots.select("cid").distinct()
    while True:
        found = wanted.join(known.select("cid", "kind"), "cid", "left")
        checked = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("no node "), F.col("cid")))).otherwise(F.col("kind"))
        found.select("cid", checked.alias("kind"), F.lit(level).alias("level")).write.mode("append").parquet(path)
        seen = spark.read.schema(f"cid {kind}, kind string, level int").parquet(path)
        last = seen.where(F.col("level") == level)
        if last.isEmpty():
            return seen
        if most_nodes is not None and seen.count() > most_nodes:
            raise LimitExceeded(f"more than {most_nodes} nodes")
        if most_levels is not None and level >= most_levels:
            raise LimitExceeded(f"more than {most_levels} levels")
        children = known.join(last.select("cid"), "cid", "left_semi").select(F.explode("children").alias("cid")).distinct()
        wanted, level = children.join(seen.select("cid"), "cid", "left_anti"), level + 1


def plan_collection(nodes: DataFrame, roots: DataFrame, candidates: DataFrame | None = None, **limits) -> DataFrame:
    """Nodes, of the candidates if there are any, that no root reaches."""
    live = walk(nodes, roots, **limits).select("cid")
    return missing(nodes if candidates is None else candidates.join(nodes.select("cid"), "cid", "left_semi"), live)


def collect(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """The nodes that a plan leaves."""
    return nodes.join(plan.select("cid"), "cid", "left_anti")


def copy_graph(source: DataFrame, destination: DataFrame, roots: DataFrame, **limits) -> DataFrame:
    """The destination with every node of the roots' graphs that it lacked."""
    reached = walk(source, roots, **limits).select("cid")
    lacking = Staged(missing(reached, destination), "lacking")
    return destination.unionByName(source.join(lacking.df, "cid", "left_semi").select(*destination.columns))
