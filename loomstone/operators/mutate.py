"""Row-level changes: every operator takes a version and returns the next one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.scan import in_range


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``. Partial aggregation keeps one row per key and task."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in others])


def apply_batch(base: DataFrame, changes: DataFrame, key: str, op: str = "op", ordinal: str | None = None) -> DataFrame:
    """Upserts and deletes by key; of several changes of one key the last by ``ordinal`` counts.

    ``changes`` has the columns of ``base`` and ``op`` ('upsert' or 'delete').
    """
    final = last_write_wins(changes, [key], [ordinal]) if ordinal else changes
    kept = base.join(final.select(key), key, "left_anti")
    return kept.unionByName(final.where(F.col(op) == "upsert").select(*base.columns))


def delete_range(base: DataFrame, key: str, start: Any, end: Any) -> DataFrame:
    """Without start <= key < end; an empty or reversed range changes nothing."""
    return base.where(~in_range(key, start, end))


def append(base: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """Rows behind all existing keys: a union without a shuffle; with ``key``, a row that isn't behind them is an error."""
    if key is None:
        return base.unionByName(rows)
    top = base.agg(F.max(key).alias("_top"))
    low = F.when(F.col(key) <= F.col("_top"), F.raise_error(F.lit("a row isn't behind all keys"))).otherwise(F.col(key))
    return base.unionByName(rows.join(F.broadcast(top)).withColumn(key, low).drop("_top"))


def batch_stats(base: DataFrame, changes: DataFrame, key: str, op: str = "op", ordinal: str | None = None) -> DataFrame:
    """What a batch does, as one row: changes given, keys touched, rows inserted, replaced, deleted, and left as they were."""
    final = last_write_wins(changes, [key], [ordinal]) if ordinal else changes
    values = [c for c in base.columns if c != key]
    known = base.select(key, F.struct(*values).alias("_was")) if values else base.select(key, F.lit(1).alias("_was"))
    met = final.withColumn("_new", F.struct(*values) if values else F.lit(1)).join(known, key, "left")
    upsert, there = F.col(op) == "upsert", F.col("_was").isNotNull()
    counts = {
        "n_keys": F.lit(True), "n_inserted": upsert & ~there, "n_replaced": upsert & there & ~F.col("_new").eqNullSafe(F.col("_was")),
        "n_deleted": ~upsert & there, "n_unchanged": (upsert & there & F.col("_new").eqNullSafe(F.col("_was"))) | (~upsert & ~there),
    }
    given = changes.agg(F.count("*").alias("n_input"))
    return given.join(met.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]))


TOMBSTONE = "struct<actor:string,millis:bigint,cause:map<string,string>>"


def tombstone(actor: Column, millis: Column, cause: Column | None = None) -> Column:
    """Who deleted a row, when, and what that rests on."""
    known = cause if cause is not None else F.create_map().cast("map<string,string>")
    return F.struct(actor.cast("string").alias("actor"), millis.cast("bigint").alias("millis"), known.alias("cause")).cast(TOMBSTONE)


def tombstone_bytes(stone: Column) -> Column:
    """A tombstone as bytes: a mark, then JSON."""
    return F.concat(F.lit(b"tomb1:"), F.to_json(stone).cast("binary"))


def tombstone_of(value: Column) -> Column:
    """The tombstone in a stored value; null where the value is none."""
    body = F.substring(value, F.lit(7), F.greatest(F.octet_length(value) - 6, F.lit(0)))
    return F.when(F.substring(value, F.lit(1), F.lit(6)) == F.lit(b"tomb1:"), F.from_json(body.cast("string"), "actor string, millis bigint, cause map<string,string>"))


def soft_delete(base: DataFrame, keys: DataFrame, key: str, stone: Column, deleted: str = "deleted") -> DataFrame:
    """Rows of some keys get a tombstone; one that has an earlier or equal one keeps the later of both."""
    hit = base.join(keys.select(key).withColumn("_hit", F.lit(True)), key, "left")
    later = F.when(F.col(deleted).isNull() | (F.col(deleted)["millis"] < stone["millis"]), stone).otherwise(F.col(deleted))
    return hit.withColumn(deleted, F.when(F.col("_hit"), later).otherwise(F.col(deleted))).select(*base.columns)


def apply_patch(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """Apply a difference (key, kind, old, new); fails on a row whose old value isn't the base's."""
    found = base.select(key, F.col(value).alias("_now"), F.lit(True).alias("_present"))
    joined = found.join(patch, key, "full_outer")
    stale = F.col("kind").isNotNull() & (
        F.when(F.col("kind") == "added", F.col("_present").isNotNull()).otherwise(F.col("_present").isNull() | ~F.col("_now").eqNullSafe(F.col("old")))
    )
    checked = F.when(stale, F.raise_error(F.lit("the patch is for another base"))).when(F.col("kind").isNull(), F.col("_now")).otherwise(F.col("new"))
    return joined.withColumn(value, checked).where(F.coalesce("kind", F.lit("")) != "removed").select(key, value)


def compact_tombstones(rows: DataFrame, deleted: str = "deleted", before: int | None = None) -> DataFrame:
    """Turn soft deletes into real ones, all of them or those from before a time; the column stays in the latter case."""
    if before is None:
        return rows.where(F.col(deleted).isNull()).drop(deleted)
    return rows.where(F.col(deleted).isNull() | (F.col(deleted)["millis"] >= before))


def build(entries: DataFrame, key: str, ordinal: str, partitions: int) -> DataFrame:
    """A table from unsorted entries, in key ranges; of several entries of a key the last by ``ordinal`` stays."""
    unique = last_write_wins(entries, [key], [ordinal]).drop(ordinal)
    return unique.repartitionByRange(partitions, key).sortWithinPartitions(key)


ORDINALS_PER_BLOCK, BLOCKS_PER_GROUP = 100_000, 10_000


def build_sorted(entries: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The same for sorted entries with whole-numbered ordinals; an entry below one before it is an error.

    Order is judged within blocks of ordinals, between the blocks of a group, and
    between groups, by the greatest key so far; a task sees one block, or one row
    per block of a group, or one row per group.
    """
    from pyspark.sql import Window

    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = entries.withColumn("_block", F.floor(F.col(ordinal) / ORDINALS_PER_BLOCK))
    tops = blocks.groupBy("_block").agg(F.max(key).alias("_top")).withColumn("_group", F.floor(F.col("_block") / BLOCKS_PER_GROUP))
    groups = tops.groupBy("_group").agg(F.max("_top").alias("_most"))
    before_group = groups.select("_group", F.max("_most").over(earlier(Window.orderBy("_group"))).alias("_below"))
    in_group = tops.withColumn("_run", F.max("_top").over(earlier(Window.partitionBy("_group").orderBy("_block"))))
    before = in_group.join(before_group, "_group").select("_block", F.coalesce(F.greatest("_run", "_below"), "_run", "_below").alias("_before"))
    within = Window.partitionBy("_block").orderBy(ordinal)
    checked = blocks.join(before, "_block").withColumn("_last", F.coalesce(F.lag(key).over(within), F.col("_before")))
    sorted_key = F.when(F.col(key) < F.col("_last"), F.raise_error(F.lit("entries aren't sorted"))).otherwise(F.col(key))
    return last_write_wins(checked.withColumn(key, sorted_key).drop("_block", "_before", "_last"), [key], [ordinal]).drop(ordinal)
