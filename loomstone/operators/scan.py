"""Ordered scans, keyset pages and order statistics over a keyed table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(key: str, start: Any = None, end: Any = None, after: Any = None) -> Column:
    """start <= key < end, or after < key; None leaves a side open. Reaches the scan as pushed filters."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(key) >= F.lit(start))
    if end is not None:
        found = found & (F.col(key) < F.lit(end))
    if after is not None:
        found = found & (F.col(key) > F.lit(after))
    return found


def scan(rows: DataFrame, key: str, start: Any = None, end: Any = None, after: Any = None, descending: bool = False) -> DataFrame:
    """Rows of a half-open key range in key order."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return rows.where(in_range(key, start, end, after)).orderBy(order)


def scan_prefix(rows: DataFrame, key: str, prefix: Any, descending: bool = False) -> DataFrame:
    """Rows whose key starts with a prefix, in key order."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return rows.where(F.startswith(F.col(key), F.lit(prefix))).orderBy(order)


@dataclass
class Page:
    """Rows of a page and where the next one starts; None: nothing follows."""

    rows: list
    cursor: Any


def page(rows: DataFrame, key: str, limit: int, cursor: Any = None, end: Any = None, prefix: Any = None) -> Page:
    """Forward page after a cursor. A full page always has a cursor, without looking ahead; limit 0 gives it back."""
    if limit <= 0:
        return Page([], cursor)
    found = rows.where(F.startswith(F.col(key), F.lit(prefix))) if prefix is not None else rows
    got = scan(found, key, end=end, after=cursor).limit(limit).collect()
    return Page(got, got[-1][key] if len(got) == limit else None)


def reverse_page(rows: DataFrame, key: str, limit: int, before: Any = None, start: Any = None, prefix: Any = None) -> Page:
    """Descending page below a cursor; looks one row ahead for the next cursor."""
    if limit <= 0:
        return Page([], before)
    rows = rows.where(F.startswith(F.col(key), F.lit(prefix))) if prefix is not None else rows
    got = scan(rows, key, start=start, end=before, descending=True).limit(limit + 1).collect()
    return Page(got[:limit], got[limit - 1][key] if len(got) > limit else None)


def get_many(rows: DataFrame, key: str, probes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per probe in its order, repeats kept, null where the key is missing. ``probes`` has (ordinal, key)."""
    return probes.join(rows, key, "left").orderBy(ordinal)


def rank(rows: DataFrame, key: str, value: Any) -> DataFrame:
    """Number of keys below a value."""
    return rows.where(F.col(key) < F.lit(value)).agg(F.count("*").alias("rank"))


def select(rows: DataFrame, key: str, ordinal: int, ranges: int = 64) -> DataFrame:
    """The row at a 0-based place in key order; none if out of range.

    Key ranges are counted first, then the place is sought in the one range that
    holds it, so no task sees more than that range.
    """
    if ordinal < 0:
        return rows.limit(0)
    ranged = rows.select(key).repartitionByRange(ranges, key).withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("_part").collect()
    for part in parts:
        if ordinal < part["n"]:
            return rows.where(F.col(key).between(F.lit(part["low"]), F.lit(part["high"]))).orderBy(key).offset(ordinal).limit(1)
        ordinal -= part["n"]
    return rows.limit(0)


def lower_bound(rows: DataFrame, key: str, value: Any) -> DataFrame:
    """First row at or above a key."""
    return rows.where(F.col(key) >= F.lit(value)).orderBy(key).limit(1)


def upper_bound(rows: DataFrame, key: str, value: Any) -> DataFrame:
    """First row above a key."""
    return rows.where(F.col(key) > F.lit(value)).orderBy(key).limit(1)


def first_last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest and largest key with their values, in one aggregation."""
    return rows.agg(
        F.min(key).alias("first_key"), F.min_by(value, key).alias("first_value"), F.max(key).alias("last_key"), F.max_by(value, key).alias("last_value")
    )


def cursor_window(rows: DataFrame, key: str, value: Any, limit: int) -> DataFrame:
    """Rows from a key on, each with the window's position and whether the key itself exists.

    The position is the key, else its predecessor, else its successor.
    """
    near = rows.agg(
        F.max(F.when(F.col(key) <= F.lit(value), F.col(key))).alias("below"), F.min(F.when(F.col(key) > F.lit(value), F.col(key))).alias("above")
    )
    at = near.select(F.coalesce("below", "above").alias("position"), F.coalesce(F.col("below") == F.lit(value), F.lit(False)).alias("found"))
    window = scan(rows, key, start=value).limit(limit)
    return window.join(F.broadcast(at))


def stats(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """Counts and byte sizes of keys and values: least, greatest, sum and mean."""
    k, v = F.octet_length(key).cast("long"), F.octet_length(value).cast("long")
    sizes = [f(x).cast("long").alias(f"{n}_{m}_bytes") for x, n in ((k, "key"), (v, "value")) for f, m in ((F.min, "min"), (F.max, "max"), (F.sum, "total"))]
    return rows.agg(F.count("*").alias("n_entries"), *sizes, *[F.avg(x).alias(f"{n}_avg_bytes") for x, n in ((k, "key"), (v, "value"))])


def range_stats(rows: DataFrame, key: str, value: str, ranges: int) -> DataFrame:
    """The same by key range: (part, low, high, n_entries, bytes), the shape of a stored table."""
    ranged = rows.select(key, F.octet_length(value).cast("long").alias("_n")).repartitionByRange(ranges, key)
    return ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n_entries"), F.sum("_n").alias("bytes"))


class Cursor:
    """A place in a keyed table: seek, look, step. Rows are fetched in blocks behind the place."""

    def __init__(self, rows: DataFrame, key: str, block: int = 256):
        self.rows, self.key, self.block = rows, key, block
        self.ahead: list = []
        self.last = None

    def seek(self, key: Any) -> bool:
        """Go to the first row at or above a key; whether the key itself is there."""
        self.ahead = scan(self.rows, self.key, start=key).limit(self.block).collect()
        self.last = None
        return bool(self.ahead) and self.ahead[0][self.key] == key

    def peek(self):
        """The row at the place; None at the end."""
        return self.ahead[0] if self.ahead else None

    def advance(self):
        """Step over the row at the place and give the next one."""
        if self.ahead:
            self.last = self.ahead.pop(0)[self.key]
            if not self.ahead:
                self.ahead = scan(self.rows, self.key, after=self.last).limit(self.block).collect()
        return self.peek()


def visit(rows: DataFrame, key: str, handle, start: Any = None, end: Any = None, descending: bool = False, prefix: Any = None) -> tuple[int, Any]:
    """Hand rows of a range or a prefix to a function in key order until it returns something; (rows visited, that).

    Rows reach the driver one partition at a time.
    """
    n = 0
    rows = rows.where(F.startswith(F.col(key), F.lit(prefix))) if prefix is not None else rows
    for row in scan(rows, key, start, end, descending=descending).toLocalIterator():
        n += 1
        if (stop := handle(row)) is not None:
            return n, stop
    return n, None
