"""Non-unique secondary indexes as derived tables of (term, pk, projection)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.scan import in_range


def build(rows: DataFrame, pk: str, term: Column, *projection: str, many: bool = False) -> DataFrame:
    """Index entries of a table: one per row, or one per element with ``many``; rows without a term have none.

    Equal emissions of one row collapse. The projection is part of the row, so a
    (term, pk) pair has one projection by construction.
    """
    terms = rows.select(F.col(pk).alias("pk"), *projection, F.explode(F.array_distinct(term)).alias("term")) if many else rows.select(F.col(pk).alias("pk"), *projection, term.alias("term"))
    return terms.where(F.col("term").isNotNull()).select("term", "pk", *projection)


def stored(index: DataFrame, partitions: int) -> DataFrame:
    """The index in its physical order, by ranges of (term, pk), for writing."""
    return index.repartitionByRange(partitions, "term", "pk").sortWithinPartitions("term", "pk")


def exact(index: DataFrame, term: Any) -> DataFrame:
    """Entries of one term in (term, pk) order."""
    return index.where(F.col("term") == F.lit(term)).orderBy("term", "pk")


def prefix(index: DataFrame, start: str) -> DataFrame:
    """Entries whose term starts with a prefix."""
    return index.where(F.startswith(F.col("term"), F.lit(start))).orderBy("term", "pk")


def term_range(index: DataFrame, start: Any = None, end: Any = None, descending: bool = False) -> DataFrame:
    """Entries of a half-open range of terms, forward or reverse."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("term", "pk")]
    return index.where(in_range("term", start, end)).orderBy(*order)


def page(index: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """Entries behind (term, pk), in order."""
    rows = index
    if after is not None:
        rows = index.where((F.col("term") > F.lit(after[0])) | ((F.col("term") == F.lit(after[0])) & (F.col("pk") > F.lit(after[1]))))
    return rows.orderBy("term", "pk").limit(limit)


def budgeted(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more than ``most``; counts one row more at the most."""
    if rows.limit(most + 1).count() > most:
        raise RuntimeError(f"query budget of {most} rows exceeded")
    return rows


def join_back(entries: DataFrame, source: DataFrame, pk: str) -> DataFrame:
    """Source rows of index entries; an entry whose row is missing is an error."""
    found = entries.join(source.withColumn("_present", F.lit(True)), entries["pk"] == source[pk], "left")
    checked = F.when(F.col("_present").isNull(), F.raise_error(F.concat(F.lit("no row for index entry "), F.col("pk").cast("string")))).otherwise(F.col("pk"))
    return found.withColumn("pk", checked).drop("_present")


def apply_diff(index: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Next state of an index: without the entries of changed rows' old values, with those of the new ones."""
    return index.join(before.select("term", "pk"), ["term", "pk"], "left_anti").unionByName(after)


def verify(index: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Entries that are missing or too many, compared with a fresh build."""
    missing = rebuilt.exceptAll(index).withColumn("problem", F.lit("missing"))
    return missing.unionByName(index.exceptAll(rebuilt).withColumn("problem", F.lit("surplus")))


def normalized_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def canonical_path(path: Column) -> Column:
    """A path with single slashes, one in front and none behind."""
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(path, "/+", "/"), F.lit("/")))
