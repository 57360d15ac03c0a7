"""Aggregates kept beside their source: statistics, incremental views, compaction, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Money as whole cents."""
    return F.round(amount * 100).cast("bigint")


def view(rows: DataFrame, group: list[str], amount: str) -> DataFrame:
    """Count and sum per group."""
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sum(amount).alias("total"))


def signed_changes(diff: DataFrame, group: list[str], amount: str) -> DataFrame:
    """Rows of a difference as additions and subtractions. ``old`` and ``new`` are structs of group and amount."""
    rows = F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")))
    flat = diff.select(F.explode(rows).alias("c")).where(F.col("c.row").isNotNull())
    sign = F.col("c.sign").cast("bigint")
    return flat.select(*[F.col("c.row")[g].alias(g) for g in group], sign.alias("d_rows"), (sign * F.col("c.row")[amount]).alias("d_total"))


def maintain(current: DataFrame, diff: DataFrame, group: list[str], amount: str) -> DataFrame:
    """Next state of a view from the changes of its source; groups without rows go."""
    delta = signed_changes(diff, group, amount).groupBy(*group).agg(F.sum("d_rows").alias("d_rows"), F.sum("d_total").alias("d_total"))
    joined = current.join(delta, group, "full_outer")
    add = lambda a, b: F.coalesce(F.col(a), F.lit(0).cast("bigint")) + F.coalesce(F.col(b), F.lit(0).cast("bigint"))
    return joined.select(*group, add("n_rows", "d_rows").alias("n_rows"), add("total", "d_total").alias("total")).where("n_rows > 0")


def compact_window(log: DataFrame, run: str, sequence: str, first: int, last: int, payload: str, summary: str) -> DataFrame:
    """Replace events of a window of each run by one summary row with their number."""
    inside = F.col(sequence).between(first, last)
    kept = log.where(~inside).select(run, sequence, payload, F.lit(1).cast("bigint").alias("n_events"))
    packed = log.where(inside).groupBy(run).agg(F.min(sequence).alias(sequence), F.lit(summary).alias(payload), F.count("*").alias("n_events"))
    return kept.unionByName(packed.select(run, sequence, payload, "n_events"))


FIVE_YEARS = 5 * 365 * 24 * 3600


def ttl_candidates(rows: DataFrame, ttl: str, now: int) -> DataFrame:
    """Rows whose expiry, a whole non-negative number of seconds, has passed, by five years at the most."""
    text = F.col(ttl).cast("string")
    seconds = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return rows.where(F.coalesce((seconds <= now) & (seconds >= now - FIVE_YEARS), F.lit(False)))


def stats_change(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Per field of two one-row statistics: before, after, change and percentage."""
    tall = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(side)) for f in fields])).alias("s")).select("s.*")
    both = tall(before, "before").join(tall(after, "after"), "field")
    change = F.col("after") - F.col("before")
    return both.select("field", "before", "after", change.alias("change"), F.try_divide(change * 100, F.col("before")).alias("percent"))


def term_overlap(rows: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """Texts by the number of query terms that they hold as substrings, lower-cased; ties by key."""
    terms = sorted({t for t in query.lower().split() if t})
    score = sum((F.contains(F.lower(F.col(text)), F.lit(t)).cast("int") for t in terms), F.lit(0)).cast("bigint")
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(limit)


def summary_index(rows: DataFrame, pk: str, terms: dict[str, Column]) -> DataFrame:
    """(term, value, n_rows, first_pk, last_pk) of each named term: a summary rebuilt from the rows, by partial aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), c.cast("string").alias("value")) for n, c in terms.items()])).alias("t")
    flat = rows.select(F.col(pk).alias("pk"), pairs).where(F.col("t.value").isNotNull())
    return flat.groupBy("t.term", "t.value").agg(F.count("*").alias("n_rows"), F.min("pk").alias("first_pk"), F.max("pk").alias("last_pk"))
