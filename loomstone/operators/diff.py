"""Comparison of two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.scan import in_range


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that were added, removed or changed: keys, ``kind``, ``old``, ``new``.

    One full outer join on the keys. A null value differs from an absent row:
    presence is judged by a marker, never by the value.
    """
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_in_new"))
    joined = a.join(b, keys, "full_outer")
    kind = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "kind", "old", "new")


def range_diff(old: DataFrame, new: DataFrame, key: str, value: str, start=None, end=None, after=None) -> DataFrame:
    """The difference inside a key range; both scans are cut first."""
    inside = in_range(key, start, end, after)
    return diff_versions(old.where(inside), new.where(inside), [key], value)


def diff_page(old: DataFrame, new: DataFrame, key: str, value: str, limit: int, cursor=None):
    """Rows of a page of the difference and the next cursor, by looking one row ahead; limit 0 gives the cursor back."""
    from loomstone.operators.scan import Page

    if limit <= 0:
        return Page([], cursor)
    got = range_diff(old, new, key, value, after=cursor).orderBy(key).limit(limit + 1).collect()
    return Page(got[:limit], got[limit - 1][key] if len(got) > limit else None)


def row_hashes(columns: list[str], kinds: dict[str, str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row over its columns' names, null flags and values."""
    parts = []
    for name in sorted(columns):
        value = F.to_json(F.col(f"`{name}`")) if "map<" in kinds[name] or kinds[name] == "variant" else F.col(f"`{name}`")
        parts += [F.lit(name), F.col(f"`{name}`").isNull(), value]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def digest_columns(columns: list[str], kinds: dict[str, str]) -> list[Column]:
    """Aggregates n_rows, sum_a and sum_b, which don't depend on the order of rows and add up over parts."""
    a, b = row_hashes(columns, kinds)
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return [F.count("*").alias("n_rows"), total(a).alias("sum_a"), total(b).alias("sum_b")]


def joined_digest(sum_a, sum_b) -> str:
    """One text for two sums of row hashes, each modulo 2**64."""
    return f"{int(sum_a or 0) % (1 << 64):016x}{int(sum_b or 0) % (1 << 64):016x}"


def content_digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and digest: equal versions have equal digests whatever their files, and a null differs from any value."""
    seal = rows.agg(*digest_columns(rows.columns, dict(rows.dtypes))).first()
    return seal["n_rows"], joined_digest(seal["sum_a"], seal["sum_b"])


def pruned_diff(old: DataFrame, new: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """The difference, after key buckets of equal digests are dropped from both sides.

    Digests are partial sums, so what moves for the comparison is one row per
    bucket and task; only buckets that differ are joined. Versions of a store keep
    their digests by key range, so ``VersionStore.diff`` skips equal ranges unread.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    sums = ("n_rows", "sum_a", "sum_b")

    def digest(rows: DataFrame) -> DataFrame:
        found = rows.select(key, value)
        return found.groupBy(bucket.alias("bucket")).agg(*digest_columns(found.columns, dict(found.dtypes)))

    a, b = digest(old), digest(new).withColumnsRenamed({c: f"{c}_new" for c in sums})
    same = F.lit(True)
    for c in sums:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_new"))
    differing = a.join(b, "bucket", "full_outer").where(~same).select("bucket")
    cut = lambda rows: rows.withColumn("bucket", bucket).join(F.broadcast(differing), "bucket", "left_semi").drop("bucket")
    return diff_versions(cut(old), cut(new), [key], value)


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Numbers of rows by kind of change, and of those that are the same, as one row."""
    both = old.select(*keys, F.lit(1).alias("_o")).join(new.select(*keys, F.lit(1).alias("_n")), keys, "full_outer").agg(F.count("*").alias("n_keys"))
    kinds = diff_versions(old, new, keys, value).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")])
    return kinds.join(both).select("n_added", "n_removed", "n_changed", (F.col("n_keys") - F.col("n_added") - F.col("n_removed") - F.col("n_changed")).alias("n_same"))


def stream_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, handle, start=None, end=None) -> tuple[int, object]:
    """Hand differences in key order to a function until it returns something: (differences handed over, that).

    Differences reach the driver one partition at a time.
    """
    n, cut = 0, (lambda rows: rows.where(in_range(keys[0], start, end)))
    for row in diff_versions(cut(old), cut(new), keys, value).orderBy(*keys).toLocalIterator():
        n += 1
        if (stop := handle(row)) is not None:
            return n, stop
    return n, None
