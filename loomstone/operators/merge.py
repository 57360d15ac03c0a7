"""Three-way merge of keyed versions, conflict rules and conflict-free merges.

Null stands for an absent row on each side, so values must not be null; an empty
value is a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.scan import in_range

UNRESOLVED, VALUE, DELETE = "unresolved", "value", "delete"
Resolver = Callable[[Column, Column, Column], tuple[Column, Column]]


def align(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base, left, right) of every key of the three versions: two joins on one partitioning."""
    named = [rows.select(key, F.col(value).alias(side)) for rows, side in ((base, "base"), (left, "left"), (right, "right"))]
    return named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def is_conflict() -> Column:
    """Both sides changed the base, differently."""
    return ~_same("left", "base") & ~_same("right", "base") & ~_same("left", "right")


def conflicts(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that need a decision, with all three values."""
    return align(base, left, right, key, value).where(is_conflict()).select(key, "base", "left", "right")


def prefer_left(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The left side, a deletion included."""
    return F.when(left.isNull(), DELETE).otherwise(VALUE), left


def prefer_right(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The right side, a deletion included."""
    return F.when(right.isNull(), DELETE).otherwise(VALUE), right


def delete_wins(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """A deletion on either side; nothing else is resolved."""
    return F.when(left.isNull() | right.isNull(), DELETE).otherwise(UNRESOLVED), F.lit(None)


def update_wins(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The side that isn't a deletion; two updates stay unresolved."""
    return F.when(left.isNull() != right.isNull(), VALUE).otherwise(UNRESOLVED), F.coalesce(left, right)


def use_base(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The value before both changes, or its absence."""
    return F.when(base.isNull(), DELETE).otherwise(VALUE), base


def resolve_custom(merge_values: Callable[[Column, Column, Column], Column], on_delete: Resolver | None = None) -> Resolver:
    """Two updates are merged by a function of columns (base, left, right); a deletion against an update goes to another rule, or stays."""

    def resolve(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
        deleted = left.isNull() | right.isNull()
        outcome, value = (on_delete or unresolved)(base, left, right)
        return F.when(deleted, outcome).otherwise(VALUE), F.when(deleted, value).otherwise(merge_values(base, left, right))

    return resolve


def unresolved(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """No rule: every conflict stays."""
    return F.lit(UNRESOLVED), F.lit(None)


RESOLVERS: dict[str, Resolver] = {
    "prefer_left": prefer_left,
    "prefer_right": prefer_right,
    "delete_wins": delete_wins,
    "update_wins": update_wins,
    "use_base": use_base,
    "unresolved": unresolved,
}


@dataclass
class Policy:
    """Rules by key; the newest that matches decides, then the default."""

    rules: list[tuple[Callable[[Column], Column], Resolver]]
    default: Resolver = unresolved

    def exact(self, key, resolver: Resolver) -> Policy:
        return Policy([*self.rules, (lambda k: k == F.lit(key), resolver)], self.default)

    def prefix(self, prefix, resolver: Resolver) -> Policy:
        return Policy([*self.rules, (lambda k: F.startswith(k, F.lit(prefix)), resolver)], self.default)

    def where(self, matches: Callable[[Column], Column], resolver: Resolver) -> Policy:
        return Policy([*self.rules, (matches, resolver)], self.default)

    def resolver_for(self, key: Column) -> Resolver:
        def resolve(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
            outcome, value = self.default(base, left, right)
            for matches, rule in self.rules:
                hit, (o, v) = F.coalesce(matches(key), F.lit(False)), rule(base, left, right)
                outcome, value = F.when(hit, o).otherwise(outcome), F.when(hit, v).otherwise(value)
            return outcome, value

        return resolve


def decide(aligned: DataFrame, resolver: Resolver) -> DataFrame:
    """Adds ``decision`` and ``merged`` to aligned rows; unresolved conflicts have no merged value."""
    outcome, value = resolver(F.col("base"), F.col("left"), F.col("right"))
    decision = (
        F.when(_same("left", "right"), "same")
        .when(_same("right", "base"), "take_left")
        .when(_same("left", "base"), "take_right")
        .otherwise(F.concat(F.lit("conflict_"), outcome))
    )
    merged = F.when(_same("left", "right") | _same("right", "base"), F.col("left")).when(_same("left", "base"), F.col("right")).when(outcome == VALUE, value)
    return aligned.withColumn("decision", decision).withColumn("merged", merged)


def merge(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, resolver: Resolver | Policy = unresolved, strict: bool = True) -> DataFrame:
    """The merged version. With ``strict``, an unresolved conflict is an error; else its key is left out."""
    rule = resolver.resolver_for(F.col(key)) if isinstance(resolver, Policy) else resolver
    decided = decide(align(base, left, right, key, value), rule)
    merged = F.col("merged")
    if strict:
        stuck = F.col("decision") == f"conflict_{UNRESOLVED}"
        merged = F.when(stuck, F.raise_error(F.concat(F.lit("unresolved conflict at "), F.col(key).cast("string")))).otherwise(merged)
    return decided.select(key, merged.alias(value)).where(F.col(value).isNotNull())


def merge_range(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, start, end, resolver: Resolver = unresolved, strict: bool = True) -> DataFrame:
    """Left with right's changes whose keys lie in the range; outside of it left stays as it is."""
    inside = in_range(key, start, end)
    merged = merge(base.where(inside), left.where(inside), right.where(inside), key, value, resolver, strict)
    return left.where(~inside).select(key, value).unionByName(merged)


def merge_prefix(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, prefix, resolver: Resolver = unresolved, strict: bool = True) -> DataFrame:
    """The same for keys that start with a prefix."""
    inside = F.startswith(F.col(key), F.lit(prefix))
    merged = merge(base.where(inside), left.where(inside), right.where(inside), key, value, resolver, strict)
    return left.where(~inside).select(key, value).unionByName(merged)


def trace(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, resolver: Resolver = unresolved) -> DataFrame:
    """Every key that a side changed, with all three values, the decision and what came of it."""
    decided = decide(align(base, left, right, key, value), resolver)
    changed = ~_same("left", "base") | ~_same("right", "base")
    return decided.where(changed).select(key, "base", "left", "right", "decision", "merged")


def crdt_explain(rows: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Last-writer-wins with its reason: the winner, how many writes it beat, and whether the value broke a tie of times."""
    when = F.coalesce(F.col(time), F.lit(0))
    grouped = rows.groupBy(*keys).agg(
        F.max(F.struct(when.alias("t"), F.col(value).alias("v"))).alias("last"), F.count("*").alias("n"), F.max(when).alias("_top")
    )
    tied = rows.groupBy(*keys, when.alias("_top")).agg(F.count("*").alias("n_tied"))
    return grouped.join(tied, [*keys, "_top"]).select(*keys, F.col("last.v").alias(value), F.col("last.t").alias(time), (F.col("n") - 1).alias("n_beaten"), (F.col("n_tied") > 1).alias("tied"))


def explain(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, resolver: Resolver = unresolved) -> DataFrame:
    """Number of keys per decision."""
    return decide(align(base, left, right, key, value), resolver).groupBy("decision").agg(F.count("*").alias("n"))


def resolve_lww(value: str, left_time: str, right_time: str) -> Resolver:
    """Later timestamp wins, the larger value if they tie; a missing timestamp is 0."""

    def resolve(base: Column, left: Column, right: Column) -> tuple[Column, Column]:
        a, b = F.coalesce(F.col(left_time), F.lit(0)), F.coalesce(F.col(right_time), F.lit(0))
        return F.lit(VALUE), F.when(a > b, left).when(b > a, right).otherwise(F.greatest(left, right))

    return resolve


def lww_register(rows: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Last writer per key over any number of replicas: greatest (time, value)."""
    last = F.max(F.struct(F.coalesce(F.col(time), F.lit(0)).alias("t"), F.col(value).alias("v"))).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, F.col("last.v").alias(value), F.col("last.t").alias(time))


def multi_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All concurrent values of a key as a sorted set."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(value))


def union_sets(left: Column, right: Column) -> Column:
    """Merge of two multi-value sets."""
    empty = F.array()
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(left, empty), F.coalesce(right, empty))))
