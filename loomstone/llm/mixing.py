"""Mixing sources to target weights.

Sizes are summed per source, targets and repetition rates derived from the
sums, and each document is taken floor(rate) times plus one hash-seeded
Bernoulli copy whose probability is the fraction of the rate.

Defined results: a null text has size 0; a null source is a source of its own,
ranked last; rows that are repeated are taken alike, as the draw depends only on
doc_id (null: the empty string) and the seed; an empty table gives an empty
result; extra columns are kept by ``mix``, but for those named like its own,
which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.staging import Staged, if_small

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
SEED = "mix-1"
HEX_DIGITS = 13
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_source")


def word_count(text: str = "text") -> Column:
    """Number of words between ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on nothing but the id and the seed."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def source_targets(sizes: DataFrame, cycle: int = 3, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    ``sizes`` has (source, size) per document. Weights are 1..cycle by rank in
    code-point order. Water filling: sources in order of the share at which
    they reach their limit; those before the level stop at the limit, the rest
    share what is left by weight. The windows run over one row per source, not
    over documents, and stream with running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long")
    ranked = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_repeats)
    order = [(F.col("limit") / F.col("weight")).asc(), F.col("weight").asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    running = ranked.select(
        "source",
        "source_size",
        "weight",
        "limit",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("limit_before"),
        F.sum("weight").over(rest).alias("weight_left"),
    )
    # A source is below the level if its own limit holds what it would get.
    share = (F.col("total") - F.col("limit_before")).cast("double") / F.col("weight_left").cast("double")
    open_here = F.col("weight").cast("double") * share <= F.col("limit").cast("double")
    levels = running.withColumn("share", share).withColumn("open", open_here)
    first_open = Window.partitionBy()
    level = F.min_by(F.when(F.col("open"), F.col("share")), F.when(F.col("open"), F.col("limit_before"))).over(first_open)
    from_here = F.min(F.when(F.col("open"), F.col("limit_before"))).over(first_open)
    return levels.withColumn("level", level).withColumn("from_here", from_here).select(
        "source",
        "source_size",
        F.when(F.col("limit_before") >= F.col("from_here"), F.col("weight").cast("double") * F.col("level"))
        .otherwise(F.col("limit").cast("double"))
        .alias("target"),
    )


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """Whole repeats plus one drawn copy for the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(unit_draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """All rows of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    The sizes are staged once as a narrow table, so that texts are read once
    for counting and once for the result. The join is by source: the target
    side has one row per source, and null meets null.
    """
    sized = docs.drop(*RESULTS).withColumn("mix_size", word_count())
    narrow = Staged(sized.groupBy("source").agg(F.sum("mix_size").alias("size")), "mix-sizes")
    targets = if_small(Staged(source_targets(narrow.df), "mix-targets")).select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    narrow.drop()
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("mix_copies", copies(rate, F.col("doc_id"), seed))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    repeat = F.explode(F.expr("sequence(1L, mix_copies)"))
    return mixed.where(F.col("mix_copies") > 0).select(*columns, repeat.alias("mix_copy")).drop("mix_copy")


def taken_rows(docs: DataFrame) -> DataFrame:
    """Digest of the mix per document."""
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
q AS (SELECT *, source_size * {MAX_REPEATS} AS cap,
    coalesce(sum(source_size * {MAX_REPEATS}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_w,
    sum(source_size) OVER ()::BIGINT AS total
    FROM p WINDOW o AS (ORDER BY (source_size * {MAX_REPEATS})::DOUBLE / weight, weight, source NULLS LAST)),
s AS (SELECT *, (total - before)::DOUBLE / left_w::DOUBLE AS share FROM q),
t AS (SELECT *, min(CASE WHEN weight::DOUBLE * share <= cap THEN before END) OVER () AS from_here,
    arg_min(share, before) FILTER (WHERE weight::DOUBLE * share <= cap) OVER () AS level FROM s),
u AS (SELECT source, source_size,
    CASE WHEN before >= from_here THEN weight::DOUBLE * level ELSE cap::DOUBLE END AS target FROM t),
j AS (SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}' || '|' || coalesce(doc_id::VARCHAR, '')), 1, {HEX_DIGITS}))::BIGINT::DOUBLE
        / {16**HEX_DIGITS}::DOUBLE AS draw
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
