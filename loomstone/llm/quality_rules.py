"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the text, so no rows are moved and
no user function runs. Base measures: words between ASCII white space, their
characters, symbols, repeated lines, and words inside five-word windows that
occur again in the same text. Windows are compared by the 64-bit hash of their
words' hashes.

Defined results: a null or empty text has no words and fails the base rule;
texts are read whole whatever their length; equal rows get equal verdicts;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the four main languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by at from or an this a "
    "de la le et les des du un une en est que qui dans pour par pas sur avec au "
    "el los las y se no por con su lo del al "
    "der die das und ist nicht mit von den zu ein eine sich auch als auf für dem im"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= measure <= high."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbols_per_word", high=0.1),
    Rule("shouts_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.05),
    Rule("dup_line_ratio", high=0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_window_words(words: Column) -> Column:
    """Words covered by five-word windows that are found twice or more."""

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(ps: Column) -> Column:
            same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))  # noqa: E731
            twice = F.filter(ps, lambda p, k: same(p, F.get(ps, k - 1)) | same(p, F.get(ps, k + 1)))
            return F.array_sort(F.transform(twice, lambda p: p["i"]))

        # Starts ascend; each adds the words that the one before doesn't cover.
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct(  # noqa: E731
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
        )
        return _let(pairs, lambda ps: F.aggregate(starts(ps), begin, step, lambda a: a["n"]))

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0)

    whole = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count))
    return F.when(F.size(words) > WINDOW, whole).otherwise(0).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the base and ratio measures of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        text.alias("t"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    stop = F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    base = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        _count_of(F.col("t"), "!").alias("n_shouts"),
        stop.cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))  # noqa: E731
    return base.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_shouts", "n_words").alias("shouts_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.high)
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each document."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measure(docs).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


OUTPUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def verdicts(docs: DataFrame) -> DataFrame:
    """Digest columns of the rules for each document."""
    return apply_rules(docs).select(*OUTPUT)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the same digest, from the same table of thresholds."""
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))
    bounds = [f"{r.measure} >= {r.low}" for r in rules if r.low is not None] + [f"{r.measure} <= {r.high}" for r in rules if r.high is not None]
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^ 	-]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (
    SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s WHERE len(w) > {WINDOW})),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM f) GROUP BY r),
b AS (SELECT s.r, doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS n_shouts,
    len(list_filter(w, lambda x: lower(x) IN ({words}))) AS n_stop_words, len(l) AS n_lines
    FROM s LEFT JOIN c ON s.r = c.r),
m AS (SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbols_per_word,
    {ratio("n_shouts", "n_words")} AS shouts_per_word, {ratio("n_stop_words", "n_words")} AS stop_word_ratio,
    {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM m
"""
