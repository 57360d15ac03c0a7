"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every text keeps the smallest hash of its k-grams in each sliding window of
w = 13 - k + 1 k-grams, so any 13 words that a document shares with an item
leave a common fingerprint in both. Fingerprints of documents are joined with
those of items; around each hit the 13-word windows are compared as words, which
extends hits to all shared windows and drops false ones. Items of fewer than 13
words are one window; for each such length m, all m-grams of documents are
fingerprints (a window of one), which keeps the guarantee for them.

Texts are matched by content, not by id, so copies are looked up once and
repeated or null ids do no harm.

Defined results: a null text or one without words has no hits; a document or an
item may repeat, and rows of one item_id are one item; whole texts are read; items
without words are ignored; items without id are one item together, which counts
in n_items if a window of theirs occurs and is left out of the list; without
documents or items the result is empty or free of hits; extra columns of documents
are kept, but for those named like a column of the verdict, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.quality_rules import _let
from loomstone.staging import Staged, if_small

WINDOW = 13
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
VERDICT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: Column) -> Column:
    """The words of a text: runs of letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text).alias("key_b")]


def _indices(count: Column) -> Column:
    """0 .. count - 1; empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words."""
    mixed = lambda h: F.transform(
        _indices(F.size(h) - (size - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])
    )
    return _let(F.transform(words, lambda w: F.xxhash64(w)), mixed)


def winnow(words: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Fingerprints (hash, window) of a text: the smallest k-gram hash of each window.

    Neighbouring windows with the same minimum keep it once, at the first of them
    and at every multiple of the span, so the windows that a fingerprint stands
    for start at its own place or fewer than ``window - gram + 1`` words later.
    """
    span = window - gram + 1

    def smallest(hashes: Column, width: int) -> Column:
        """Minimum of each run of ``width``, from those of half as many; shorter at the end."""
        if width == 1:
            return hashes
        half = width // 2
        later = lambda h, by: F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1)))
        merged = lambda by: lambda h: F.zip_with(h, later(h, by), lambda x, y: F.least(x, y))
        doubled = _let(smallest(hashes, half), merged(half))
        return F.zip_with(doubled, later(hashes, width - 1), lambda x, y: F.least(x, y)) if width % 2 else doubled

    def pick(hashes: Column) -> Column:
        whole = F.slice(smallest(hashes, span), 1, F.greatest(F.size(hashes) - (span - 1), F.lit(0)))
        chosen = F.transform(whole, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        fresh = lambda cs: F.filter(cs, lambda c, k: (k % span == 0) | (c["h"] != F.get(cs, k - 1)["h"]))
        return _let(chosen, fresh)

    return _let(gram_hashes(words, gram), pick)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows of items: item_id (as text), n (words), gram (the words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    grams = F.transform(_indices(F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    return items.select("item_id", n.alias("n"), F.explode(F.array_distinct(grams)).alias("gram")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, windows: DataFrame) -> DataFrame | None:
    """Occurrences of item windows in texts: key_a, key_b, start, n, gram; None if no item has a word."""
    lengths = [r["n"] for r in windows.select("n").distinct().orderBy("n").limit(WINDOW).collect()]
    texts = docs.select(*text_key(F.col("text")), "text")
    found = [_long_hits(texts, benchmark)] if WINDOW in lengths else []
    found += [_short_hits(texts, windows, n) for n in lengths if n < WINDOW]
    if not found:
        return None
    starts = found[0]
    for more in found[1:]:
        starts = starts.unionByName(more)
    grams = if_small(Staged(windows.select("n", "gram").distinct(), "windows"))
    return starts.join(grams, ["n", "gram"], "left_semi").select("key_a", "key_b", "start", "n", "gram")


def _long_hits(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Candidate windows: every 13-word window around a fingerprint that an item has too."""
    items = benchmark.select(F.explode(winnow(words_of(F.col("text")))).alias("f")).select(F.col("f.h").alias("h")).distinct()
    span = WINDOW - GRAM + 1
    prints = texts.select("key_a", "key_b", F.inline(winnow(words_of(F.col("text")))))
    places = prints.join(if_small(Staged(items, "item-fingerprints")), "h", "left_semi")
    near = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + span - 1))))
    per_text = places.groupBy("key_a", "key_b").agg(F.collect_set("i").alias("at")).select("key_a", "key_b", near.alias("starts"))
    return _windows_at(texts, Staged(per_text, "winnowed-hits"), WINDOW)


def _windows_at(texts: DataFrame, places: Staged, n: int) -> DataFrame:
    """The words of windows at given starts; each different text is read for them once."""
    around = texts.join(if_small(places), ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    split = around.select("key_a", "key_b", words_of(F.col("text")).alias("words"), "starts")
    inside = split.select("key_a", "key_b", "words", F.filter("starts", lambda s: s <= F.size("words") - n).alias("starts"))
    gram = lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, n), " ").alias("gram"))
    return inside.select("key_a", "key_b", F.inline(F.transform("starts", gram))).select("key_a", "key_b", "start", F.lit(n).alias("n"), "gram")


def _short_hits(texts: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """All runs of n words whose hash is that of a whole item of n words."""
    items = windows.where(F.col("n") == n).select(F.xxhash64(*[F.xxhash64(F.get(F.split("gram", " "), j)) for j in range(n)]).alias("h")).distinct()
    items = if_small(Staged(items, "short-items"))
    marked = lambda h, i: F.struct(h.alias("h"), i.alias("start"))
    runs = texts.select("key_a", "key_b", F.inline(F.transform(gram_hashes(words_of(F.col("text")), n), marked)))
    places = runs.join(items, "h", "left_semi").groupBy("key_a", "key_b").agg(F.collect_set("start").alias("starts"))
    return _windows_at(texts, Staged(places, "short-hits"), n)


def covered_words(places: Column) -> Column:
    """Words covered by (start, n) pairs in ascending order."""
    begin = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))
    step = lambda a, p: F.struct(
        (a["hit"] + F.greatest(F.lit(0), p["start"] + p["n"] - F.greatest(a["to"], p["start"]))).alias("hit"),
        F.greatest(a["to"], p["start"] + p["n"]).alias("to"),
    )
    return F.aggregate(places, begin, step, lambda a: a["hit"])


def hits_by_text(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Per text: the words hit, the number of items and the list of their ids.

    A window that occurs often in a text, or belongs to many items, meets them once.
    """
    places = F.sort_array(F.collect_set(F.struct("start", "n")))
    covered = found.groupBy("key_a", "key_b").agg(places.alias("places")).select("key_a", "key_b", covered_words(F.col("places")).cast("long").alias("hit"))
    owners = found.select("key_a", "key_b", "n", "gram").distinct().join(windows, ["n", "gram"]).select("key_a", "key_b", "item_id").distinct()
    ids, unnamed = F.sort_array(F.collect_list("item_id")), F.max(F.col("item_id").isNull().cast("int"))
    named = owners.groupBy("key_a", "key_b").agg(ids.alias("ids"), unnamed.alias("unnamed"))
    return covered.join(named, ["key_a", "key_b"]).select("key_a", "key_b", "hit", (F.size("ids") + F.col("unnamed")).cast("long").alias("items"), "ids")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items, items_sha256 and contaminated."""
    others = [c for c in docs.columns if c not in VERDICT]
    packed = docs.select(F.struct(*[docs[c] for c in others]).alias("row"), docs["text"].alias("text"))
    windows = Staged(item_windows(benchmark), "item-windows")
    found = hits(packed, benchmark, windows.df)
    counted = packed.select("row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), *text_key(F.col("text")))
    if found is None:
        joined = counted.withColumns({"hit": F.lit(0), "items": F.lit(0), "ids": F.array().cast("array<string>")})
    else:
        occurrences = Staged(found, "occurrences")
        by_text = Staged(hits_by_text(occurrences.df, windows.df), "text-hits")
        occurrences.drop()
        joined = counted.join(if_small(by_text), ["key_a", "key_b"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    listed = F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256)
    return joined.select(
        *[F.col("row")[c].alias(c) for c in others],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        listed.alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of the verdict for each document."""
    return judge(docs.select("doc_id", "text"), benchmark).drop("text")


SQL = r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT DISTINCT text, w FROM t),
b AS (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
        SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
p AS (SELECT text, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT p.text, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT text, count(DISTINCT j) AS n_hit FROM (SELECT text, unnest(range(i, i + n)) AS j FROM h) GROUP BY text),
m AS (SELECT text, count(DISTINCT item_id) + max((item_id IS NULL)::INT) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY text)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN c ON t.text = c.text LEFT JOIN m ON t.text = m.text
"""
