"""Removal of repeated byte strings by suffix sorting.

A byte goes if some 100-byte string over it also starts earlier. Sorting all
suffixes of a corpus moves every byte many times, so candidates come first, with
no loss: each 100-byte window names the 32-byte anchor in it with the smallest
hash (the leftmost, if it ties). Equal windows name equal anchors, so only windows
whose anchor occurs again can repeat.

1. Texts that are equal to one of a smaller id go as a whole.
2. Anchors of the others are counted; those found twice or more give contexts:
   the bytes of the windows that name them. Equal contexts are merged to the
   earliest, which covers all others.
3. Anchors with several contexts are dealt into buckets. In a bucket the
   difference-cover algorithm orders the suffixes of all contexts (sorted sample
   triples, recursion on names, merge of the rest), neighbours are compared on
   100 bytes, and each class of equal windows keeps its earliest.
4. Anchors with more contexts than a bucket may hold are grouped by the window
   itself, which spreads evenly.

Order of places: doc_id (null first), then hash of the text, then start; rows
that repeat id and text are one document. Defined results: null and empty texts
have no bytes and nothing is removed; texts under 100 bytes stay; whole texts are
read; an empty table gives an empty result; extra columns are ignored. If removal
cuts a character, the kept bytes need not be valid UTF-8; the digest is over bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.difference_cover import suffix_order
from loomstone.llm.minhash import BASE, _scramble
from loomstone.llm.text_bytes import as_bytes, bounded
from loomstone.staging import Staged, if_small

LENGTH = 100
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
BATCH = 512 << 10
PLACE_BITS = 24
BUCKET_BYTES = 512 << 10
MOST_CONTEXTS = 12_000
BYTE_VALUE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


def _longer(half: np.ndarray, more: np.ndarray, by: int) -> np.ndarray:
    """Hash of the string at each place followed by the one ``by`` further on."""
    factor = np.uint64(pow(BASE, by, 1 << 64))
    out = half * factor
    out[: len(out) - by] += more[by:]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a batch: hash, first window, number of windows that name it, index of the text."""
    n = len(data)
    long_enough = np.diff(offsets) >= LENGTH
    if n < LENGTH or not long_enough.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = BYTE_VALUE[data]
    size = 1
    while size < ANCHOR:
        grams = _longer(grams, grams, size)
        size *= 2
    grams = _scramble(grams)
    # The place breaks ties, the leftmost first; texts are far apart enough for that within a window.
    if n >= 1 << PLACE_BITS:
        raise ValueError("a batch is one text or small; longer texts are cut into overlapping parts")
    least = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        least[: n - size] = np.minimum(least[: n - size], least[size:])
        size *= 2
    rest = SPAN - size
    least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    whole = np.zeros(n + 1, np.int8)
    np.add.at(whole, offsets[:-1][long_enough], 1)
    np.add.at(whole, offsets[1:][long_enough] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(whole[:-1]))
    named = place[windows]
    turn = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    count = np.diff(np.concatenate((turn, [len(named)])))
    first = windows[turn]
    return grams[named[turn]], first, count, np.searchsorted(offsets, first, side="right") - 1


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets, rows and shift of parts that the place bits can hold; parts of one long text overlap by a window."""
    data, offsets = as_bytes(batch.column("text"))
    most = (1 << PLACE_BITS) - 1
    if len(data) <= most:
        yield data, offsets, np.arange(batch.num_rows), 0
        return
    for row in range(batch.num_rows):
        for start in range(int(offsets[row]), int(offsets[row + 1]), most - 2 * LENGTH):
            end = min(start + most, int(offsets[row + 1]))
            yield data[start:end], np.array([0, end - start]), np.array([row]), start - int(offsets[row])


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, most=BATCH):
        ids, keys = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
        for data, offsets, rows, shift in _parts(batch):
            value, first, _, owner = anchors(data, offsets)
            row = rows[owner]
            columns = [value.view(np.int64), ids[row], keys[row], (first - offsets[owner] + shift).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "doc", "key", "first"])


def _anchor_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors alone, for counting."""
    for batch in bounded(batches, most=BATCH):
        for data, offsets, _, _ in _parts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets)[0].view(np.int64))], names=["anchor"])


def _hashed(unique: DataFrame) -> DataFrame:
    """The side of a join whose keys are unique, to be hashed in each partition, so that the other side needs no sorting."""
    return unique.hint("shuffle_hash")


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, most=BATCH):
        ids, keys = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
        wanted = [np.array(x, np.int64) for x in batch.column("firsts").to_pylist()]
        for data, offsets, rows, shift in _parts(batch):
            value, first, count, owner = anchors(data, offsets)
            start = first - offsets[owner] + shift
            # Places of one text are under 2**40; row and place make one number.
            mine = (rows[owner].astype(np.int64) << 40) + start
            among = np.concatenate([(np.int64(r) << 40) + wanted[r] for r in rows])
            keep = np.flatnonzero(np.isin(mine, among))
            raw, starts, ends = data.tobytes(), first[keep].tolist(), (first[keep] + count[keep] - 1 + LENGTH).tolist()
            contexts = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
            digest = [hashlib.blake2b(c, digest_size=16).digest() for c in contexts]
            row = rows[owner[keep]]
            columns = [value[keep].view(np.int64), ids[row], keys[row], start[keep].astype(np.int64), count[keep].astype(np.int32)]
            arrays = [*(pa.array(c) for c in columns), pa.array(digest, pa.binary()), pa.array(contexts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "doc", "key", "start", "windows", "digest", "context"])


def repeated_windows(contexts: list[bytes], windows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of distinct contexts that an equal, earlier one covers: (index of context, offset).

    ``place`` ranks the contexts' own places; the first ``windows`` offsets of a context start windows.
    """
    lengths = np.array([len(c) + 1 for c in contexts])
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    raw = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    text = raw.astype(np.int32) + 2
    text[begin + lengths - 1] = 1
    order = suffix_order(text)
    owner = np.repeat(np.arange(len(contexts)), lengths)
    offset = np.arange(len(raw)) - begin[owner]
    order = order[offset[order] < windows[owner[order]]]
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = padded[: len(raw)].astype(np.uint64)
    for k in range(1, 8):
        words = words << np.uint64(8) | padded[k : k + len(raw)]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        column = words[order + k]
        same &= column[1:] == column[:-1]
    group = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    # Rank of a window's place: by place of its context, then by offset. Contexts of one text share a rank base.
    at = place[owner[order]] + offset[order]
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, at)
    later = order[at > least[group]]
    return owner[later], offset[later]


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of one bucket's windows that an earlier one repeats."""
    pdf = pdf.sort_values(["doc", "key", "start"], kind="stable").reset_index(drop=True)
    docs = pdf.groupby(["doc", "key"], sort=True).ngroup().to_numpy()
    base = (docs.astype(np.int64) << 40) + pdf["start"].to_numpy()
    context, offset = repeated_windows(pdf["context"].tolist(), pdf["windows"].to_numpy(), base)
    by = np.lexsort((offset, context))
    context, offset = context[by], offset[by]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(context) else np.zeros(0, bool)
    turn = np.flatnonzero(new)
    last = np.concatenate((turn[1:], [len(context)])).astype(np.int64)[: len(turn)] - 1
    rows = pdf.iloc[context[turn]]
    start = rows["start"].to_numpy()
    return pd.DataFrame({"doc": rows["doc"].to_numpy(), "key": rows["key"].to_numpy(), "from": start + offset[turn], "to": start + offset[last] + LENGTH})


SPAN_SCHEMA = "doc long, key long, `from` long, `to` long"


def _window_spans(contexts: DataFrame) -> DataFrame:
    """The same for contexts too many for a bucket: rows meet by the whole window."""
    each = contexts.select("doc", "key", "start", "context", F.explode(F.expr("sequence(0, windows - 1)")).alias("o"))
    windows = each.select("doc", "key", (F.col("start") + F.col("o")).alias("at"), F.expr(f"substring(context, o + 1, {LENGTH})").alias("window"))
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "key", "at")).alias("least"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, "window").where(F.struct("doc", "key", "at") > F.col("least"))
    return later.select("doc", "key", F.col("at").alias("from"), (F.col("at") + LENGTH).alias("to"))


def repeated_spans(texts: DataFrame) -> Staged:
    """Spans (doc, key, from, to) of bytes that repeat earlier ones; ``texts`` has distinct texts as (doc, key, text)."""
    long = texts.where(F.octet_length("text") >= LENGTH)
    found = long.mapInArrow(_anchor_batches, "anchor long, doc long, key long, first int")
    values = long.select("text").mapInArrow(_anchor_values, "anchor long")
    again = Staged(values.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    marked = found.join(_hashed(again.df), "anchor", "left_semi").groupBy("doc", "key").agg(F.collect_list("first").alias("firsts"))
    marks = Staged(marked, "anchor-places")
    again.drop()
    with_marks = long.join(_hashed(marks.df), ["doc", "key"]).select("doc", "key", "text", "firsts")
    schema = "anchor long, doc long, key long, start long, windows int, digest binary, context binary"
    contexts = Staged(with_marks.mapInArrow(_context_batches, schema), "contexts")
    marks.drop()
    place = F.struct("doc", "key", "start")
    grouped = contexts.df.groupBy("digest").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    firsts = Staged(grouped, "first-contexts")
    copies = contexts.df.join(_hashed(firsts.df.where("n > 1")), "digest").where(place > F.col("least"))
    copied = copies.select("doc", "key", F.col("start").alias("from"), (F.col("start") + F.col("windows") - 1 + LENGTH).alias("to"))
    distinct = contexts.df.join(_hashed(firsts.df), "digest").where(place == F.col("least")).drop("least", "n", "digest")
    distinct = Staged(distinct.dropDuplicates(["anchor", "doc", "key", "start"]), "distinct-contexts")
    per_anchor = distinct.df.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("context")).alias("bytes")).where("n > 1")
    per_anchor = Staged(per_anchor, "shared-anchors")
    facing = distinct.df.join(_hashed(per_anchor.df), "anchor")
    total = per_anchor.df.where(F.col("n") <= MOST_CONTEXTS).agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    small = facing.where(F.col("n") <= MOST_CONTEXTS).withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    sorted_spans = small.select("bucket", "doc", "key", "start", "windows", "context").groupBy("bucket").applyInPandas(_bucket, SPAN_SCHEMA)
    large = _window_spans(facing.where(F.col("n") > MOST_CONTEXTS))
    spans = copied.unionByName(sorted_spans).unionByName(large)
    by_doc = spans.groupBy("doc", "key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    out = Staged(by_doc, "repeated-spans")
    for table in (contexts, firsts, distinct, per_anchor):
        table.drop()
    return out


def merged_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans; runs that touch are one."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        out = ([], [], [], [])
        for text, spans, copy in zip(texts, batch.column("spans").to_pylist(), batch.column("copy").to_pylist(), strict=True):
            text = text or b""
            runs = [(0, len(text))] if copy else merged_runs([(s["from"], s["to"]) for s in spans or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            for column, value in zip(out, (len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()), strict=True):
                column.append(value)
        arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """What removal leaves of each document."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = docs.select("doc_id", "text", place.alias("doc"), F.xxhash64("text").alias("key"))
    long = F.octet_length("text") >= LENGTH
    narrow = keyed.where(long).select("doc", "key", F.xxhash64(F.lit(1), "text").alias("key_b"))
    first = narrow.groupBy("key", "key_b").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = Staged(narrow.join(first, ["key", "key_b"]).where(F.col("doc") > F.col("least")).select("doc", "key").distinct(), "copies")
    spans = repeated_spans(keyed.join(if_small(copies), ["doc", "key"], "left_anti").select("doc", "key", "text"))
    rows = keyed.join(if_small(copies).withColumn("copy", F.lit(True)), ["doc", "key"], "left").join(_hashed(spans.df), ["doc", "key"], "left")
    return rows.select("doc_id", "text", "spans", "copy").mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


# Texts as hexadecimal digits, so that places count bytes. Windows are compared whole.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (
    SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
k AS (SELECT e.doc_id, e.a, e.b, substr(h, 2 * coalesce(lag(e.b) OVER o, 0) + 1, 2 * (e.a - coalesce(lag(e.b) OVER o, 0))) AS piece
    FROM e JOIN d ON d.doc_id = e.doc_id WINDOW o AS (PARTITION BY e.doc_id ORDER BY e.a, e.b NULLS LAST))
SELECT d.doc_id, any_value(length(h) // 2)::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(b)::BIGINT AS n_spans,
    sha256(unhex(string_agg(piece, '' ORDER BY a, b NULLS LAST))) AS kept_sha256
FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""
