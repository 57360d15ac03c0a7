"""Proofs that a key, or a whole key range, is or isn't in a version, checked without any store.

Rows in key order are cut into chunks of at most ``FANOUT``; a chunk's digest is
over its rows' keys and value digests, and groups of ``FANOUT`` digests are
digested again, level by level, to one root that also holds the number of chunks.
Levels are DataFrames; a proof collects a few chunks and one group for each level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.keys import prefix_end
from loomstone.staging import Staged

FANOUT = 64


@dataclass(frozen=True)
class Chunk:
    """Rows (key, digest of the value) of one chunk and the groups of digests above it, lowest first."""

    number: int
    rows: tuple[tuple[Any, str], ...]
    groups: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class RangeProof:
    """Neighbouring chunks that cover start <= key < end, None being open."""

    start: Any
    end: Any
    chunks: tuple[Chunk, ...]
    n_chunks: int


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_text(key: Any, digest: str) -> str:
    """What a chunk's digest holds of a row; keys as text with their length, so no two rows run together."""
    text = str(key)
    return f"{len(text.encode())}:{text}:{digest};"


class ProofTree:
    """The digest levels of one version of a keyed table."""

    def __init__(self, rows: DataFrame, key: str, value: str, partitions: int | None = None):
        spark = rows.sparkSession
        self.key, n = key, partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        digest = F.coalesce(F.sha2(F.col(value).cast("binary"), 256), F.lit(""))
        ranged = rows.select(F.col(key).alias("key"), digest.alias("digest")).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
        placed = Staged(ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("key"))), "proof-rows")
        before, at = F.lit(0).cast("long"), 0
        for r in placed.df.groupBy("part").agg(F.count("*").alias("size")).orderBy("part").collect():
            before = F.when(F.col("part") == r["part"], F.lit(at).cast("long")).otherwise(before)
            at += r["size"]
        number = F.floor((before + F.col("n") - 1) / FANOUT)
        row = F.struct("key", "digest")
        chunks = placed.df.groupBy(number.alias("number")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        text = F.array_join(F.transform("rows", lambda r: F.concat(F.octet_length(r["key"].cast("string")).cast("string"), F.lit(":"), r["key"].cast("string"), F.lit(":"), r["digest"], F.lit(";"))), "")
        ends = [F.col("rows")[0]["key"].alias("low"), F.element_at("rows", -1)["key"].alias("high")]
        self.chunks = Staged(chunks.select("number", "rows", *ends, F.sha2(text, 256).alias("digest")), "proof-chunks")
        self.n_chunks = -(-at // FANOUT)
        self.levels, size = [self.chunks.df.select("number", "digest")], self.n_chunks
        while size > 1:
            group = F.floor(F.col("number") / FANOUT)
            above = self.levels[-1].groupBy(group.alias("number")).agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("below"))
            joined = F.array_join(F.transform("below", lambda b: b["digest"]), "")
            self.levels.append(Staged(above.select("number", F.sha2(joined, 256).alias("digest"), F.transform("below", lambda b: b["digest"]).alias("below")), "proof-level").df)
            size = -(-size // FANOUT)
        top = self.levels[-1].first()
        self.root = _sha(f"{self.n_chunks}:{top['digest'] if top else ''}")
        placed.drop()

    def _chunks(self, first: int, last: int) -> tuple[Chunk, ...]:
        found = {r["number"]: r["rows"] for r in self.chunks.df.where(F.col("number").between(first, last)).collect()}
        groups, width = [], 1
        for level in self.levels[1:]:
            width *= FANOUT
            groups.append({r["number"]: tuple(r["below"]) for r in level.where(F.col("number").between(first // width, last // width)).collect()})
        made = []
        for number in sorted(found):
            above = tuple(level[number // FANOUT ** (k + 1)] for k, level in enumerate(groups))
            made.append(Chunk(number, tuple((r["key"], r["digest"]) for r in found[number]), above))
        return tuple(made)

    def prove_range(self, start: Any = None, end: Any = None) -> RangeProof:
        """All rows of a half-open range, with the chunks on both sides that show there are no others."""
        low = F.lit(0) if start is None else F.coalesce(F.max(F.when(F.col("low") <= F.lit(start), F.col("number"))), F.lit(0))
        high = F.max("number") if end is None else F.coalesce(F.min(F.when(F.col("high") >= F.lit(end), F.col("number"))), F.max("number"))
        span = self.chunks.df.agg(low.alias("low"), high.alias("high")).first()
        if not self.n_chunks:
            return RangeProof(start, end, (), 0)
        return RangeProof(start, end, self._chunks(span["low"], max(span["low"], span["high"])), self.n_chunks)

    def prove_key(self, key: Any) -> RangeProof:
        """That one key is there, or that it isn't."""
        span = self.chunks.df.agg(F.max(F.when(F.col("low") <= F.lit(key), F.col("number"))).alias("low"), F.min(F.when(F.col("high") >= F.lit(key), F.col("number"))).alias("high")).first()
        if not self.n_chunks:
            return RangeProof(key, key, (), 0)
        first = span["low"] if span["low"] is not None else 0
        last = span["high"] if span["high"] is not None else self.n_chunks - 1
        return RangeProof(key, key, self._chunks(min(first, last), max(first, last)), self.n_chunks)

    def prove_keys(self, keys: list) -> list[RangeProof]:
        """A proof for each key, in their order."""
        return [self.prove_key(k) for k in keys]

    def prove_prefix(self, prefix: str) -> RangeProof:
        end = prefix_end(prefix.encode())
        return self.prove_range(prefix, end.decode(errors="surrogateescape") if end else None)


def _authentic(proof: RangeProof, root: str) -> bool:
    """Whether every chunk leads to the root and the chunks are neighbours."""
    if not proof.chunks:
        return proof.n_chunks == 0 and _sha("0:") == root
    for before, after in zip(proof.chunks, proof.chunks[1:], strict=False):
        if after.number != before.number + 1:
            return False
    for chunk in proof.chunks:
        digest, number = _sha("".join(row_text(k, d) for k, d in chunk.rows)), chunk.number
        for group in chunk.groups:
            if number % FANOUT >= len(group) or group[number % FANOUT] != digest:
                return False
            digest, number = _sha("".join(group)), number // FANOUT
        if number or _sha(f"{proof.n_chunks}:{digest}") != root:
            return False
    return True


def verify_range(proof: RangeProof, root: str) -> list[tuple[Any, str]] | None:
    """The range's rows (key, digest of the value) if the proof holds for a root and is complete; else None."""
    if not _authentic(proof, root):
        return None
    if not proof.chunks:
        return []
    first, last = proof.chunks[0], proof.chunks[-1]
    starts = first.number == 0 or proof.start is not None and first.rows[0][0] <= proof.start
    ends = last.number == proof.n_chunks - 1 or proof.end is not None and last.rows[-1][0] >= proof.end
    if not (starts and ends):
        return None
    inside = lambda k: (proof.start is None or k >= proof.start) and (proof.end is None or k < proof.end)
    return [r for c in proof.chunks for r in c.rows if inside(r[0])]


def verify_key(proof: RangeProof, root: str, key: Any) -> str | None | bool:
    """The digest of a key's value, None if the key is shown to be absent, False if the proof doesn't hold."""
    if proof.start != key or not _authentic(proof, root):
        return False
    rows = [r for c in proof.chunks for r in c.rows]
    for found, digest in rows:
        if found == key:
            return digest
    if not proof.chunks:
        return None
    below = proof.chunks[0].number == 0 or rows[0][0] < key
    above = proof.chunks[-1].number == proof.n_chunks - 1 or rows[-1][0] > key
    return None if below and above else False


def verify_diff(old: RangeProof, new: RangeProof, old_root: str, new_root: str) -> list[tuple[Any, str]] | None:
    """(key, 'added' | 'removed' | 'changed') between two proven versions of one range; None if a proof fails."""
    sides = verify_range(old, old_root), verify_range(new, new_root)
    if None in sides or (old.start, old.end) != (new.start, new.end):
        return None
    a, b = map(dict, sides)
    kind = lambda k: "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
    return [(k, kind(k)) for k in sorted({*a, *b}) if kind(k)]
