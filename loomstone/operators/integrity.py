"""Checks over tables and chunk sets: keys, references, missing and unreachable chunks, proofs."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that several rows share; null never clashes."""
    present = rows.dropna(subset=columns)
    return present.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def foreign_key_violations(rows: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose reference has no parent; null satisfies it."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")


def type_violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows with a null where none may be."""
    bad = F.lit(False)
    for column in required:
        bad = bad | F.col(column).isNull()
    return rows.where(bad)


def missing(wanted: DataFrame, present: DataFrame, cid: str = "cid") -> DataFrame:
    """Chunks that a destination lacks."""
    return wanted.select(cid).distinct().join(present.select(cid), cid, "left_anti")


def reclaimable(candidates: DataFrame, reachable: DataFrame, cid: str = "cid") -> DataFrame:
    """Chunks that no retained version needs."""
    return missing(candidates, reachable, cid)


def chunk_digests(rows: DataFrame, key: str, columns: list[str], buckets: int, bucket: Column | None = None) -> DataFrame:
    """SHA-256 of each bucket's rows in key order, by hash of the key or a given column; a bucket is small by the choice of their number."""
    told = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    line = F.sha2(F.concat_ws("\x1f", *told), 256)
    number = F.pmod(F.xxhash64(key), F.lit(buckets)) if bucket is None else bucket
    lines = rows.select(number.alias("bucket"), F.struct(F.col(key), line.alias("h")).alias("row"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["h"]), "")
    return lines.groupBy("bucket").agg(F.sha2(ordered, 256).alias("cid"), F.count("*").alias("n_rows"))


def tree(leaves: list[str]) -> list[list[str]]:
    """Levels of the hash tree over leaf digests, leaves first; an odd node moves up as it is."""
    levels = [leaves or [hashlib.sha256(b"").hexdigest()]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        pairs = [below[i : i + 2] for i in range(0, len(below), 2)]
        levels.append([hashlib.sha256("".join(p).encode()).hexdigest() if len(p) == 2 else p[0] for p in pairs])
    return levels


def prove(leaves: list[str], index: int) -> list[tuple[str, str]]:
    """Siblings on the way from a leaf to the root: (side, digest)."""
    path = []
    for level in tree(leaves)[:-1]:
        other = index ^ 1
        if other < len(level):
            path.append(("left" if other < index else "right", level[other]))
        index //= 2
    return path


def verify_proof(root: str, leaf: str, path: list[tuple[str, str]]) -> bool:
    """Whether a leaf belongs to a root, without any store."""
    for side, other in path:
        leaf = hashlib.sha256((other + leaf if side == "left" else leaf + other).encode()).hexdigest()
    return hmac.compare_digest(leaf, root)


def sign(payload: bytes, secret: bytes, not_before: int, not_after: int) -> dict:
    """An envelope with a validity window under HMAC-SHA256."""
    head = f"{not_before}:{not_after}:".encode()
    return {"payload": payload, "not_before": not_before, "not_after": not_after, "mac": hmac.new(secret, head + payload, hashlib.sha256).hexdigest()}


def verify_signature(envelope: dict, secret: bytes, now: int) -> bool:
    """Whether an envelope is authentic and valid now."""
    head = f"{envelope['not_before']}:{envelope['not_after']}:".encode()
    mac = hmac.new(secret, head + envelope["payload"], hashlib.sha256).hexdigest()
    return hmac.compare_digest(mac, envelope["mac"]) and envelope["not_before"] <= now <= envelope["not_after"]
