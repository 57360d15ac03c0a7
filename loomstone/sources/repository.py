"""A versioned object repository over the version store: every write is a commit."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import objects
from loomstone.operators.merge import prefer_left, prefer_right, unresolved
from loomstone.sources.store import StaleRef, Version, VersionStore

SCHEMA = "key string, version_id string, size long, etag string, payload binary"
POLICIES = {"fail": unresolved, "ours": prefer_left, "theirs": prefer_right}


class ObjectRepository:
    """Objects by key on branches; reads of a commit stay as they were."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionStore(spark, root, "key")

    def at(self, branch: str = "main", commit: str | None = None) -> DataFrame:
        """Objects of a branch or of a commit."""
        version = commit or self.store.head(branch)
        return self.store.snapshot(version) if version else self.spark.createDataFrame([], SCHEMA)

    def write(self, puts: dict[str, bytes], deletes: Iterable[str] = (), branch: str = "main") -> Version:
        """Put and delete objects as one commit. A version id is made of the key, the bytes and the parent commit."""
        parent = self.store.head(branch) or ""
        rows = []
        for key, payload in puts.items():
            etag = hashlib.sha256(payload).hexdigest()
            rows.append((key, hashlib.sha256(f"{parent}|{key}|{etag}".encode()).hexdigest(), len(payload), etag, bytearray(payload)))
        gone = self.spark.createDataFrame([(k,) for k in {*puts, *deletes}], "key string")
        kept = self.at(branch).join(F.broadcast(gone), "key", "left_anti")
        return self.store.commit(kept.unionByName(self.spark.createDataFrame(rows, SCHEMA)), branch)[1]

    def read(self, key: str, branch: str = "main", commit: str | None = None, start: int = 0, end: int | None = None) -> bytes | None:
        """Bytes of an object, or of a range of it."""
        part = F.substring("payload", F.lit(start + 1), F.octet_length("payload") if end is None else F.lit(end - start))
        found = self.at(branch, commit).where(F.col("key") == F.lit(key)).select(part.alias("payload")).first()
        return bytes(found["payload"]) if found else None

    def copy(self, source: str, target: str, branch: str = "main") -> Version:
        return self.write({target: self.read(source, branch)}, branch=branch)

    def list(self, prefix: str = "", delimiter: str | None = None, limit: int = 1000, after: str | None = None, branch: str = "main") -> DataFrame:
        found = self.at(branch)
        if delimiter:
            return objects.list_delimited(found.select("key"), prefix, delimiter, limit, after)
        return objects.list_objects(found.drop("payload"), prefix, limit, after)

    def head(self, key: str, branch: str = "main", commit: str | None = None) -> dict | None:
        """What is known of an object without its bytes."""
        found = self.at(branch, commit).where(F.col("key") == F.lit(key)).drop("payload").first()
        return found.asDict() if found else None

    def session(self, branch: str = "main", seconds: float = 3600.0) -> CommitSession:
        """Changes staged one by one and published as one commit, or not at all."""
        return CommitSession(self, branch, time.time() + seconds)

    def log(self, branch: str = "main") -> list[Version]:
        """Commits behind a branch, nearest first."""
        distance = self.store.ancestors(self.store.head(branch))
        return [self.store.version(v) for v in sorted(distance, key=lambda v: (distance[v], v))]

    def log_page(self, limit: int, cursor: str | None = None, branch: str = "main") -> tuple[list[Version], str | None]:
        """Commits behind a branch behind a cursor, and the cursor behind them; none at the end."""
        found = self.log(branch)
        at = 0 if cursor is None else next(i for i, v in enumerate(found) if v.id == cursor) + 1
        part = found[at : at + limit]
        return part, part[-1].id if at + limit < len(found) and part else None

    def check(self, branch: str = "main") -> list[str]:
        """Keys of objects whose size or digest isn't that of their bytes, over all commits of a branch."""
        bad = F.lit(False)
        bad = bad | (F.octet_length("payload") != F.col("size")) | (F.sha2("payload", 256) != F.col("etag"))
        return sorted({r["key"] for v in self.log(branch) for r in self.at(commit=v.id).where(bad).select("key").collect()})

    def repair(self, source: ObjectRepository, branch: str = "main") -> int:
        """Put damaged objects right from another repository that has the same versions of them; the number put right."""
        damaged = self.check(branch)
        sound = {k: source.read(k) for k in damaged}
        if damaged:
            self.write({k: v for k, v in sound.items() if v is not None}, branch=branch)
        return sum(v is not None for v in sound.values())

    def diff(self, old: str, new: str) -> DataFrame:
        return objects.object_diff(self.at(commit=old), self.at(commit=new))

    def merge(self, branch: str, other: str, policy: str = "fail"):
        """('conflicts', keys) with the branch unmoved under ``fail``, or ('applied', commit)."""
        ours, theirs = self.store.head(branch), self.store.head(other)
        base = self.store.merge_base(ours, theirs)
        sides = [self.at(commit=c) for c in (base, ours, theirs)]
        merged, conflicts = objects.merge_objects(*[s.select("key", "version_id") for s in sides], policy)
        if policy == "fail" and conflicts.limit(1).count():
            return "conflicts", conflicts.select("key")
        known = sides[0].unionByName(sides[1]).unionByName(sides[2]).dropDuplicates(["key", "version_id"])
        version = self.store.write(known.join(merged, ["key", "version_id"], "left_semi"), (ours, theirs))
        self.store.compare_and_swap(branch, ours, version.id)
        return "applied", version

    def unreferenced(self) -> list[str]:
        """Stored data that no commit names."""
        return self.store.reclaimable()


class CommitSession:
    """Puts and deletions that wait for one commit on the branch as it was at the start."""

    def __init__(self, repository: ObjectRepository, branch: str, until: float):
        self.repository, self.branch, self.until = repository, branch, until
        self.base, self.puts, self.gone = repository.store.head(branch), {}, set()

    def _open(self) -> None:
        if time.time() > self.until:
            raise RuntimeError("the session has expired")

    def put(self, key: str, payload: bytes) -> None:
        self._open()
        self.puts[key] = payload
        self.gone.discard(key)

    def delete(self, key: str) -> None:
        self._open()
        self.puts.pop(key, None)
        self.gone.add(key)

    def abort(self) -> None:
        self.puts, self.gone = {}, set()

    def publish(self) -> Version:
        """One commit; refused if the branch moved since the session began."""
        self._open()
        if self.repository.store.head(self.branch) != self.base:
            raise StaleRef(f"{self.branch} moved")
        done = self.repository.write(self.puts, self.gone, self.branch)
        self.base = done.id
        self.abort()
        return done
