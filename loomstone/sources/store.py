"""A versioned table store: immutable key ranges in Parquet, version files and refs with compare-and-swap.

    data/<uuid>/_segment=<n>/  Parquet files of one key range
    changes/<uuid>/            changes that made a version, where they were kept
    versions/<id>.json         segments, schema, parents, generation, digest, row count, time
    refs/<name>.json           version id of a branch, tag, checkpoint or pin; names may hold slashes
    log/<sequence>.json        every move of a ref, numbered without gaps
    locks/                     lock files with owner and lease

A version's id is the SHA-256 of its schema, content digest, row count and
parents, so equal content on equal parents has an equal id whatever its files.
A version is a list of segments, each with its key range, row count and digest.
Changes rewrite the segments that they touch and share the others, and a
difference of versions reads only segments that the other side doesn't have.
Commits write data first, then the version, then move the ref.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstone.operators.diff import content_digest, diff_versions, digest_columns, joined_digest
from loomstone.operators.merge import Policy, Resolver, conflicts, merge, unresolved
from loomstone.operators.mutate import apply_batch, last_write_wins
from loomstone.operators.scan import Page, in_range
from loomstone.sources.files import Busy, Files, copy_files


class StaleRef(RuntimeError):
    """The ref moved since it was read."""


@dataclass(frozen=True)
class Segment:
    """One key range of a version: where it lies, its least and greatest key as text, its rows and their digest."""

    path: str
    low: str | None
    high: str | None
    n_rows: int
    digest: str

    @property
    def content(self) -> tuple:
        return self.low, self.high, self.n_rows, self.digest


@dataclass(frozen=True)
class Version:
    """One immutable state of a table."""

    id: str
    segments: tuple[Segment, ...]
    schema: str
    n_rows: int
    digest: str
    parents: tuple[str, ...]
    generation: int
    created_at: float | None
    changes: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(s.path for s in self.segments)


@dataclass(frozen=True)
class WriteStats:
    """What a batch of changes did."""

    n_input: int
    n_effective: int
    rows_written: int
    segments_written: int
    segments_reused: int


@dataclass
class GcPlan:
    """What a sweep would delete and what it would keep."""

    versions: list[str] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    live_versions: list[str] = field(default_factory=list)


class VersionStore:
    """Versions of one keyed table under a directory."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.key, self.files = spark, key, Files(spark, root)
        self.root = self.files.root

    # versions

    def write(self, rows: DataFrame, parents: tuple[str, ...] = (), created_at: float | None = None, partitions: int | None = None) -> Version:
        """Store a whole state as a version, without moving any ref. Rows lie in key ranges, sorted."""
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(n, self.key).withColumn("_segment", F.spark_partition_id())
        return self._register(self._segments(ranged, rows.columns), rows.schema.json(), parents, created_at)

    def _segments(self, placed: DataFrame, columns: list[str]) -> list[Segment]:
        """Write rows that carry their segment's number; each segment's range and digest come from one pass over it."""
        name = f"data/{uuid.uuid4().hex}"
        path, kinds = self.files.path(name), dict(placed.dtypes)
        placed.sortWithinPartitions("_segment", self.key).write.partitionBy("_segment").parquet(path)
        stored = self.spark.read.schema(placed.schema).parquet(path)
        ends = [self._text(F.min(self.key), kinds[self.key]).alias("low"), self._text(F.max(self.key), kinds[self.key]).alias("high")]
        sealed = stored.groupBy("_segment").agg(*ends, *digest_columns(columns, kinds)).orderBy("_segment").collect()
        return [Segment(f"{path}/_segment={r['_segment']}", r["low"], r["high"], r["n_rows"], joined_digest(r["sum_a"], r["sum_b"])) for r in sealed]

    @staticmethod
    def _text(key: Column, kind: str) -> Column:
        return F.hex(key) if kind == "binary" else key.cast("string")

    def _literal(self, text: str, kind: str) -> Column:
        return F.unhex(F.lit(text)) if kind == "binary" else F.lit(text).cast(kind)

    def _register(self, segments: list[Segment], schema: str, parents: tuple[str, ...], created_at: float | None = None, changes: str | None = None) -> Version:
        sums = [sum(int(s.digest[k : k + 16], 16) for s in segments) for k in (0, 16)]
        n_rows, digest = sum(s.n_rows for s in segments), joined_digest(*sums)
        generation = max((self.version(p).generation for p in parents), default=-1) + 1
        identity = json.dumps([schema, n_rows, digest, list(parents)])
        version = Version(
            hashlib.sha256(identity.encode()).hexdigest(), tuple(segments), schema, n_rows, digest, tuple(parents), generation,
            time.time() if created_at is None else created_at, changes,
        )
        if not self.files.create(f"versions/{version.id}.json", json.dumps(asdict(version))):
            known = self.version(version.id)
            for path in {s.path.rpartition("/_segment=")[0] for s in segments} - {s.path.rpartition("/_segment=")[0] for s in known.segments}:
                if not any(s.path.startswith(path + "/") for p in parents for s in self.version(p).segments):
                    self.files.delete(path.removeprefix(self.root + "/"))
            return known
        return version

    def version(self, version_id: str) -> Version:
        raw = self.files.read(f"versions/{version_id}.json")
        if raw is None:
            raise KeyError(f"version {version_id} isn't here, or was pruned")
        found = json.loads(raw)
        return Version(**{**found, "segments": tuple(Segment(**s) for s in found["segments"]), "parents": tuple(found["parents"])})

    def has(self, version_id: str) -> bool:
        return self.files.exists(f"versions/{version_id}.json")

    def versions(self) -> list[Version]:
        """All versions, newest first; without a time last; ties by id."""
        found = [self.version(n.removesuffix(".json")) for n in self.files.names("versions", ".json")]
        return sorted(found, key=lambda v: (v.created_at is None, -(v.created_at or 0), v.id))

    def _read(self, version: Version, segments: list[Segment] | tuple[Segment, ...]) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in segments])

    def snapshot(self, version_id: str) -> DataFrame:
        """The rows of a version as a lazy scan."""
        version = self.version(version_id)
        return self._read(version, version.segments)

    def get_many_at(self, version_id: str, keys: list) -> list:
        """Rows of keys in their order, None where one is missing; reads only segments whose range can hold a key."""
        version = self.version(version_id)
        kind = StructType.fromJson(json.loads(version.schema))[self.key].dataType.simpleString()
        inside = F.lit(False)
        for k in keys:
            inside = inside | (F.col(self.key) == F.lit(k).cast(kind))
        found = {r[self.key]: r for r in self.snapshot(version_id).where(inside).collect()}
        return [found.get(k) for k in keys]

    def range_at(self, version_id: str, start=None, end=None) -> DataFrame:
        return self.snapshot(version_id).where(in_range(self.key, start, end)).orderBy(self.key)

    def select(self, version_id: str, ordinal: int):
        """The row at a 0-based place in key order: segment counts name the one segment to read."""
        version = self.version(version_id)
        for segment in version.segments:
            if ordinal < segment.n_rows:
                return self._read(version, [segment]).orderBy(self.key).offset(ordinal).first()
            ordinal -= segment.n_rows
        return None

    # refs

    def head(self, ref: str = "main") -> str | None:
        raw = self.files.read(f"refs/{ref}.json")
        return json.loads(raw)["version"] if raw else None

    def refs(self, prefix: str = "") -> dict[str, str]:
        """Refs by name, in order."""
        names = [n.removesuffix(".json") for n in self.files.names("refs", ".json")]
        return {n: self.head(n) for n in names if n.startswith(prefix)}

    def refs_page(self, prefix: str = "", after: str | None = None, limit: int = 100) -> Page:
        """(name, version) behind a name; the cursor is the last name if more follow."""
        found = [(n, v) for n, v in self.refs(prefix).items() if after is None or n > after]
        return Page(found[:limit], found[limit - 1][0] if limit and len(found) > limit else None)

    def newest_by_name(self, prefix: str, count: int) -> list[str]:
        """The greatest names with a prefix."""
        return sorted(self.refs(prefix), reverse=True)[:count]

    def compare_and_swap(self, ref: str, expected: str | None, version_id: str | None) -> None:
        """Move a ref (None: remove it) if it still is where it was, and log the move."""
        with self._locked(ref):
            if self.head(ref) != expected:
                raise StaleRef(f"{ref} is at {self.head(ref)}, not {expected}")
            if version_id is None:
                self.files.delete(f"refs/{ref}.json")
            else:
                self.files.replace(f"refs/{ref}.json", json.dumps({"version": self.version(version_id).id}))
            self._log(ref, expected, version_id)

    def branch(self, name: str, at: str) -> None:
        self.compare_and_swap(name, None, at)

    def tag(self, name: str, at: str) -> None:
        """A name that never moves."""
        self.compare_and_swap(f"tags/{name}", None, at)

    def checkpoint(self, name: str, at: str) -> None:
        self.compare_and_swap(f"checkpoints/{name}", self.head(f"checkpoints/{name}"), at)

    def pin(self, name: str, at: str) -> None:
        """Hold a version against pruning until it is released."""
        self.compare_and_swap(f"pins/{name}", None, at)

    def release_pin(self, name: str) -> None:
        self.compare_and_swap(f"pins/{name}", self.head(f"pins/{name}"), None)

    def rollback(self, version_id: str, ref: str = "main") -> None:
        """Move a ref to an old version; later versions stay."""
        self.compare_and_swap(ref, self.head(ref), version_id)

    def _log(self, ref: str, old: str | None, new: str | None) -> None:
        names = self.files.names("log", ".json")
        sequence = int(names[-1].removesuffix(".json")) + 1 if names else 1
        while not self.files.create(f"log/{sequence:012d}.json", json.dumps({"sequence": sequence, "ref": ref, "old": old, "new": new, "at": time.time()})):
            sequence += 1

    def moves(self, after: int = 0, limit: int = 100, ref: str | None = None) -> Page:
        """Logged moves of refs behind a sequence number; the cursor resumes there, also after a restart."""
        found = [json.loads(self.files.read(f"log/{n}")) for n in self.files.names("log", ".json") if int(n.removesuffix(".json")) > after]
        found = [m for m in found if ref is None or m["ref"] == ref]
        return Page(found[:limit], found[min(limit, len(found)) - 1]["sequence"] if found and limit else after)

    # changes

    def initialize(self, schema: str | StructType, ref: str = "main") -> Version:
        """A ref's first version, without rows."""
        version = self.write(self.spark.createDataFrame([], schema))
        self.compare_and_swap(ref, None, version.id)
        return version

    def commit(self, rows: DataFrame, ref: str = "main", expected: str | None | bool = True) -> tuple[str, Version]:
        """('applied' or 'unchanged', version) of a whole new state. ``expected`` is the version that it was made on."""
        at = self.head(ref) if expected is True else expected
        if at is not None and self._same(rows, self.version(at)):
            return "unchanged", self.version(at)
        version = self.write(rows, (at,) if at else ())
        self.compare_and_swap(ref, at, version.id)
        return "applied", version

    def apply(self, changes: DataFrame, ref: str = "main", expected: str | None | bool = True, ordinal: str | None = None, op: str = "op", keep_changes: bool = False) -> tuple[str, Version, WriteStats]:
        """Upserts and deletes by key on a ref's head: only segments that a change falls into are read and written.

        ('applied' or 'unchanged', version, what it took); of several changes of a
        key the last by ``ordinal`` counts. ``keep_changes`` stores them with the version.
        """
        at = self.head(ref) if expected is True else expected
        base = self.version(at)
        final = last_write_wins(changes, [self.key], [ordinal]).drop(ordinal) if ordinal else changes
        columns = StructType.fromJson(json.loads(base.schema)).names
        place = self._segment_of(base, dict(final.dtypes)[self.key])
        placed = final.withColumn("_segment", place)
        touched = sorted(r[0] for r in placed.select("_segment").distinct().collect())
        if not touched:
            return "unchanged", base, WriteStats(0, 0, 0, 0, len(base.segments))
        old = self._read(base, [base.segments[k] for k in touched if k < len(base.segments)])
        new = apply_batch(old, final, self.key, op).select(*columns).withColumn("_segment", place)
        written = self._segments(new.repartition(len(touched), "_segment"), columns)
        by_number = {int(s.path.rpartition("=")[2]): s for s in written}
        segments, reused = [], 0
        for k in range(max(len(base.segments), max(touched) + 1)):
            before, after = base.segments[k] if k < len(base.segments) else None, by_number.get(k)
            if k not in touched or before and after and before.content == after.content:
                segments.append(before)
                reused += 1
            elif after:
                segments.append(after)
        kept = None
        if keep_changes:
            kept = self.files.path(f"changes/{uuid.uuid4().hex}")
            final.write.parquet(kept)
        n_input = changes.count()
        if [s.content for s in segments] == [s.content for s in base.segments]:
            return "unchanged", base, WriteStats(n_input, 0, 0, 0, reused)
        version = self._register(segments, base.schema, (at,), changes=kept)
        stats = WriteStats(n_input, final.count() if ordinal else n_input, sum(s.n_rows for s in written), len(written), reused)
        self.compare_and_swap(ref, at, version.id)
        return "applied", version, stats

    def _segment_of(self, version: Version, kind: str) -> Column:
        """The number of the segment that a key belongs to: the last whose least key isn't above it, else the first.

        A binary search, so a row costs the logarithm of the number of segments.
        """
        if len(version.segments) < 2:
            return F.lit(0)
        lows = F.array(*[self._literal(s.low, kind) for s in version.segments[1:]])
        steps = [1 << k for k in reversed(range((len(version.segments) - 1).bit_length()))]
        further = lambda at, step: F.when(F.get(lows, at + step - 1) <= F.col(self.key), at + step).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)

    def changes_of(self, version_id: str) -> DataFrame | None:
        """The changes that were kept with a version; its parent with them gives it again."""
        kept = self.version(version_id).changes
        return self.spark.read.parquet(kept) if kept else None

    def rebalance(self, ref: str = "main", partitions: int | None = None) -> Version:
        """The same content in new key ranges of even size: the version keeps its id and gets new segments."""
        base = self.version(self.head(ref))
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self._read(base, base.segments)
        ranged = rows.repartitionByRange(n, self.key).withColumn("_segment", F.spark_partition_id())
        even = replace(base, segments=tuple(self._segments(ranged, rows.columns)))
        self.files.replace(f"versions/{base.id}.json", json.dumps(asdict(even)))
        return even

    def _same(self, rows: DataFrame, version: Version) -> bool:
        n_rows, digest = content_digest(rows)
        return (n_rows, digest, rows.schema.json()) == (version.n_rows, version.digest, version.schema)

    def differing(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        """Rows of the segments that only one of two versions has; equal segments are never read."""
        a, b = self.version(old), self.version(new)
        in_a, in_b = {s.content for s in a.segments}, {s.content for s in b.segments}
        return self._read(a, [s for s in a.segments if s.content not in in_b]), self._read(b, [s for s in b.segments if s.content not in in_a])

    def diff(self, old: str, new: str, value: str) -> DataFrame:
        """Rows that differ between two versions."""
        return diff_versions(*self.differing(old, new), [self.key], value)

    def diff_page(self, old: str, new: str, value: str, limit: int, cursor=None) -> Page:
        """A page of the difference in key order and where the next begins; resumes from the cursor alone."""
        from loomstone.operators.diff import diff_page

        return diff_page(*self.differing(old, new), self.key, value, limit, cursor)

    def changes_since(self, old: str, value: str, ref: str = "main") -> DataFrame:
        return self.diff(old, self.head(ref), value)

    def merge(self, ref: str, other: str, value: str, resolver: Resolver | Policy = unresolved) -> tuple[str, DataFrame | Version]:
        """Merge a version into a ref: ('conflicts', rows) with the ref unmoved, or ('applied', version)."""
        ours = self.head(ref)
        base = self.merge_base(ours, other)
        if base == other:
            return "unchanged", self.version(ours)
        if base == ours:
            self.compare_and_swap(ref, ours, other)
            return "applied", self.version(other)
        sides = [self.snapshot(v) for v in (base, ours, other)]
        if resolver is unresolved:
            found = conflicts(*sides, self.key, value)
            if found.limit(1).count():
                return "conflicts", found
        version = self.write(merge(*sides, self.key, value, resolver), (ours, other))
        self.compare_and_swap(ref, ours, version.id)
        return "applied", version

    def ancestors(self, version_id: str) -> dict[str, int]:
        """Distance of every ancestor; walks version files, not data."""
        found, level, depth = {}, [version_id], 0
        while level:
            found |= {v: depth for v in level if v not in found}
            level = sorted({p for v in level for p in self.version(v).parents if self.has(p)} - set(found))
            depth += 1
        return found

    def is_ancestor(self, ancestor: str, descendant: str) -> bool:
        return ancestor in self.ancestors(descendant)

    def merge_base(self, a: str, b: str) -> str | None:
        """Greatest generation, then least distance, then least id."""
        x, y = self.ancestors(a), self.ancestors(b)
        return min(set(x) & set(y), key=lambda v: (-self.version(v).generation, x[v] + y[v], v), default=None)

    # feed, retention, transfer

    def poll(self, last_seen: str | None, value: str, ref: str = "main") -> tuple[str, DataFrame] | None:
        """(head, changes since ``last_seen``), None if there are none; versions between are not shown."""
        head = self.head(ref)
        if head == last_seen or head is None:
            return None
        if last_seen is None:
            empty = self.snapshot(head).limit(0)
            return head, diff_versions(empty, self.snapshot(head), [self.key], value)
        if not self.has(last_seen):
            raise KeyError(f"version {last_seen} was pruned")
        return head, self.diff(last_seen, head, value)

    def plan_prune(self, keep_last: int | None = None, since: float | None = None, ids: set[str] | None = None) -> GcPlan:
        """What retention would drop: versions that no rule keeps, and the data only they name. Refs, pins included, hold theirs, and by age those without a time stay."""
        held, ordered = set(self.refs().values()), self.versions()
        if keep_last is not None:
            held |= {v.id for v in ordered[:keep_last]}
        if since is not None:
            held |= {v.id for v in ordered if v.created_at is None or v.created_at >= since}
        if ids is not None:
            if unknown := ids - {v.id for v in ordered}:
                raise KeyError(f"unknown versions: {sorted(unknown)}")
            held |= ids
        live = [v for v in ordered if v.id in held]
        return GcPlan([v.id for v in ordered if v.id not in held], self._unnamed(live), [v.id for v in live])

    def _unnamed(self, live: list[Version]) -> list[str]:
        """Stored segments and kept changes that no live version names."""
        named = {p for v in live for p in v.paths} | {v.changes for v in live}
        stored = [self.files.path(f"data/{d}/{s}") for d in self.files.folders("data") for s in self.files.folders(f"data/{d}")]
        return sorted(p for p in [*stored, *(self.files.path(f"changes/{c}") for c in self.files.folders("changes"))] if p not in named)

    def prune(self, keep_last: int | None = None, since: float | None = None, ids: set[str] | None = None) -> list[str]:
        """Drop the version files that a plan names; their data goes with the next sweep."""
        plan = self.plan_prune(keep_last, since, ids)
        for version_id in plan.versions:
            self.files.delete(f"versions/{version_id}.json")
        return plan.versions

    def reclaimable(self) -> list[str]:
        """Stored segments that no version names."""
        return self._unnamed(self.versions())

    def sweep(self, plan: GcPlan | None = None) -> int:
        """Delete what is reclaimable, or what a plan names and still no live version uses; the number of segments."""
        if plan:
            for version_id in set(plan.versions) - set(self.refs().values()):
                self.files.delete(f"versions/{version_id}.json")
        gone = self.reclaimable()
        for path in gone:
            self.files.delete(path.removeprefix(self.root + "/"))
        for folder in self.files.folders("data"):
            if not self.files.folders(f"data/{folder}"):
                self.files.delete(f"data/{folder}")
        return len(gone)

    def missing_from(self, target: VersionStore, version_id: str) -> list[Segment]:
        """Segments of a version that another store doesn't have, by content."""
        there = {s.content for v in target.versions() for s in v.segments}
        return [s for s in self.version(version_id).segments if s.content not in there]

    def copy_to(self, target: VersionStore, version_id: str) -> int:
        """Copy a version and its ancestors, but only segments that the target lacks; the number of segments copied."""
        copied, there = 0, {s.content: s for v in target.versions() for s in v.segments}
        order = self.ancestors(version_id)
        for known in sorted(order, key=lambda v: -order[v]):
            if target.has(known):
                continue
            version, pairs, moved = self.version(known), [], []
            for segment in version.segments:
                if segment.content not in there:
                    folder = target.files.path(f"data/{uuid.uuid4().hex}/_segment=0")
                    source = segment.path.removeprefix(self.root + "/")
                    pairs += [(f"{segment.path}/{n}", f"{folder}/{n}") for n in self.files.names(source, ".parquet")]
                    there[segment.content] = replace(segment, path=folder)
                    copied += 1
                moved.append(there[segment.content])
            copy_files(self.spark, pairs)
            target.files.create(f"versions/{known}.json", json.dumps(asdict(replace(version, segments=tuple(moved), changes=None))))
        return copied

    def backup(self, target: str) -> None:
        """Copy all versions and refs; data goes from task to file, not through the driver."""
        other = VersionStore(self.spark, target, self.key)
        for version in self.versions():
            self.copy_to(other, version.id)
        for ref, version_id in self.refs().items():
            other.compare_and_swap(ref, other.head(ref), version_id)

    def restore(self, backup: str) -> None:
        """Fill an empty store from a backup and verify it."""
        if self.versions():
            raise RuntimeError("restore needs an empty store")
        VersionStore(self.spark, backup, self.key).backup(self.root)
        self.verify()

    def export_snapshot(self, version_id: str, target: str) -> None:
        """One version as a bundle: its rows and a manifest with their digest and that of the manifest."""
        version = self.version(version_id)
        self._read(version, version.segments).write.parquet(f"{target}/rows")
        body = {"id": version.id, "schema": version.schema, "n_rows": version.n_rows, "digest": version.digest, "key": self.key}
        seal = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        Files(self.spark, target).replace("manifest.json", json.dumps(body | {"seal": seal}))

    def import_snapshot(self, bundle: str) -> Version:
        """Store a bundle's rows as a version without parents, after both digests were checked."""
        found = json.loads(Files(self.spark, bundle).read("manifest.json"))
        seal = found.pop("seal")
        if hashlib.sha256(json.dumps(found, sort_keys=True).encode()).hexdigest() != seal:
            raise RuntimeError("the bundle's manifest is damaged")
        rows = self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(f"{bundle}/rows")
        if content_digest(rows) != (found["n_rows"], found["digest"]):
            raise RuntimeError("the bundle's rows are damaged")
        return self.write(rows)

    def verify(self) -> None:
        """Read every version and compare its digest."""
        for version in self.versions():
            if not self._same(self.snapshot(version.id), version):
                raise RuntimeError(f"version {version.id} is damaged")

    @contextmanager
    def _locked(self, ref: str):
        try:
            with self.files.locked(f"locks/{ref}.lock"):
                yield
        except Busy as busy:
            raise StaleRef(str(busy)) from busy

    # single rows and retries

    def edit(self, change, ref: str = "main", tries: int = 8) -> tuple[str, Version]:
        """Commit what a function makes of the head's rows; if the head moved meanwhile, do it again on the new one."""
        for attempt in range(tries):
            at = self.head(ref)
            try:
                return self.commit(change(self.snapshot(at)), ref, expected=at)
            except StaleRef:
                if attempt + 1 == tries:
                    raise
        raise StaleRef(ref)

    def _single(self, row: dict[str, Any], op: str, at: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.version(at).schema))
        return self.spark.createDataFrame([tuple(row.get(c) for c in schema.names)], schema).withColumn("op", F.lit(op))

    def put(self, row: dict[str, Any], ref: str = "main", expected: str | None | bool = True) -> tuple[str, Version]:
        """Upsert one row."""
        at = self.head(ref) if expected is True else expected
        return self.apply(self._single(row, "upsert", at), ref, at)[:2]

    def delete(self, key, ref: str = "main", expected: str | None | bool = True) -> tuple[str, Version]:
        """Delete one key; none there is no change."""
        at = self.head(ref) if expected is True else expected
        return self.apply(self._single({self.key: key}, "delete", at), ref, at)[:2]
