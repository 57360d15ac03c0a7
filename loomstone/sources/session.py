"""Buffered changes with savepoints, and commits of several tables at once."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.mutate import apply_batch
from loomstone.operators.scan import scan
from loomstone.sources.files import Files
from loomstone.sources.store import StaleRef, Version, VersionStore

MOST_BUFFERED = 100_000
MOST_BUFFERED_BYTES = 64 << 20


class WriteSession:
    """Upserts and deletes over a version, visible to the session's own reads before they are committed.

    The buffer holds single changes on the driver, bounded in rows and bytes; bulk
    changes go through ``apply``, which takes a DataFrame.
    """

    def __init__(self, store: VersionStore, ref: str = "main", most: int = MOST_BUFFERED, most_bytes: int = MOST_BUFFERED_BYTES):
        self.store, self.ref, self.most, self.most_bytes = store, ref, most, most_bytes
        self.buffered_bytes = 0
        self.at = store.head(ref)
        self.base = store.snapshot(self.at)
        self.changes: dict[Any, tuple | None] = {}
        self.savepoints: dict[str, dict[Any, tuple | None]] = {}

    def put(self, *values) -> None:
        """One row, by the columns of the table."""
        row = tuple(values)
        self._buffer(row[self.base.columns.index(self.store.key)], row)

    def delete(self, key) -> None:
        self._buffer(key, None)

    def _buffer(self, key, row: tuple | None) -> None:
        size = len(repr(key)) + len(repr(row))
        if key not in self.changes and len(self.changes) >= self.most or self.buffered_bytes + size > self.most_bytes:
            raise RuntimeError(f"the session holds {len(self.changes)} changes of {self.buffered_bytes} bytes; flush it")
        self.changes[key], self.buffered_bytes = row, self.buffered_bytes + size

    def is_full(self) -> bool:
        return len(self.changes) >= self.most or self.buffered_bytes >= self.most_bytes

    def drain(self) -> list[tuple[Any, tuple | None]]:
        """The buffered changes in key order, taken out of the session; None for a deletion."""
        taken, self.changes, self.buffered_bytes = sorted(self.changes.items(), key=lambda x: x[0]), {}, 0
        return taken

    def flush(self) -> None:
        """Make room: what is buffered becomes part of the session's rows."""
        self.base, self.changes, self.buffered_bytes = self.rows(), {}, 0

    def apply(self, changes: DataFrame, op: str = "op") -> None:
        """Bulk upserts and deletes; they come after what is buffered."""
        self.base, self.changes = apply_batch(self.rows(), changes, self.store.key, op), {}

    def rows(self) -> DataFrame:
        """The table as the session sees it."""
        if not self.changes:
            return self.base
        spark, key = self.store.spark, self.store.key
        keys = spark.createDataFrame([(k,) for k in self.changes], f"`{key}` {dict(self.base.dtypes)[key]}")
        upserts = spark.createDataFrame([r for r in self.changes.values() if r is not None], self.base.schema)
        return self.base.join(F.broadcast(keys), key, "left_anti").select(self.base.columns).unionByName(upserts)

    def get(self, key):
        """The session's row of a key, or None."""
        if key in self.changes:
            return self.changes[key]
        found = self.base.where(F.col(self.store.key) == F.lit(key)).first()
        return tuple(found) if found else None

    def range(self, start=None, end=None) -> DataFrame:
        return scan(self.rows(), self.store.key, start, end)

    def savepoint(self, name: str) -> None:
        self.savepoints[name] = dict(self.changes)

    def revert(self, name: str) -> None:
        """Back to a savepoint; later ones stay usable."""
        self.changes = dict(self.savepoints[name])

    def commit(self) -> tuple[str, Version]:
        """Publish, if the ref hasn't moved since the session began."""
        done = self.store.commit(self.rows(), self.ref, expected=self.at)
        self.at = done[1].id
        self.base, self.changes, self.savepoints, self.buffered_bytes = self.store.snapshot(self.at), {}, {}, 0
        return done

    def rollback(self) -> None:
        """Forget all changes of the session."""
        self.base, self.changes, self.savepoints, self.buffered_bytes = self.store.snapshot(self.at), {}, {}, 0


class ReadSession:
    """Reads pinned to one version, whose rows are kept by the cluster while the session is open."""

    def __init__(self, store: VersionStore, ref: str = "main", version: str | None = None):
        self.store, self.version = store, version or store.head(ref)
        self.rows = store.snapshot(self.version).persist()

    def __enter__(self) -> ReadSession:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def get(self, key):
        found = self.rows.where(F.col(self.store.key) == F.lit(key)).first()
        return tuple(found) if found else None

    def get_many(self, keys: list) -> list:
        """Rows in the order of their keys, None where one is missing."""
        return self.store.get_many_at(self.version, keys)

    def get_with(self, key, read):
        """What a function makes of a row; None, without a call, if there is none."""
        found = self.get(key)
        return None if found is None else read(found)

    def get_many_with(self, keys: list, read) -> list:
        return [None if row is None else read(row) for row in self.get_many(keys)]

    def contains(self, key) -> bool:
        return self.rows.where(F.col(self.store.key) == F.lit(key)).limit(1).count() > 0

    def scan(self, start=None, end=None, batch: int = 1000) -> RangeScan:
        return RangeScan(self, start, end, batch)


class RangeScan:
    """A resumable scan: each call goes on behind the last row handed out."""

    def __init__(self, session: ReadSession, start, end, batch: int):
        self.session, self.start, self.end, self.batch, self.last = session, start, end, batch, None

    def next_until(self, stop=lambda row: False) -> list:
        """Rows up to and with the first for which ``stop`` is true, or one batch; empty at the end."""
        key = self.session.store.key
        start = self.start if self.last is None else None
        got = scan(self.session.rows, key, start, self.end, after=self.last).limit(self.batch).collect()
        for n, row in enumerate(got):
            self.last = row[key]
            if stop(row):
                return got[: n + 1]
        return got


class Catalog:
    """Several tables whose heads move together: one file names the version of each."""

    def __init__(self, root: str, tables: dict[str, VersionStore]):
        self.tables = tables
        self.files = Files(next(iter(tables.values())).spark, root)

    def heads(self) -> dict[str, str]:
        return json.loads(self.files.read("heads.json") or "{}")

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables as of one moment."""
        return {name: self.tables[name].snapshot(version) for name, version in self.heads().items()}

    def commit(self, changed: dict[str, DataFrame], expected: dict[str, str], token: str | None = None) -> dict[str, str]:
        """Write new states, then move all heads at once, if none of the changed tables moved.

        A token makes the commit idempotent: the same token gives the heads that it
        led to the first time and changes nothing.
        """
        if token and (known := self.files.read(f"tokens/{token}.json")):
            return json.loads(known)["heads"]
        written = {name: self.tables[name].write(rows, tuple(filter(None, (expected.get(name),)))).id for name, rows in changed.items()}
        with self.files.locked("heads.lock"):
            heads = self.heads()
            for name in changed:
                if heads.get(name) != expected.get(name):
                    raise StaleRef(f"{name} is at {heads.get(name)}, not {expected.get(name)}")
            moved = heads | written
            self.files.replace("heads.json", json.dumps(moved))
            self.files.create(f"tokens/{token or uuid.uuid4().hex}.json", json.dumps({"heads": moved, "at": time.time()}))
        return moved


class TypedMap:
    """A store's keys and values as Python objects, by a codec: functions from an object to a column's value and back."""

    def __init__(self, store: VersionStore, value: str, encode, decode, ref: str = "main"):
        self.store, self.value, self.encode, self.decode, self.ref = store, value, encode, decode, ref

    def get(self, key):
        row = self.store.get_many_at(self.store.head(self.ref), [key])[0]
        return None if row is None else self.decode(row[self.value])

    def put(self, key, value) -> Version:
        return self.store.put({self.store.key: key, self.value: self.encode(value)}, self.ref)[1]

    def entries(self, start=None, end=None):
        """(key, object) in key order; rows reach the driver one partition at a time."""
        for row in self.store.range_at(self.store.head(self.ref), start, end).toLocalIterator():
            yield row[self.store.key], self.decode(row[self.value])

    def migrate_from(self, change, ref: str | None = None) -> Version:
        """Commit all values changed by a function of their column, as one version."""
        rows = self.store.snapshot(self.store.head(ref or self.ref))
        return self.store.commit(rows.withColumn(self.value, change(F.col(self.value))), self.ref)[1]
