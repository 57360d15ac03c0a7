"""A table and its secondary indexes under one head.

    source/           versions of the table
    index-<name>/     versions of an index: (entry, term, pk, projection), keyed by entry = (term, pk) in order
    heads/<name>.json the version of the source and of every index that belong together
    definitions.json  the registered indexes

Changes go through ``apply``: the source changes, the entries of changed rows
follow, and one file moves the head, so no reader sees one without the other.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.keys import i64_key, segment
from loomstone.operators import index as entries
from loomstone.operators.scan import in_range
from loomstone.sources.files import Files
from loomstone.sources.store import StaleRef, Version, VersionStore
from loomstone.staging import Staged, if_small

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


class BudgetExceeded(RuntimeError):
    """A query would return or read more than it may."""


class StaleCursor(ValueError):
    """The cursor belongs to another snapshot, index, range or direction."""


@dataclass(frozen=True)
class Definition:
    """How rows become entries: SQL of the term (an array with ``many``), columns carried along, an extractor's generation."""

    name: str
    term: str
    projection: tuple[str, ...] = ()
    many: bool = False
    generation: int = 1

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _ordered(value: Column, kind: str) -> Column:
    return i64_key(value) if kind in INTEGRAL else value.cast("string").cast("binary")


class IndexedSnapshot:
    """The source and its indexes as they were at one head."""

    def __init__(self, store: IndexedStore, heads: dict):
        self.store, self.heads = store, heads
        self.id = hashlib.sha256(json.dumps([heads["source"], heads["indexes"]], sort_keys=True).encode()).hexdigest()

    @property
    def source(self) -> DataFrame:
        return self.store.source.snapshot(self.heads["source"])

    def index(self, name: str) -> DataFrame:
        if name not in self.heads["indexes"]:
            raise KeyError(f"no active index {name}")
        return self.store.index_store(name).snapshot(self.heads["indexes"][name]).drop("entry")

    def exact(self, name: str, term: Any) -> DataFrame:
        return entries.exact(self.index(name), term)

    def prefix(self, name: str, start: str) -> DataFrame:
        return entries.prefix(self.index(name), start)

    def range(self, name: str, start: Any = None, end: Any = None, descending: bool = False) -> DataFrame:
        return entries.term_range(self.index(name), start, end, descending)

    def records(self, found: DataFrame) -> DataFrame:
        """Source rows of entries; an entry without its row is an error."""
        return entries.join_back(found.select("term", "pk"), self.source, self.store.source.key)

    def page(self, name: str, limit: int, cursor: str | None = None, start: Any = None, end: Any = None, descending: bool = False) -> tuple[list, str | None]:
        """Entries of a range of terms in order and the cursor behind them, which fits this snapshot and query only."""
        bound = hashlib.sha256(json.dumps([self.id, self.store.definitions()[name].fingerprint, str(start), str(end), descending]).encode()).hexdigest()
        rows = self.index(name).where(in_range("term", start, end))
        if cursor is not None:
            seal, term, pk = json.loads(cursor)
            if seal != bound:
                raise StaleCursor("the cursor is for another query")
            place = F.struct(F.lit(term).alias("term"), F.lit(pk).alias("pk"))
            rows = rows.where(F.struct("term", "pk") < place if descending else F.struct("term", "pk") > place)
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("term", "pk")]
        got = rows.orderBy(*order).limit(limit).collect()
        return got, json.dumps([bound, got[-1]["term"], got[-1]["pk"]]) if limit and len(got) == limit else None

    def budgeted(self, found: DataFrame, most_rows: int, most_bytes: int | None = None) -> list:
        """The rows of a query, or an error if there are more, or more bytes, than the budget; reads one row more at most."""
        got = found.limit(most_rows + 1).collect()
        if len(got) > most_rows:
            raise BudgetExceeded(f"more than {most_rows} rows")
        if most_bytes is not None and sum(len(repr(tuple(r))) for r in got) > most_bytes:
            raise BudgetExceeded(f"more than {most_bytes} bytes")
        return got


class IndexedStore:
    """Versions of a keyed table whose indexes move with it."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.files = spark, Files(spark, root)
        self.source = VersionStore(spark, self.files.path("source"), key)

    def index_store(self, name: str) -> VersionStore:
        return VersionStore(self.spark, self.files.path(f"index-{name}"), "entry")

    # definitions

    def definitions(self) -> dict[str, Definition]:
        found = json.loads(self.files.read("definitions.json") or "{}")
        return {n: Definition(**{**d, "projection": tuple(d["projection"])}) for n, d in found.items()}

    def _define(self, definitions: dict[str, Definition]) -> None:
        self.files.replace("definitions.json", json.dumps({n: asdict(d) for n, d in definitions.items()}))

    def register(self, definition: Definition, branch: str = "main") -> Version | None:
        """Add an index and build it for the branch's head; one of this name may not be there."""
        known = self.definitions()
        if definition.name in known:
            raise ValueError(f"index {definition.name} is registered; replace it")
        self._define(known | {definition.name: definition})
        return self._rebuild(definition, branch)

    def replace(self, definition: Definition, branch: str = "main") -> Version | None:
        """Another definition under the name of one that is registered, with a later generation."""
        known = self.definitions()
        if definition.generation <= known[definition.name].generation:
            raise ValueError("a replacement needs a later generation")
        self._define(known | {definition.name: definition})
        return self._rebuild(definition, branch)

    def deactivate(self, name: str, branch: str = "main") -> None:
        """Take an index out of the head and of the definitions; old heads keep theirs."""
        known = self.definitions()
        known.pop(name)
        self._define(known)
        heads = self.heads(branch)
        self._move(branch, heads, heads | {"indexes": {n: v for n, v in heads["indexes"].items() if n != name}})

    def entries_of(self, rows: DataFrame, definition: Definition) -> DataFrame:
        """Index entries of source rows."""
        built = entries.build(rows, self.source.key, F.expr(definition.term), *definition.projection, many=definition.many)
        kinds = dict(built.dtypes)
        entry = F.concat(segment(_ordered(F.col("term"), kinds["term"])), segment(_ordered(F.col("pk"), kinds["pk"])))
        return built.select(entry.alias("entry"), "*")

    def _rebuild(self, definition: Definition, branch: str) -> Version | None:
        heads = self.heads(branch)
        if not heads["source"]:
            return None
        built = self.index_store(definition.name).write(self.entries_of(self.source.snapshot(heads["source"]), definition))
        self._move(branch, heads, heads | {"indexes": heads["indexes"] | {definition.name: built.id}})
        return built

    # heads

    def heads(self, branch: str = "main") -> dict:
        return json.loads(self.files.read(f"heads/{branch}.json") or '{"source": null, "indexes": {}}')

    def _move(self, branch: str, expected: dict, heads: dict) -> None:
        with self.files.locked(f"locks/{branch}.lock"):
            if self.heads(branch) != expected:
                raise StaleRef(f"{branch} moved")
            self.files.replace(f"heads/{branch}.json", json.dumps(heads))
            self.files.create(f"history/{heads['source']}-{len(self.files.names('history'))}.json", json.dumps(heads))

    def initialize(self, rows: DataFrame, branch: str = "main") -> dict:
        """The first state of the source, with all registered indexes."""
        heads = self.heads(branch)
        if heads["source"]:
            raise ValueError("the table is there already")
        version = self.source.write(rows)
        built = {n: self.index_store(n).write(self.entries_of(rows, d)).id for n, d in self.definitions().items()}
        self._move(branch, heads, {"source": version.id, "indexes": built})
        return self.heads(branch)

    def apply(self, changes: DataFrame, branch: str = "main", expected: str | None = None, ordinal: str | None = None) -> dict:
        """Upserts and deletes (``op``) of source rows, with their entries; conditional on the source's version if one is given."""
        heads = self.heads(branch)
        if expected is not None and heads["source"] != expected:
            raise StaleRef(f"{branch} is at {heads['source']}, not {expected}")
        self.source.files.replace("refs/work.json", json.dumps({"version": heads["source"]}))
        _, version, _ = self.source.apply(changes, "work", heads["source"], ordinal)
        if version.id == heads["source"]:
            return heads
        before, after = self.source.differing(heads["source"], version.id)
        touched = Staged(changes.select(self.source.key).distinct(), "touched")
        old, new = (rows.join(if_small(touched), self.source.key, "left_semi") for rows in (before, after))
        moved = {}
        for name, definition in self.definitions().items():
            store, at = self.index_store(name), heads["indexes"].get(name)
            if at is None:
                moved[name] = store.write(self.entries_of(self.source.snapshot(version.id), definition)).id
                continue
            gone, come = self.entries_of(old, definition), self.entries_of(new, definition)
            changed = Staged(self._entry_changes(gone, come), "entries")
            store.files.replace("refs/work.json", json.dumps({"version": at}))
            moved[name] = store.apply(changed.df, "work", at)[1].id
            changed.drop()
        touched.drop()
        self._move(branch, heads, {"source": version.id, "indexes": moved})
        return self.heads(branch)

    @staticmethod
    def _entry_changes(gone: DataFrame, come: DataFrame) -> DataFrame:
        """Entries to delete and to upsert; one that stays as it was is neither, unless it holds a map, which has no equality."""
        columns = [c for c in come.columns if c != "entry"]
        was, now = gone.select("entry", F.struct(*columns).alias("_was")), come.select("entry", F.struct(*columns).alias("_now"))
        met = was.join(now, "entry", "full_outer")
        if not any("map<" in kind or "variant" in kind for _, kind in come.dtypes):
            met = met.where(~F.col("_was").eqNullSafe(F.col("_now")))
        row = F.coalesce("_now", "_was")
        return met.select("entry", *[row[c].alias(c) for c in columns], F.when(F.col("_now").isNull(), "delete").otherwise("upsert").alias("op"))

    def put(self, row: dict[str, Any], branch: str = "main", expected: str | None = None) -> dict:
        return self.apply(self.source._single(row, "upsert", self.heads(branch)["source"]), branch, expected)

    def delete(self, key, branch: str = "main", expected: str | None = None) -> dict:
        return self.apply(self.source._single({self.source.key: key}, "delete", self.heads(branch)["source"]), branch, expected)

    def snapshot(self, branch: str = "main") -> IndexedSnapshot:
        return IndexedSnapshot(self, self.heads(branch))

    def snapshot_at(self, source_version: str) -> IndexedSnapshot:
        """The last head that held a version of the source."""
        found = [n for n in self.files.names("history", ".json") if n.startswith(f"{source_version}-")]
        if not found:
            raise KeyError(f"no head held {source_version}")
        last = max(found, key=lambda n: int(n.removesuffix(".json").rpartition("-")[2]))
        return IndexedSnapshot(self, json.loads(self.files.read(f"history/{last}")))

    def snapshot_by_id(self, snapshot_id: str) -> IndexedSnapshot:
        for name in self.files.names("history", ".json"):
            found = IndexedSnapshot(self, json.loads(self.files.read(f"history/{name}")))
            if found.id == snapshot_id:
                return found
        raise KeyError(snapshot_id)

    # care

    def verify_index(self, name: str, branch: str = "main") -> DataFrame:
        """Entries of the head's index that a fresh build hasn't, or the other way round."""
        heads = self.heads(branch)
        fresh = self.entries_of(self.source.snapshot(heads["source"]), self.definitions()[name])
        return entries.verify(self.index_store(name).snapshot(heads["indexes"][name]), fresh)

    def verify_all(self, branch: str = "main") -> dict[str, int]:
        return {name: self.verify_index(name, branch).count() for name in self.heads(branch)["indexes"]}

    def repair_index(self, name: str, branch: str = "main") -> Version:
        """A fresh build in place of the head's index."""
        return self._rebuild(self.definitions()[name], branch)

    def health(self, branch: str = "main") -> dict[str, str]:
        """Per registered index: active, missing, or unregistered."""
        active, known = self.heads(branch)["indexes"], self.definitions()
        return {n: "active" if n in active else "missing" for n in known} | {n: "unregistered" for n in active if n not in known}

    def pin(self, name: str, snapshot: IndexedSnapshot) -> None:
        """Hold a snapshot's versions against collection."""
        if not self.files.create(f"pins/{name}.json", json.dumps(snapshot.heads)):
            raise ValueError(f"pin {name} is there")

    def release_pin(self, name: str) -> None:
        self.files.delete(f"pins/{name}.json")

    def collect(self, keep_last: int = 1, apply: bool = False) -> dict[str, list[str]]:
        """Versions that no head, pin or one of the last heads names, by store; deleted with their data if ``apply``."""
        held = [json.loads(self.files.read(f"{d}/{n}")) for d in ("heads", "pins") for n in self.files.names(d, ".json")]
        past = sorted(self.files.names("history", ".json"), key=lambda n: int(n.removesuffix(".json").rpartition("-")[2]))
        held += [json.loads(self.files.read(f"history/{n}")) for n in past[-keep_last:]]
        stores = {"source": (self.source, {h["source"] for h in held})}
        for name in {n for h in held for n in h["indexes"]} | set(self.definitions()):
            stores[f"index-{name}"] = (self.index_store(name), {h["indexes"].get(name) for h in held})
        plan = {}
        for label, (store, live) in stores.items():
            plan[label] = sorted(v.id for v in store.versions() if v.id not in live)
            if apply:
                store.files.delete("refs/work.json")
                for version in plan[label]:
                    store.files.delete(f"versions/{version}.json")
                store.sweep()
        return plan

    def export_current(self, target: str, branch: str = "main") -> None:
        """The head's source and indexes as bundles with one manifest."""
        heads = self.heads(branch)
        self.source.export_snapshot(heads["source"], f"{target}/source")
        for name, version in heads["indexes"].items():
            self.index_store(name).export_snapshot(version, f"{target}/index-{name}")
        definitions = {n: asdict(d) for n, d in self.definitions().items()}
        Files(self.spark, target).replace("bundle.json", json.dumps({"definitions": definitions, "indexes": sorted(heads["indexes"])}))

    def import_current(self, bundle: str, branch: str = "main", check: bool = True) -> dict:
        """An exported table in an empty store; with ``check`` every index is compared with a fresh build."""
        found, heads = json.loads(Files(self.spark, bundle).read("bundle.json")), self.heads(branch)
        self._define({n: Definition(**{**d, "projection": tuple(d["projection"])}) for n, d in found["definitions"].items()})
        source = self.source.import_snapshot(f"{bundle}/source")
        built = {n: self.index_store(n).import_snapshot(f"{bundle}/index-{n}").id for n in found["indexes"]}
        self._move(branch, heads, {"source": source.id, "indexes": built})
        if check and any(self.verify_all(branch).values()):
            raise RuntimeError("an imported index doesn't fit its source")
        return self.heads(branch)
