"""Document tables: conditional single-item changes, atomic batches, queries with limits before filters.

``DocumentTable`` works on one DataFrame. ``DocumentDatabase`` keeps many tables as
versions whose heads move together, with definitions, transactions, expiry,
archives, a feed of commits and leases for workers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

from loomstone.functions import conditions
from loomstone.functions.keys import i64_key, segments
from loomstone.operators.scan import Page
from loomstone.operators.views import ttl_candidates
from loomstone.sources.files import Files
from loomstone.sources.store import StaleRef, VersionStore

SELECTS = ("ALL_ATTRIBUTES", "ALL_PROJECTED_ATTRIBUTES", "SPECIFIC_ATTRIBUTES", "COUNT")
DEFAULT_LIMIT = 100
MOST_BATCH, MOST_TRANSACTION, MOST_KEYS = 25, 100, 100


class ConditionFailed(RuntimeError):
    """The condition of a change doesn't hold; nothing was changed."""


@dataclass
class QueryResult:
    """Items of a page; counts before and after the filter; where the next page starts."""

    items: list[Row]
    count: int
    scanned_count: int
    last_key: tuple | None


class DocumentTable:
    """A table with a partition key and an optional sort key over a DataFrame of typed attributes."""

    def __init__(self, rows: DataFrame, partition: str, sort: str | None = None):
        self.rows, self.partition, self.sort = rows, partition, sort
        self.keys = [partition, sort] if sort else [partition]

    def fields(self) -> DataFrame:
        """The attributes with their types, for expressions."""
        return self.rows

    def _is(self, key: dict[str, Any]) -> Column:
        if set(key) != set(self.keys):
            raise ValueError(f"a key has {self.keys}")
        found = F.lit(True)
        for name, value in key.items():
            found = found & (F.col(name) == F.lit(value))
        return found

    def get(self, **key) -> Row | None:
        return self.rows.where(self._is(key)).first()

    def batch_get(self, keys: list[dict[str, Any]]) -> DataFrame:
        """Items of at most ``MOST_KEYS`` keys; missing ones are left out."""
        if len(keys) > MOST_KEYS:
            raise ValueError(f"at most {MOST_KEYS} keys")
        kinds = dict(self.rows.dtypes)
        probes = self.rows.sparkSession.createDataFrame([tuple(k[c] for c in self.keys) for k in keys], ", ".join(f"`{c}` {kinds[c]}" for c in self.keys))
        return self.rows.join(F.broadcast(probes.distinct()), self.keys, "left_semi")

    def _check(self, key: dict[str, Any], condition: str | None, names, values) -> None:
        """An absent item is judged as one whose attributes are all missing."""
        if condition is None:
            return
        judged = conditions.condition(condition, self.fields(), names, values).alias("ok")
        found = self.rows.where(self._is(key)).select(judged).first()
        if found is None:
            absent = self.rows.sparkSession.createDataFrame([tuple([None] * len(self.rows.columns))], _nullable(self.rows))
            found = absent.select(judged).first()
        if not found["ok"]:
            raise ConditionFailed(condition)

    def _without(self, key: dict[str, Any]) -> DataFrame:
        return self.rows.where(~F.coalesce(self._is(key), F.lit(False)))

    def put(self, item: dict[str, Any], condition: str | None = None, names=None, values=None) -> DocumentTable:
        """The table with the item in place of any with its key."""
        key = {c: item[c] for c in self.keys}
        self._check(key, condition, names, values)
        new = self.rows.sparkSession.createDataFrame([tuple(item.get(c) for c in self.rows.columns)], self.rows.schema)
        return DocumentTable(self._without(key).unionByName(new), self.partition, self.sort)

    def delete(self, key: dict[str, Any], condition: str | None = None, names=None, values=None) -> DocumentTable:
        self._check(key, condition, names, values)
        return DocumentTable(self._without(key), self.partition, self.sort)

    def update(self, key: dict[str, Any], expression: str, condition: str | None = None, names=None, values=None, condition_values=None) -> DocumentTable:
        """The table with one item updated; operands read the item as it was, and an absent item starts empty."""
        self._check(key, condition, names, condition_values)
        changed = conditions.update(expression, self.fields(), set(self.keys), names, values)
        hit = self._is(key)
        kinds = dict(self.rows.dtypes)
        out = [F.when(hit, changed[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in self.rows.columns]
        rows = self.rows
        if not rows.where(hit).limit(1).count():
            start = rows.sparkSession.createDataFrame([tuple(key.get(c) for c in rows.columns)], _nullable(rows))
            rows = rows.unionByName(start)
        return DocumentTable(rows.select(*out), self.partition, self.sort)

    def batch_write(self, puts: list[dict[str, Any]], deletes: list[dict[str, Any]]) -> DocumentTable:
        """At most ``MOST_BATCH`` puts and deletes of different keys."""
        keys = [tuple(x[c] for c in self.keys) for x in [*puts, *deletes]]
        if len(keys) > MOST_BATCH or len(keys) != len(set(keys)):
            raise ValueError(f"at most {MOST_BATCH} changes, each of its own key")
        kinds = dict(self.rows.dtypes)
        touched = self.rows.sparkSession.createDataFrame(keys, ", ".join(f"`{c}` {kinds[c]}" for c in self.keys))
        new = self.rows.sparkSession.createDataFrame([tuple(p.get(c) for c in self.rows.columns) for p in puts], self.rows.schema)
        kept = self.rows.join(F.broadcast(touched), self.keys, "left_anti").select(self.rows.columns)
        return DocumentTable(kept.unionByName(new), self.partition, self.sort)

    def transact(self, actions: list[tuple[str, dict[str, Any], dict[str, Any]]]) -> DocumentTable:
        """All of ('put' | 'delete' | 'update' | 'check', item or key, arguments), or none: every condition is judged first, on the table as it is."""
        if len(actions) > MOST_TRANSACTION:
            raise ValueError(f"at most {MOST_TRANSACTION} actions")
        keys = [tuple(item[c] for c in self.keys) for _, item, _ in actions]
        if len(keys) != len(set(keys)):
            raise ValueError("two actions on one item")
        for (_, item, arguments), key in zip(actions, keys, strict=True):
            bound = arguments.get("condition_values", arguments.get("values"))
            self._check(dict(zip(self.keys, key, strict=True)), arguments.get("condition"), arguments.get("names"), bound)
        table = self
        for kind, item, arguments in actions:
            if kind == "put":
                table = table.put(item)
            elif kind == "delete":
                table = table.delete(item)
            elif kind == "update":
                table = table.update(item, arguments["expression"], names=arguments.get("names"), values=arguments.get("values"))
        return table

    def query(self, key_condition: str, values: dict[str, Any], filter_expression: str | None = None, filter_values=None, limit: int = DEFAULT_LIMIT, after=None, forward: bool = True, project: str | None = None, names=None, select: str | None = None) -> QueryResult:
        """A page of one partition in sort order. The limit counts items before the filter; projection comes last."""
        found = self.rows.where(conditions.key_condition(key_condition, self.partition, self.sort, self.fields(), values))
        order = self.sort or self.partition
        if after is not None:
            found = found.where(F.col(order) > F.lit(after) if forward else F.col(order) < F.lit(after))
        return self._page(found.orderBy(F.col(order).asc() if forward else F.col(order).desc()), filter_expression, filter_values, limit, project, names, select)

    def scan(self, filter_expression: str | None = None, filter_values=None, limit: int = DEFAULT_LIMIT, after: tuple | None = None, project: str | None = None, names=None, select: str | None = None) -> QueryResult:
        """A page of the whole table in key order, with the same rule for the limit."""
        found = self.rows
        if after is not None:
            found = found.where(F.struct(*self.keys) > F.struct(*[F.lit(x).cast(dict(self.rows.dtypes)[c]).alias(c) for x, c in zip(after, self.keys, strict=True)]))
        return self._page(found.orderBy(*self.keys), filter_expression, filter_values, limit, project, names, select)

    def _page(self, ordered: DataFrame, filter_expression, filter_values, limit: int, project, names, select=None) -> QueryResult:
        mode = select_mode(select, project is not None)
        keep = conditions.condition(filter_expression, self.fields(), None, filter_values) if filter_expression else F.lit(True)
        page = ordered.limit(limit).withColumn("_keep", keep)
        shown = conditions.projection(project, self.fields(), names) if project else [F.col(c) for c in self.rows.columns]
        item = F.struct(*self.keys) if mode == "COUNT" else F.struct(*shown)
        got = page.select(item.alias("item"), F.struct(*self.keys).alias("key"), "_keep").collect()
        kept = [r["item"] for r in got if r["_keep"]]
        return QueryResult([] if mode == "COUNT" else kept, len(kept), len(got), tuple(got[-1]["key"]) if got and len(got) == limit else None)

    def by_index(self, partition: str, sort: str | None = None) -> DocumentTable:
        """The items of an index: those that have its key attributes, in its order, then by the table's own key."""
        own = [partition] + ([sort] if sort else [])
        found = self.rows.dropna(subset=own)
        return DocumentTable(found, partition, sort)


def select_mode(select: str | None, has_projection: bool, on_index: bool = False) -> str:
    """What a read returns; a projection goes with SPECIFIC_ATTRIBUTES only, which needs one."""
    if select is None:
        return "SPECIFIC_ATTRIBUTES" if has_projection else "ALL_PROJECTED_ATTRIBUTES" if on_index else "ALL_ATTRIBUTES"
    if select not in SELECTS or select == "ALL_PROJECTED_ATTRIBUTES" and not on_index:
        raise ValueError(f"unknown select {select}")
    if has_projection != (select == "SPECIFIC_ATTRIBUTES"):
        raise ValueError(f"{select} {'goes without' if has_projection else 'needs'} a projection")
    return select


def _nullable(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)


KEY = "_key"


class DocumentDatabase:
    """Document tables by name whose versions move together.

        tables/<name>.json  definition of a table
        data/<id>/          versions of its items, keyed by the bytes of partition and sort key
        heads.json          version of every table
        commits/<n>.json    every move of the heads, numbered without gaps
        tokens/, leases/    results of idempotent transactions; who works on what
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # tables

    def create_table(self, name: str, columns: str, partition: str, sort: str | None = None, indexes: dict[str, tuple] | None = None, ttl: str | None = None) -> dict:
        """A table of columns like ``owner STRING, n BIGINT``; ``indexes`` has (partition, sort) by name, ``ttl`` a column of expiry seconds."""
        schema = _parse_datatype_string(columns)
        for column in filter(None, [partition, sort, ttl, *(c for i in (indexes or {}).values() for c in i)]):
            if column not in schema.names:
                raise ValueError(f"no column {column}")
        table = {"id": uuid.uuid4().hex, "schema": schema.json(), "partition": partition, "sort": sort, "indexes": {n: list(i) for n, i in (indexes or {}).items()}, "ttl": ttl}
        if not self.files.create(f"tables/{name}.json", json.dumps(table)):
            raise ValueError(f"table {name} is there")
        self._publish({name: self._store(name).write(self._keyed(name, self.spark.createDataFrame([], schema))).id}, {})
        return table

    def describe_table(self, name: str) -> dict:
        found = self.files.read(f"tables/{name}.json")
        if found is None:
            raise KeyError(f"no table {name}")
        return json.loads(found)

    def list_tables(self, after: str | None = None, limit: int = 100) -> Page:
        names = [n.removesuffix(".json") for n in self.files.names("tables", ".json")]
        found = [n for n in names if after is None or n > after]
        return Page(found[:limit], found[limit - 1] if limit and len(found) > limit else None)

    def delete_table(self, name: str) -> None:
        """Drop the definition and the items of a table."""
        store = self.describe_table(name)["id"]
        with self.files.locked("heads.lock"):
            self.files.replace("heads.json", json.dumps({n: v for n, v in self.heads().items() if n != name}))
            self.files.delete(f"tables/{name}.json")
        self.files.delete(f"data/{store}")

    def _store(self, name: str) -> VersionStore:
        return VersionStore(self.spark, self.files.path(f"data/{self.describe_table(name)['id']}"), KEY)

    def _key_of(self, name: str, kinds: dict[str, str]) -> Column:
        table = self.describe_table(name)
        parts = [c for c in (table["partition"], table["sort"]) if c]
        return segments(*[i64_key(F.col(c)) if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.col(c) for c in parts])

    def _keyed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn(KEY, self._key_of(name, dict(rows.dtypes)))

    def heads(self) -> dict[str, str]:
        return json.loads(self.files.read("heads.json") or "{}")

    def table(self, name: str, version: str | None = None) -> DocumentTable:
        """The items of a table at its head or at a version."""
        found = self.describe_table(name)
        return DocumentTable(self._store(name).snapshot(version or self.heads()[name]).drop(KEY), found["partition"], found["sort"])

    def index(self, name: str, index: str, version: str | None = None) -> DocumentTable:
        """The items of a secondary index, which items without its keys are not in."""
        return self.table(name, version).by_index(*self.describe_table(name)["indexes"][index])

    # changes

    def _publish(self, written: dict[str, str], expected: dict[str, str], token: str | None = None) -> dict[str, str]:
        with self.files.locked("heads.lock"):
            heads = self.heads()
            for name, version in expected.items():
                if heads.get(name) != version:
                    raise StaleRef(f"{name} is at {heads.get(name)}, not {version}")
            moved = heads | written
            self.files.replace("heads.json", json.dumps(moved))
            known = self.files.names("commits", ".json")
            sequence = int(known[-1].removesuffix(".json")) + 1 if known else 1
            tables = {n: self.describe_table(n)["id"] for n in written}
            self.files.create(f"commits/{sequence:012d}.json", json.dumps({"sequence": sequence, "versions": written, "before": {n: heads.get(n) for n in written}, "tables": tables, "at": time.time()}))
            if token:
                self.files.create(f"tokens/{token}.json", json.dumps(moved))
        return moved

    def _write(self, name: str, puts: list[dict[str, Any]], deletes: list[dict[str, Any]], at: str) -> str:
        """A version with some items put and deleted; only key ranges that they fall into are rewritten."""
        schema, store = StructType.fromJson(json.loads(self.describe_table(name)["schema"])), self._store(name)
        rows = [(*(p.get(c) for c in schema.names), "upsert") for p in puts] + [(*(d.get(c) for c in schema.names), "delete") for d in deletes]
        loose = StructType([*[type(f)(f.name, f.dataType, True) for f in schema.fields], *_parse_datatype_string("op STRING").fields])
        store.files.replace("refs/work.json", json.dumps({"version": at}))
        return store.apply(self._keyed(name, self.spark.createDataFrame(rows, loose)), "work", at)[1].id

    def put_item(self, name: str, item: dict[str, Any], condition: str | None = None, names=None, values=None, expected: str | None = None) -> str:
        """Put an item if a condition holds, and the table is at a version if one is given; the new version."""
        return self.transact_write([(name, "put", item, {"condition": condition, "names": names, "values": values})], expected={name: expected} if expected else None)[name]

    def delete_item(self, name: str, key: dict[str, Any], condition: str | None = None, names=None, values=None, expected: str | None = None) -> str:
        return self.transact_write([(name, "delete", key, {"condition": condition, "names": names, "values": values})], expected={name: expected} if expected else None)[name]

    def update_item(self, name: str, key: dict[str, Any], expression: str, condition: str | None = None, names=None, values=None, condition_values=None, expected: str | None = None) -> str:
        arguments = {"expression": expression, "condition": condition, "names": names, "values": values, "condition_values": condition_values or {}}
        return self.transact_write([(name, "update", key, arguments)], expected={name: expected} if expected else None)[name]

    def get_item(self, name: str, key: dict[str, Any], version: str | None = None) -> Row | None:
        return self.table(name, version).get(**key)

    def batch_write(self, requests: dict[str, tuple[list, list]]) -> dict[str, str]:
        """Puts and deletes by table, ``MOST_BATCH`` at most in all. Each table's are one change; the tables aren't."""
        if sum(len(p) + len(d) for p, d in requests.values()) > MOST_BATCH:
            raise ValueError(f"at most {MOST_BATCH} changes")
        done = {}
        for name, (puts, deletes) in requests.items():
            at, table = self.heads()[name], self.describe_table(name)
            keys = [tuple(x.get(c) for c in (table["partition"], table["sort"]) if c) for x in [*puts, *deletes]]
            if len(keys) != len(set(keys)):
                raise ValueError(f"two changes of one item of {name}; written so far: {done}")
            done[name] = self._write(name, puts, deletes, at)
            self._publish({name: done[name]}, {name: at})
        return done

    def transact_write(self, actions: list[tuple[str, str, dict[str, Any], dict[str, Any]]], token: str | None = None, expected: dict[str, str] | None = None) -> dict[str, str]:
        """All of (table, 'put' | 'delete' | 'update' | 'check', item or key, arguments), or none; a token makes it idempotent.

        Every condition is judged, and every update reads, the tables as they were.
        """
        if token and (known := self.files.read(f"tokens/{token}.json")):
            return json.loads(known)
        if len(actions) > MOST_TRANSACTION:
            raise ValueError(f"at most {MOST_TRANSACTION} actions")
        heads, seen = self.heads(), set()
        for name, version in (expected or {}).items():
            if heads[name] != version:
                raise StaleRef(f"{name} is at {heads[name]}, not {version}")
        changes: dict[str, tuple[list, list]] = {}
        for name, kind, item, arguments in actions:
            table = self.table(name, heads[name])
            key = {c: item[c] for c in table.keys}
            if (name, *key.values()) in seen:
                raise ValueError(f"two actions on one item of {name}")
            seen.add((name, *key.values()))
            bound = arguments.get("condition_values") if kind == "update" else arguments.get("values")
            table._check(key, arguments.get("condition"), arguments.get("names") if arguments.get("condition") and kind != "update" else None, bound)
            puts, deletes = changes.setdefault(name, ([], []))
            if kind == "put":
                puts.append(item)
            elif kind == "delete":
                deletes.append(key)
            elif kind == "update":
                one = DocumentTable(table.rows.where(table._is(key)), table.partition, table.sort)
                puts.append(one.update(key, arguments["expression"], names=arguments.get("names"), values=arguments.get("values")).get(**key).asDict(recursive=False))
            elif kind != "check":
                raise ValueError(f"unknown action {kind}")
        written = {n: self._write(n, puts, deletes, heads[n]) for n, (puts, deletes) in changes.items() if puts or deletes}
        return self._publish(written, {n: heads[n] for n in changes}, token)

    def transact_get(self, wanted: list[tuple[str, dict[str, Any]]]) -> list[Row | None]:
        """Items of several tables as of one moment, in the order asked for."""
        heads = self.heads()
        return [self.table(name, heads[name]).get(**key) for name, key in wanted]

    def batch_get(self, wanted: dict[str, list[dict[str, Any]]]) -> dict[str, DataFrame]:
        """Items by table, ``MOST_KEYS`` keys at most in all."""
        if sum(map(len, wanted.values())) > MOST_KEYS:
            raise ValueError(f"at most {MOST_KEYS} keys")
        return {name: self.table(name).batch_get(keys) for name, keys in wanted.items()}

    # expiry, archives, history

    def expired(self, name: str, now: int) -> DataFrame:
        return ttl_candidates(self.table(name).rows, self.describe_table(name)["ttl"], now)

    def expire(self, name: str, now: int, candidates: list[dict[str, Any]] | None = None) -> int:
        """Delete expired items, or those candidates whose expiry is still what was seen; the number deleted."""
        table, found = self.describe_table(name), self.expired(name, now)
        keys = [c for c in (table["partition"], table["sort"]) if c]
        if candidates is not None:
            kinds = dict(found.dtypes)
            seen = self.spark.createDataFrame([tuple(c[k] for k in [*keys, table["ttl"]]) for c in candidates], ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, table["ttl"]]))
            found = found.join(F.broadcast(seen), [*keys, table["ttl"]], "left_semi")
        at, store = self.heads()[name], self._store(name)
        store.files.replace("refs/work.json", json.dumps({"version": at}))
        columns = StructType.fromJson(json.loads(table["schema"])).names
        _, version, _ = store.apply(self._keyed(name, found.select(*columns)).withColumn("op", F.lit("delete")), "work", at)
        self._publish({name: version.id}, {name: at})
        return store.version(at).n_rows - version.n_rows

    def export_table(self, name: str, target: str, version: str | None = None) -> None:
        """Definition and items of a table as an archive with digests."""
        self._store(name).export_snapshot(version or self.heads()[name], f"{target}/items")
        Files(self.spark, target).replace("table.json", json.dumps(self.describe_table(name)))

    def plan_import(self, name: str, archive: str) -> dict:
        """What an import would do: rows and whether the name is free."""
        manifest = json.loads(Files(self.spark, archive).read("items/manifest.json"))
        return {"rows": manifest["n_rows"], "free": not self.files.exists(f"tables/{name}.json")}

    def import_table(self, name: str, archive: str) -> dict:
        """A new table from an archive, under an id of its own."""
        table = json.loads(Files(self.spark, archive).read("table.json")) | {"id": uuid.uuid4().hex}
        if not self.files.create(f"tables/{name}.json", json.dumps(table)):
            raise ValueError(f"table {name} is there")
        self._publish({name: self._store(name).import_snapshot(f"{archive}/items").id}, {})
        return table

    def bulk_load(self, name: str, rows: DataFrame) -> str:
        """Replace all items of a table by rows of a DataFrame, written in key ranges."""
        at, columns = self.heads()[name], StructType.fromJson(json.loads(self.describe_table(name)["schema"])).names
        version = self._store(name).write(self._keyed(name, rows.select(*columns)), (at,))
        self._publish({name: version.id}, {name: at})
        return version.id

    def commits(self, after: int = 0, limit: int = 100, name: str | None = None) -> Page:
        """Commits behind a sequence number, of one incarnation of a table if one is named; the cursor resumes there."""
        found = [json.loads(self.files.read(f"commits/{n}")) for n in self.files.names("commits", ".json") if int(n.removesuffix(".json")) > after]
        if name is not None:
            own = self.describe_table(name)["id"]
            found = [c for c in found if c["tables"].get(name) == own]
        return Page(found[:limit], found[min(limit, len(found)) - 1]["sequence"] if found and limit else after)

    def restore(self, name: str, version: str) -> None:
        """Move a table's head to one of its versions."""
        self._publish({name: self._store(name).version(version).id}, {name: self.heads()[name]})

    def plan_retention(self, name: str, keep_last: int) -> list[str]:
        """Versions that retention would drop: all but the last ones of the feed and the head."""
        heads, feed = self.heads(), self.commits(limit=10**9, name=name).rows
        held = {c["versions"][name] for c in feed[-keep_last:]} | {heads[name]}
        return [v.id for v in self._store(name).versions() if v.id not in held]

    def apply_retention(self, name: str, keep_last: int) -> int:
        """Drop those versions and the data that only they named; the number dropped."""
        store, plan = self._store(name), self.plan_retention(name, keep_last)
        store.files.delete("refs/work.json")
        for version in plan:
            store.files.delete(f"versions/{version}.json")
        store.sweep()
        return len(plan)

    # workers

    def acquire_lease(self, name: str, owner: str, seconds: float) -> dict:
        """Hold a named piece of work for some time; each new holder gets a greater fencing token."""
        with self.files.locked(f"leases/{name}.lock"):
            held = json.loads(self.files.read(f"leases/{name}.json") or '{"owner": null, "until": 0, "token": 0, "checkpoint": 0}')
            if held["owner"] not in (None, owner) and held["until"] > time.time():
                raise StaleRef(f"{name} is held by {held['owner']}")
            token = held["token"] + (held["owner"] != owner)
            lease = held | {"owner": owner, "until": time.time() + seconds, "token": token}
            self.files.replace(f"leases/{name}.json", json.dumps(lease))
            return lease

    def release_lease(self, lease_name: str, token: int) -> None:
        self.update_lease(lease_name, token, owner=None, until=0)

    def update_lease(self, name: str, token: int, **changes) -> dict:
        """Renew a lease or move its checkpoint; an old token is refused."""
        with self.files.locked(f"leases/{name}.lock"):
            held = json.loads(self.files.read(f"leases/{name}.json"))
            if held["token"] != token:
                raise StaleRef(f"{name} has passed on to {held['owner']}")
            self.files.replace(f"leases/{name}.json", json.dumps(held | changes))
            return held | changes

    def run_worker(self, name: str, owner: str, handle: Callable[[dict], None], limit: int = 100, seconds: float = 60.0) -> int:
        """Hand the commits behind a worker's checkpoint to a function, one after another; the number handled."""
        lease = self.acquire_lease(name, owner, seconds)
        page = self.commits(lease["checkpoint"], limit)
        for commit in page.rows:
            handle(commit)
            self.update_lease(name, lease["token"], checkpoint=commit["sequence"], until=time.time() + seconds)
        return len(page.rows)
