"""A versioned map of vectors with accelerators, a planner that runs what it chooses, and replayable results.

    records/            versions of (key, vec, value)
    accelerators.json   for a version: what was built, where, and its settings
    built/<id>/         codes or graphs of an accelerator
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.keys import prefix_end
from loomstone.operators import proximity
from loomstone.operators.scan import in_range
from loomstone.sources.files import Files
from loomstone.sources.store import StaleRef, Version, VersionStore

KINDS = ("graph", "sq8")


@dataclass(frozen=True)
class SearchRequest:
    """What to look for: the query, how many, among which keys, and whether only the exact answer will do."""

    query: tuple[float, ...]
    k: int
    exact: bool = False
    start: Any = None
    end: Any = None
    prefix: str | None = None
    keys: tuple | None = None
    bound: bool = False
    backend: str | None = None
    ef: int = 64


@dataclass
class SearchResult:
    """Hits (key, distance), how they were found, and whether the search came to its end."""

    hits: list[tuple[Any, float]]
    backend: str
    complete: bool
    version: str
    trace: dict = field(default_factory=dict)


class VectorMap:
    """Vectors of one length under keys, with a value each."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int, metric: str = "l2", key_type: str = "bigint"):
        self.spark, self.files, self.dimensions, self.metric = spark, Files(spark, root), dimensions, metric
        self.store = VersionStore(spark, self.files.path("records"), "key")
        self.schema = f"key {key_type}, vec array<float>, value string"
        if metric not in proximity.METRICS:
            raise ValueError(f"unknown metric {metric}")

    def _prepared(self, rows: DataFrame) -> DataFrame:
        """Vectors of the right length and finite; for cosine of unit length, a zero vector being an error."""
        ok = proximity.checked(rows, "vec", self.dimensions)
        if self.metric != "cosine":
            return ok
        some = F.exists("vec", lambda x: x != 0)
        return ok.withColumn("vec", F.when(some, proximity.normalized(F.col("vec"))).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<float>")))

    # records

    def build(self, rows: DataFrame, ref: str = "main") -> Version:
        """The first state, or a clean rebuild."""
        return self.store.commit(self._prepared(rows.select("key", "vec", "value")), ref)[1]

    def build_if_absent(self, rows: DataFrame, ref: str = "main") -> Version:
        at = self.store.head(ref)
        return self.store.version(at) if at else self.build(rows, ref)

    def mutate(self, changes: DataFrame, ref: str = "main", tries: int = 8) -> Version:
        """Upserts and deletes (``op``); on a head that moved meanwhile they are made again."""
        upserts = self._prepared(changes.where("op = 'upsert'").select("key", "vec", "value", "op"))
        every = upserts.unionByName(changes.where("op = 'delete'").select("key", "vec", "value", "op"))
        for attempt in range(tries):
            try:
                return self.store.apply(every, ref, self.store.head(ref))[1]
            except StaleRef:
                if attempt + 1 == tries:
                    raise
        raise StaleRef(ref)

    def records(self, ref: str = "main", version: str | None = None) -> DataFrame:
        return self.store.snapshot(version or self.store.head(ref))

    def get(self, key, ref: str = "main"):
        return self.records(ref).where(F.col("key") == F.lit(key)).first()

    def contains(self, key, ref: str = "main") -> bool:
        return self.get(key, ref) is not None

    def scan(self, start=None, end=None, ref: str = "main") -> DataFrame:
        return self.records(ref).where(in_range("key", start, end)).orderBy("key")

    def verify(self, ref: str = "main") -> dict[str, int]:
        """Records, those with a vector that isn't right, and accelerators whose rows aren't the version's."""
        rows, version = self.records(ref), self.store.head(ref)
        bad = rows.where((F.size("vec") != self.dimensions) | F.exists("vec", lambda x: x.isNull() | F.isnan(x))).count()
        stale = sum(self.spark.read.parquet(a["path"]).select("key").exceptAll(rows.select("key")).limit(1).count() for a in self.accelerators(version).values())
        return {"records": rows.count(), "bad_vectors": bad, "stale_accelerators": stale}

    # accelerators

    def accelerators(self, version: str) -> dict[str, dict]:
        return json.loads(self.files.read("accelerators.json") or "{}").get(version, {})

    def accelerate(self, kind: str, ref: str = "main", **settings) -> dict:
        """Build an accelerator of the head's version and list it."""
        version, path = self.store.head(ref), self.files.path(f"built/{uuid.uuid4().hex}")
        rows = self.records(version=version)
        if kind not in KINDS or self.metric == "inner_product":
            raise ValueError(f"no accelerator {kind} for {self.metric}")
        built = proximity.build_graph(rows, "key", "vec", **settings) if kind == "graph" else proximity.encode_sq8(rows, "key", "vec")
        built.write.parquet(path)
        with self.files.locked("accelerators.lock"):
            known = json.loads(self.files.read("accelerators.json") or "{}")
            known.setdefault(version, {})[kind] = {"path": path, "settings": settings}
            self.files.replace("accelerators.json", json.dumps(known))
        return known[version][kind]

    # search

    def plan(self, request: SearchRequest, ref: str = "main") -> str:
        """The backend that a search would use."""
        version = self.store.head(ref)
        filtered = request.start is not None or request.end is not None or request.prefix is not None
        if request.backend:
            if request.backend not in ("native", "eligible_exact", *self.accelerators(version)):
                raise ValueError(f"no backend {request.backend}")
            return request.backend
        listed = len(request.keys) if request.keys is not None else None
        usable = () if filtered or listed is not None else tuple(k for k in KINDS if k in self.accelerators(version))
        return proximity.choose_backend(self.store.version(version).n_rows, listed, request.k, usable, request.exact)

    def _eligible(self, rows: DataFrame, request: SearchRequest) -> DataFrame:
        rows = rows.where(in_range("key", request.start, request.end))
        if request.prefix is not None:
            end = prefix_end(request.prefix.encode())
            rows = rows.where(in_range("key", request.prefix, end.decode(errors="ignore") if end else None) & F.startswith("key", F.lit(request.prefix)))
        if request.keys is not None:
            listed = self.spark.createDataFrame([(k,) for k in set(request.keys)], f"key {dict(rows.dtypes)['key']}")
            if request.bound and listed.join(rows, "key", "left_anti").limit(1).count():
                raise ValueError("an eligible key isn't in the snapshot")
            rows = rows.join(F.broadcast(listed), "key", "left_semi")
        return rows

    def search(self, request: SearchRequest, ref: str = "main", seconds: float | None = None) -> SearchResult:
        """Plan and run a search. With a deadline it is cancelled when that passes, and the result isn't complete."""
        version, backend, began = self.store.head(ref), self.plan(request, ref), time.monotonic()
        rows, query = self.records(version=version), list(request.query)
        if self.metric == "cosine" and backend != "native":
            length = sum(x * x for x in query) ** 0.5
            query = [x / length for x in query]
        if backend == "graph":
            found = proximity.nearest_in_graph(self.spark.read.parquet(self.accelerators(version)["graph"]["path"]), query, request.k, request.ef)
        elif backend == "sq8":
            found = proximity.nearest_sq8(self.spark.read.parquet(self.accelerators(version)["sq8"]["path"]), rows, "key", "vec", query, request.k)
        else:
            found = proximity.nearest(self._eligible(rows, request), "key", "vec", query, request.k, self.metric)
        halve = 2.0 if self.metric == "cosine" and backend in KINDS else 1.0  # |a - b|^2 = 2 (1 - cos) of unit vectors
        hits = self._within(seconds, lambda: [(r["key"], r["distance"] / halve) for r in found.collect()])
        trace = {"seconds": time.monotonic() - began, "accelerators": sorted(self.accelerators(version))}
        return SearchResult(hits or [], backend, hits is not None, version, trace)

    def _within(self, seconds: float | None, run: Callable[[], list]) -> list | None:
        """What a job gives, or None if it was cancelled at its deadline."""
        if seconds is None:
            return run()
        tag, late = f"search-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag) if hasattr(self.spark, "interruptTag") else self.spark.sparkContext.cancelJobsWithTag(tag)

        self.spark.addTag(tag) if hasattr(self.spark, "addTag") else self.spark.sparkContext.addJobTag(tag)
        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            got = run()
            return None if late.is_set() else got
        except Exception:
            if late.is_set():
                return None
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag) if hasattr(self.spark, "removeTag") else self.spark.sparkContext.removeJobTag(tag)

    def search_composite(self, base: str, request: SearchRequest, ref: str = "main") -> list[tuple[Any, float]]:
        """Over an accelerated older version and the changes since: rows that changed are hidden in the base and searched exactly."""
        head = self.store.head(ref)
        old, new = self.store.differing(base, head)
        same = old.join(new, ["key"], "inner").where(old["vec"] == new["vec"]).select("key")
        gone = old.select("key").join(same, "key", "left_anti")
        delta = new.join(same, "key", "left_anti")
        rows = self.records(version=base)
        found = proximity.nearest_composite(rows, delta, gone, "key", "vec", list(request.query), request.k, self.metric)
        return [(r["key"], r["distance"]) for r in found.collect()]

    # proofs and context

    def prove(self, request: SearchRequest, ref: str = "main") -> dict:
        """A search with everything needed to run it again: request, version with its digest, backend and hits."""
        result = self.search(request, ref)
        body = {"request": asdict(request), "version": result.version, "digest": self.store.version(result.version).digest, "backend": result.backend, "hits": result.hits}
        return body | {"seal": _seal(body)}

    def verify_proof(self, proof: dict) -> bool:
        """Whether a proof is whole, and running its search again on its version gives its hits."""
        body = {k: v for k, v in proof.items() if k != "seal"}
        if _seal(body) != proof["seal"] or not self.store.has(proof["version"]) or self.store.version(proof["version"]).digest != proof["digest"]:
            return False
        known = SearchRequest(**{**proof["request"], "query": tuple(proof["request"]["query"]), "keys": tuple(proof["request"]["keys"]) if proof["request"]["keys"] is not None else None, "backend": proof["backend"]})
        ref = f"checkpoints/proof-{uuid.uuid4().hex}"
        self.store.compare_and_swap(ref, None, proof["version"])
        try:
            return [list(h) for h in self.search(known, ref).hits] == [list(h) for h in proof["hits"]]
        finally:
            self.store.compare_and_swap(ref, proof["version"], None)

    def context(self, result: SearchResult, separator: str = "\n\n") -> str:
        """The values of the hits, nearest first, as one text."""
        values = dict(zip([k for k, _ in result.hits], self.store.get_many_at(result.version, [k for k, _ in result.hits]), strict=True))
        return separator.join(values[k]["value"] for k, _ in result.hits if values[k] is not None)


def _seal(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
