"""Queries through the store, sessions, databases, indexes, repositories and proofs, with their SQL.

Each writes what it needs to a fresh place in the shared folder and reads its
result back through the surface that it shows.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loomstone import inspect as inspection
from loomstone.functions import cbor, conditions, decimals, keys, values
from loomstone.operators import content, diff, index, integrity, merge, mutate, proofs, proximity, scan, views
from loomstone.plans.catalog import DIFF, L2, QUERY, VERSIONS, _events, _merge_sql, _orders, _query_vector, _three, query
from loomstone.plans.fixtures import base_version, left_version, right_version, table
from loomstone.sources import connectors
from loomstone.sources.documents import DocumentDatabase, DocumentTable
from loomstone.sources.indexed import Definition, IndexedStore
from loomstone.sources.repository import ObjectRepository
from loomstone.sources.session import Catalog, ReadSession, TypedMap, WriteSession
from loomstone.sources.sql import SqlDatabase
from loomstone.sources.store import VersionStore
from loomstone.sources.vectors import SearchRequest, VectorMap
from loomstone.staging import fresh_path, staged
from loomstone.streaming import feed

KV = "k BIGINT, v STRING"
COLUMNS = "o_orderkey, o_custkey, o_orderstatus"


def _store(spark, name: str = "store", key: str = "k") -> VersionStore:
    return VersionStore(spark, fresh_path(spark, name), key)


def _grown(spark, sf_dir) -> tuple[VersionStore, str, str]:
    """A store whose main branch went from the base to the left version."""
    store = _store(spark)
    first = store.commit(base_version(spark, sf_dir))[1].id
    return store, first, store.commit(left_version(spark, sf_dir))[1].id


def _changes(spark, sf_dir):
    """Base to left as upserts and deletes."""
    found = diff.diff_versions(base_version(spark, sf_dir), left_version(spark, sf_dir), ["k"], "v")
    return found.select("k", F.col("new").alias("v"), F.when(F.col("kind") == "removed", "delete").otherwise("upsert").alias("op"))


def _rows(spark, found, schema: str):
    return spark.createDataFrame([tuple(r) for r in found], schema)


# versions


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def store_head(spark, sf_dir):
    store, _, _ = _grown(spark, sf_dir)
    return store.snapshot(store.head())


@query(f"WITH {VERSIONS} SELECT k, v FROM base")
def store_rollback(spark, sf_dir):
    store, first, _ = _grown(spark, sf_dir)
    store.rollback(first)
    return store.snapshot(store.head())


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def store_apply(spark, sf_dir):
    """The left version by changes of the base: only key ranges that they touch are rewritten."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    return store.snapshot(store.apply(_changes(spark, sf_dir))[1].id)


@query("SELECT 0 AS segments_read_for_equal, (SELECT count(*) FROM orders)::BIGINT AS n_rows")
def store_shares_segments(spark, sf_dir):
    """A change of one key leaves all other segments as they are; a difference reads only that one."""
    store = _store(spark)
    first = store.write(base_version(spark, sf_dir), partitions=8)
    store.compare_and_swap("main", None, first.id)
    low = base_version(spark, sf_dir).agg(F.min("k")).first()[0]
    _, second, stats = store.apply(spark.createDataFrame([(low, "changed", "upsert")], f"{KV}, op STRING"))
    shared = {s.path for s in first.segments} & set(second.paths)
    return spark.createDataFrame([(len(first.segments) - 1 - len(shared) + (stats.segments_written - 1), second.n_rows)], "segments_read_for_equal int, n_rows long")


@query(f"WITH {VERSIONS} {DIFF}")
def store_diff(spark, sf_dir):
    store, first, second = _grown(spark, sf_dir)
    return store.diff(first, second, "v")


@query(f"WITH {VERSIONS} {DIFF} ORDER BY 1 LIMIT 80")
def store_diff_pages(spark, sf_dir):
    """Two pages, the second from the cursor of the first."""
    store, first, second = _grown(spark, sf_dir)
    one = store.diff_page(first, second, "v", 40)
    return _rows(spark, one.rows + store.diff_page(first, second, "v", 40, one.cursor).rows, "k long, kind string, old string, new string")


@query(f"WITH {VERSIONS} {DIFF} AND coalesce(base.k, l.k) < 500")
def diff_stream(spark, sf_dir):
    """Differences handed to a function in key order until one is past the end."""
    got = []
    diff.stream_diff(base_version(spark, sf_dir), left_version(spark, sf_dir), ["k"], "v", lambda r: True if r["k"] >= 500 else got.append(r))
    return _rows(spark, got, "k long, kind string, old string, new string")


@query(
    f"""WITH {VERSIONS}, d AS (SELECT base.k AS a, l.k AS b, base.v AS x, l.v AS y FROM base FULL OUTER JOIN l ON base.k = l.k)
        SELECT count_if(a IS NULL)::BIGINT AS n_added, count_if(b IS NULL)::BIGINT AS n_removed, count_if(a = b AND x IS DISTINCT FROM y)::BIGINT AS n_changed,
        count_if(a = b AND x IS NOT DISTINCT FROM y)::BIGINT AS n_same FROM d"""
)
def compare_versions(spark, sf_dir):
    return diff.compare(base_version(spark, sf_dir), left_version(spark, sf_dir), ["k"], "v")


@query(_merge_sql("lv"))
def store_merge(spark, sf_dir):
    """Two branches merged, the left side being preferred."""
    store, first, _ = _grown(spark, sf_dir)
    store.branch("side", first)
    store.commit(right_version(spark, sf_dir), "side")
    return store.snapshot(store.merge("main", store.head("side"), "v", merge.prefer_left)[1].id)


@query(f"WITH {VERSIONS} SELECT k, b AS base, lv AS \"left\", rv AS \"right\" FROM al WHERE lv IS DISTINCT FROM b AND rv IS DISTINCT FROM b AND lv IS DISTINCT FROM rv")
def store_merge_conflicts(spark, sf_dir):
    store, first, second = _grown(spark, sf_dir)
    store.branch("side", first)
    store.commit(right_version(spark, sf_dir), "side")
    outcome, found = store.merge("main", store.head("side"), "v")
    if outcome != "conflicts" or store.head() != second:
        raise RuntimeError("a conflict moved the branch")
    return found


@query(f"WITH {VERSIONS} {DIFF}")
def store_poll(spark, sf_dir):
    store, first, _ = _grown(spark, sf_dir)
    return store.poll(first, "v")[1]


@query("SELECT * FROM (VALUES (1, 'main', true), (2, 'main', false), (3, 'tags/one', true), (4, 'main', false)) t(sequence, ref, is_new)")
def store_moves(spark, sf_dir):
    """The log of moves, from a sequence number on."""
    store, first, _ = _grown(spark, sf_dir)
    store.tag("one", first)
    store.rollback(first)
    page = store.moves(limit=2)
    return spark.createDataFrame([(m["sequence"], m["ref"], m["old"] is None) for m in page.rows + store.moves(page.cursor).rows], "sequence int, ref string, is_new boolean")


@query("SELECT * FROM (VALUES ('checkpoints/c', 1), ('main', 1), ('tags/a', 2), ('tags/b', 2), ('tags/b', 3)) t(name, part)")
def store_refs(spark, sf_dir):
    """Names in pages, and the greatest name of a namespace."""
    store, first, _ = _grown(spark, sf_dir)
    for name in "ab":
        store.tag(name, first)
    store.checkpoint("c", first)
    one = store.refs_page(limit=2)
    listed = [(n, 1) for n, _ in one.rows] + [(n, 2) for n, _ in store.refs_page(after=one.cursor).rows] + [(n, 3) for n in store.newest_by_name("tags/", 1)]
    return spark.createDataFrame(listed, "name string, part int")


@query("SELECT 1 AS pruned, 0 AS pinned_pruned, true AS swept, (SELECT count(*) FROM orders)::BIGINT AS n_rows")
def store_retention(spark, sf_dir):
    """A pin holds its version, a sweep deletes what only dropped versions named."""
    store, first, second = _grown(spark, sf_dir)
    third = store.commit(base_version(spark, sf_dir).where("k % 2 = 0"))[1].id
    store.pin("hold", first)
    plan = store.plan_prune(keep_last=1)
    store.prune(keep_last=1)
    gone = store.sweep() > 0 and not store.reclaimable() and store.has(third)
    return spark.createDataFrame([(len(plan.versions), int(first in plan.versions), gone and not store.has(second), store.snapshot(first).count())], "pruned int, pinned_pruned int, swept boolean, n_rows long")


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def store_backup(spark, sf_dir):
    store, _, second = _grown(spark, sf_dir)
    target, copy = fresh_path(spark, "backup"), _store(spark, "restored")
    store.backup(target)
    copy.restore(target)
    return copy.snapshot(copy.head())


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def store_bundle(spark, sf_dir):
    """A version exported with its digests and imported into another store."""
    store, _, second = _grown(spark, sf_dir)
    target, copy = fresh_path(spark, "bundle"), _store(spark, "imported")
    store.export_snapshot(second, target)
    return copy.snapshot(copy.import_snapshot(target).id)


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def store_copy_missing(spark, sf_dir):
    """Only segments that the other store lacks are copied; a second copy moves nothing."""
    store, first, second = _grown(spark, sf_dir)
    other = _store(spark, "replica")
    store.copy_to(other, first)
    if not store.missing_from(other, second) or not store.copy_to(other, second) or store.copy_to(other, second):
        raise RuntimeError("the wrong segments were copied")
    return other.snapshot(second)


@query("SELECT i::BIGINT AS ordinal, o_orderstatus AS v FROM (SELECT i, CASE WHEN i % 3 = 0 THEN -1 ELSE i * 31 END AS k FROM range(60) t(i)) LEFT JOIN orders ON o_orderkey = k")
def store_get_many(spark, sf_dir):
    store = _store(spark)
    version = store.commit(base_version(spark, sf_dir))[1].id
    got = store.get_many_at(version, [-1 if i % 3 == 0 else i * 31 for i in range(60)])
    return spark.createDataFrame([(i, r and r["v"]) for i, r in enumerate(got)], "ordinal long, v string")


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders ORDER BY o_orderkey OFFSET 321 LIMIT 1")
def store_select(spark, sf_dir):
    """The row at a place, by the counts that the version keeps of its segments."""
    store = _store(spark)
    return _rows(spark, [store.select(store.commit(base_version(spark, sf_dir))[1].id, 321)], KV)


@query(f"WITH {VERSIONS}, d AS ({DIFF}) SELECT k, CASE kind WHEN 'removed' THEN 'delete' ELSE 'upsert' END AS op, new AS v FROM d")
def store_lineage(spark, sf_dir):
    """The changes that a version keeps of how it was made."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    return store.changes_of(store.apply(_changes(spark, sf_dir), keep_changes=True)[1].id)


@query(
    f"""WITH {VERSIONS}, d AS ({DIFF}) SELECT count(*)::BIGINT AS n_input, count(*)::BIGINT AS n_keys, count_if(kind = 'added')::BIGINT AS n_inserted,
        count_if(kind = 'changed')::BIGINT AS n_replaced, count_if(kind = 'removed')::BIGINT AS n_deleted, 0::BIGINT AS n_unchanged FROM d"""
)
def batch_stats(spark, sf_dir):
    return mutate.batch_stats(base_version(spark, sf_dir), _changes(spark, sf_dir), "k")


@query("SELECT o_orderkey AS k, CASE o_orderkey WHEN 4 THEN 'put' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey < 40 AND o_orderkey <> 7 UNION ALL SELECT -1, 'new'")
def store_single_rows(spark, sf_dir):
    """Puts and deletes of one row each."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir).where("k < 40"))
    store.put({"k": 4, "v": "put"})
    store.put({"k": -1, "v": "new"})
    store.delete(7)
    return store.snapshot(store.head())


@query("SELECT o_orderkey AS k, lower(o_orderstatus) AS v FROM orders")
def store_edit(spark, sf_dir):
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    return store.snapshot(store.edit(lambda rows: rows.withColumn("v", F.lower("v")))[1].id)


@query("SELECT 8 AS n_segments, (SELECT count(*) FROM orders)::BIGINT AS n_rows, 7 AS shared, 1 AS only_old, 1 AS only_new, 1 AS n_spans, 0 AS damaged")
def inspection_report(spark, sf_dir):
    """What the inspection tool says of a version, of its difference to the next, and of the whole store."""
    store = _store(spark)
    first = store.write(base_version(spark, sf_dir), partitions=8)
    store.compare_and_swap("main", None, first.id)
    second = store.put({"k": base_version(spark, sf_dir).agg(F.max("k")).first()[0], "v": "changed"})[1]
    said, both = inspection.stats(store, first.id), inspection.compare(store, first.id, second.id)
    spans, lines = inspection.changed_spans(store, first.id, second.id), inspection.to_text(store, first.id).splitlines()
    row = (len(lines) - 1, said["n_rows"], both["shared"], both["only_old"], both["only_new"], len(spans), len(inspection.verify(store)))
    return spark.createDataFrame([row], "n_segments int, n_rows long, shared int, only_old int, only_new int, n_spans int, damaged int")


@query("SELECT true AS fits")
def chunk_boundaries(spark, sf_dir):
    """Content-defined chunks: a row that is changed moves no boundary but its own, and about one row in 64 ends a chunk."""
    rows = base_version(spark, sf_dir)
    ends = rows.where(keys.is_boundary(F.col("k"), F.col("v"), 64)).select("k")
    other = rows.withColumn("v", F.when(F.col("k") == 1, "changed").otherwise(F.col("v")))
    moved = other.where(keys.is_boundary(F.col("k"), F.col("v"), 64)).select("k")
    n, total = ends.count(), rows.count()
    apart = ends.exceptAll(moved).unionByName(moved.exceptAll(ends)).where("k <> 1").count()
    fits = total / 128 < n < total / 32 and not apart
    return spark.createDataFrame([(fits,)], "fits boolean")


# sessions


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey BETWEEN 10 AND 30 AND o_orderkey NOT IN (11, 12) UNION ALL SELECT 12, 'session'")
def session_overlay(spark, sf_dir):
    """A session reads its own changes; what came after a savepoint is undone."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    session = WriteSession(store)
    session.put(12, "session")
    session.delete(11)
    session.savepoint("kept")
    session.delete(13)
    session.put(-5, "undone")
    session.revert("kept")
    return session.range(10, 31)


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey < 200 AND o_orderkey <> 2 UNION ALL SELECT -7, 'flushed'")
def session_commit(spark, sf_dir):
    store = _store(spark)
    store.commit(base_version(spark, sf_dir).where("k < 200"))
    session = WriteSession(store)
    session.put(-7, "flushed")
    session.flush()
    session.delete(2)
    return store.snapshot(session.commit()[1].id)


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 50 AND o_orderkey <= 333 AND o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 300)")
def read_session_scan(spark, sf_dir):
    """A pinned session's scan, in batches, until a row is far enough."""
    store = _store(spark, key="o_orderkey")
    store.commit(_orders(spark, sf_dir))
    found = []
    with ReadSession(store) as session:
        steps = session.scan(50, 334, batch=40)
        while got := steps.next_until(lambda r: r["o_orderkey"] >= 300):
            found += got
            if got[-1]["o_orderkey"] >= 300:
                break
    return _rows(spark, found, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("SELECT o_orderkey AS k, lower(o_orderstatus) AS v, length(o_orderstatus)::INT AS n FROM orders WHERE o_orderkey IN (1, 5, 9) UNION ALL SELECT -3, 'new', 3")
def typed_map(spark, sf_dir):
    """Values as objects through a codec, migrated as one version, and read through a callback."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    typed = TypedMap(store, "v", lambda x: x["status"], lambda x: {"status": x})
    typed.migrate_from(F.lower)
    typed.put(-3, {"status": "new"})
    with ReadSession(store) as session:
        sizes = session.get_many_with([-3, 1, 5, 9], lambda r: len(r["v"]))
    found = [(k, typed.get(k), n) for k, n in zip([-3, 1, 5, 9], sizes, strict=True)]
    return spark.createDataFrame([(k, v["status"], n) for k, v, n in found if v], "k long, v string, n int")


@query("SELECT 'a' AS v, 1::BIGINT AS k, 0::BIGINT AS rows_at_first, true AS kept")
def store_initialize(spark, sf_dir):
    """An empty first version, then a row; the empty one stays."""
    store = _store(spark)
    first = store.initialize(KV)
    store.put({"k": 1, "v": "a"})
    return store.snapshot(store.head()).select("v", "k", F.lit(first.n_rows).cast("long").alias("rows_at_first"), F.lit(store.has(first.id)).alias("kept"))


@query("SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'nation', count(*) FROM nation")
def catalog_commit(spark, sf_dir):
    """Two tables moved at once; a second call with the same token changes nothing."""
    names = {"customer": "c_custkey", "nation": "n_nationkey"}
    catalog = Catalog(fresh_path(spark, "catalog"), {n: _store(spark, n, k) for n, k in names.items()})
    heads = catalog.commit({n: table(spark, sf_dir, n) for n in names}, {})
    for _ in range(2):
        catalog.commit({"customer": table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")}, heads, token="halve")
    return _rows(spark, [(n, rows.count()) for n, rows in catalog.snapshot().items()], "name string, n long")


# scans on the driver's side


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey > 100 AND o_orderkey < 5000 ORDER BY o_orderkey LIMIT 60")
def scan_pages(spark, sf_dir):
    one = scan.page(_orders(spark, sf_dir), "o_orderkey", 30, 100, 5000)
    two = scan.page(_orders(spark, sf_dir), "o_orderkey", 30, one.cursor, 5000)
    return _rows(spark, one.rows + two.rows, "o_orderkey long, o_custkey long, o_orderstatus string")


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 60")
def scan_reverse_pages(spark, sf_dir):
    one = scan.reverse_page(_orders(spark, sf_dir), "o_orderkey", 30, 5000, 100)
    two = scan.reverse_page(_orders(spark, sf_dir), "o_orderkey", 30, one.cursor, 100)
    return _rows(spark, one.rows + two.rows, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name DESC LIMIT 6")
def scan_prefix_reverse_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_name", "c_custkey")
    one = scan.reverse_page(rows, "c_name", 3, prefix="Customer#00000001")
    two = scan.reverse_page(rows, "c_name", 3, one.cursor, prefix="Customer#00000001") if one.cursor else scan.Page([], None)
    return _rows(spark, one.rows + two.rows, "c_name string, c_custkey long")


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 10 ORDER BY o_orderkey LIMIT 25")
def scan_until(spark, sf_dir):
    """Rows handed to a function, which stops at the 25th."""
    got = []
    scan.visit(_orders(spark, sf_dir), "o_orderkey", lambda r: got.append(r) or (len(got) == 25 or None), start=10)
    return _rows(spark, got, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name DESC")
def scan_prefix_until(spark, sf_dir):
    got = []
    scan.visit(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", got.append, descending=True, prefix="Customer#00000001")
    return _rows(spark, got, "c_name string, c_custkey long")


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 77 ORDER BY o_orderkey LIMIT 12")
def cursor_steps(spark, sf_dir):
    cursor, got = scan.Cursor(_orders(spark, sf_dir), "o_orderkey", block=5), []
    cursor.seek(77)
    while len(got) < 12 and (row := cursor.peek()):
        got.append(row)
        cursor.advance()
    return _rows(spark, got, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("SELECT sum(n)::BIGINT AS n_entries, sum(b)::BIGINT AS bytes, min(k) AS low, max(k) AS high FROM (SELECT o_orderkey AS k, 1 AS n, octet_length(encode(o_orderstatus)) AS b FROM orders)")
def range_stats(spark, sf_dir):
    """Statistics by key range, summed up."""
    found = scan.range_stats(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus", 8)
    return found.agg(F.sum("n_entries").alias("n_entries"), F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders)::BIGINT AS n FROM orders WHERE o_orderkey = 33")
def contains_key(spark, sf_dir):
    rows = scan.scan(_orders(spark, sf_dir), "o_orderkey", 33, 34).select("o_orderkey")
    return rows.withColumn("n", F.lit(_orders(spark, sf_dir).count()))


# codecs


@query("SELECT event_id, lpad(to_hex((epoch_us(ts) // 1000)::UBIGINT), 16, '0') AS key_hex FROM events")
def key_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", keys.printable(keys.timestamp_millis_key(F.col("ts"))).alias("key_hex"))


@query("SELECT n_nationkey, n_name, 'r' || n_regionkey AS region FROM nation")
def key_decode(spark, sf_dir):
    """Composite keys taken apart again."""
    parts = keys.decoded_segments(keys.segments(F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    got = table(spark, sf_dir, "nation").select("n_nationkey", parts.alias("p"))
    return got.select("n_nationkey", F.col("p")[0].cast("string").alias("n_name"), F.col("p")[1].cast("string").alias("region"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '0x00' || lower(hex(encode(n_name))) END AS shown FROM nation")
def key_debug(spark, sf_dir):
    key = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name").cast("binary")).otherwise(F.concat(F.lit(b"\x00"), F.col("n_name").cast("binary")))
    return table(spark, sf_dir, "nation").select("n_nationkey", keys.debug_key(key).alias("shown"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000002' AND c_name < 'Customer#00000003'")
def key_prefix_range(spark, sf_dir):
    low, high = keys.prefix_range(b"Customer#00000002")
    name = F.col("c_name").cast("binary")
    return table(spark, sf_dir, "customer").where((name >= F.lit(low)) & (name < F.lit(high))).select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('u', '00000000000000000000000000000007'), ('u', '00000000000000010000000000000000'), ('i', '7FFFFFFFFFFFFFFFFFFFFFFFFFFFFFFE'), ('i', '80000000000000000000000000000003')) t(kind, key_hex)")
def key_wide(spark, sf_dir):
    found = [("u", keys.wide_key(7)), ("u", keys.wide_key(1 << 64)), ("i", keys.wide_key(-2, True)), ("i", keys.wide_key(3, True))]
    return spark.createDataFrame(found, "kind string, key binary").select("kind", F.hex("key").alias("key_hex"))


@query("SELECT event_id, event_type AS payload, 2::BIGINT AS version, event_id % 2 = 0 AS fits FROM events")
def value_envelopes(spark, sf_dir):
    """Envelopes through their bytes, and whether they are of a schema."""
    schema = F.when(F.col("event_id") % 2 == 0, "event").otherwise("other")
    boxed = F.struct(schema.alias("schema"), F.lit(2).cast("long").alias("version"), F.lit("raw").alias("encoding"), F.col("event_type").cast("binary").alias("payload"))
    rows = table(spark, sf_dir, "events").select("event_id", values.envelope_of(values.envelope_bytes(boxed)).alias("e"))
    return rows.select("event_id", F.col("e.payload").cast("string").alias("payload"), "e.version", values.matches_schema(F.col("e"), "event", 2).alias("fits"))


@query("SELECT event_id, upper(event_type) || '!' AS payload FROM events")
def value_migration(spark, sf_dir):
    """Values of versions 1 and 2 brought up to 3, step by step, under the guard of their schema."""
    event = F.col("event_type")
    old = F.when(F.col("event_id") % 2 == 0, event).otherwise(F.upper(event))
    version = F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).cast("long")
    boxed = F.struct(F.lit("event").alias("schema"), version.alias("version"), F.lit("json").alias("encoding"), old.alias("payload"))
    rows = table(spark, sf_dir, "events").select("event_id", boxed.alias("e"))
    newest = values.migrate(rows, "e", {1: F.upper("payload"), 2: F.concat("payload", F.lit("!"))}, "event", 3)
    return newest.select("event_id", values.require_schema(F.col("e"), "event", 3).alias("payload"))


@query("SELECT event_id, event_type, user_id FROM events")
def cbor_round_trip(spark, sf_dir):
    """Values as CBOR and back."""
    rows = table(spark, sf_dir, "events").select("event_id", cbor.encode_json_as_cbor(F.to_json(F.struct("event_type", "user_id"))).alias("value"))
    text = rows.select("event_id", cbor.decode_cbor_as_json(F.col("value")).alias("j"))
    return text.select("event_id", F.from_json("j", "event_type string, user_id bigint").alias("d")).select("event_id", "d.event_type", "d.user_id")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(20, 2) + 0.10 AS total, CASE WHEN o_totalprice > 150000 THEN 1 WHEN o_totalprice < 150000 THEN -1 ELSE 0 END AS ordering FROM orders WHERE o_orderkey < 400")
def decimal_sums(spark, sf_dir):
    """Exact decimals of any scale, as text: sums and comparisons."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey < 400").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("a"))
    total = decimals.add(F.col("a"), F.lit("0.10")).cast("decimal(21,2)")
    return rows.select("o_orderkey", total.alias("total"), decimals.compare(F.col("a"), F.lit("150000")).alias("ordering"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice::DECIMAL(20, 2) - 150000, o_orderkey)::INT AS place FROM orders WHERE o_orderkey < 400")
def decimal_order(spark, sf_dir):
    """Numbers in the order of their encoded bytes, below and above nought."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").where("o_orderkey < 400").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("a"))
    coded = rows.select("o_orderkey", decimals.sort_key(decimals.subtract(F.col("a"), F.lit("150000"))).alias("code"))
    return coded.select("o_orderkey", F.row_number().over(Window.orderBy("code", "o_orderkey")).alias("place"))


@query("SELECT n_regionkey AS bucket, sha256(string_agg(sha256('v' || n_nationkey || chr(31) || 'v' || n_name), '' ORDER BY n_nationkey)) AS cid, count(*)::BIGINT AS n_rows FROM nation GROUP BY 1")
def ordered_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return integrity.chunk_digests(rows, "n_nationkey", ["n_nationkey", "n_name"], 5, bucket=F.col("n_regionkey"))


# changes


@query(f"WITH {VERSIONS} SELECT k, v FROM base UNION ALL SELECT k + 10000000, 'later' FROM base WHERE k % 100 = 0")
def append_rows(spark, sf_dir):
    base = base_version(spark, sf_dir)
    later = base.where("k % 100 = 0").select((F.col("k") + 10000000).alias("k"), F.lit("later").alias("v"))
    return mutate.append(base, later, "k")


@query(f"WITH {VERSIONS} SELECT k, v, CASE WHEN k % 7 = 0 THEN 'ann' END AS actor, CASE WHEN k % 7 = 0 THEN k * 10 END AS millis FROM base")
def tombstones(spark, sf_dir):
    """Soft deletions, whose marks go through their stored form."""
    rows = base_version(spark, sf_dir).withColumn("deleted", F.lit(None).cast(mutate.TOMBSTONE))
    gone = mutate.soft_delete(rows, rows.where("k % 7 = 0").select("k"), "k", mutate.tombstone(F.lit("ann"), F.col("k") * 10))
    stored = gone.withColumn("deleted", mutate.tombstone_of(mutate.tombstone_bytes(F.col("deleted"))))
    return stored.select("k", "v", F.col("deleted.actor").alias("actor"), F.col("deleted.millis").alias("millis"))


@query(f"WITH {VERSIONS} SELECT k, v FROM base WHERE k % 7 <> 0 OR k * 10 >= 5000")
def tombstones_compacted(spark, sf_dir):
    """Deletions from before a time made real."""
    rows = base_version(spark, sf_dir).withColumn("deleted", F.lit(None).cast(mutate.TOMBSTONE))
    gone = mutate.soft_delete(rows, rows.where("k % 7 = 0").select("k"), "k", mutate.tombstone(F.lit("ann"), F.col("k") * 10))
    return mutate.compact_tombstones(gone, before=5000).select("k", "v")


@query(_merge_sql("b"))
def merge_use_base(spark, sf_dir):
    return merge.merge(*_three(spark, sf_dir), "k", "v", merge.use_base, strict=False)


@query(_merge_sql("CASE WHEN lv IS NULL OR rv IS NULL THEN NULL ELSE lv || '+' || rv END"))
def merge_custom(spark, sf_dir):
    """Two updates joined by a function, deletions winning."""
    rule = merge.resolve_custom(lambda b, left, right: F.concat(left, F.lit("+"), right), merge.delete_wins)
    return merge.merge(*_three(spark, sf_dir), "k", "v", rule, strict=False)


@query(
    f"""WITH {VERSIONS}, m AS (SELECT k, CASE WHEN k::VARCHAR NOT LIKE '3%' THEN lv WHEN lv IS NOT DISTINCT FROM rv OR rv IS NOT DISTINCT FROM b THEN lv
        WHEN lv IS NOT DISTINCT FROM b THEN rv ELSE rv END AS v FROM al) SELECT k::VARCHAR AS key, v FROM m WHERE v IS NOT NULL"""
)
def merge_prefix(spark, sf_dir):
    sides = [s.select(F.col("k").cast("string").alias("key"), "v") for s in _three(spark, sf_dir)]
    return merge.merge_prefix(*sides, "key", "v", "3", merge.prefer_right)


@query(
    f"""WITH {VERSIONS} SELECT k, b AS base, lv AS "left", rv AS "right", CASE WHEN lv IS NOT DISTINCT FROM rv THEN 'same' WHEN rv IS NOT DISTINCT FROM b THEN 'take_left'
        WHEN lv IS NOT DISTINCT FROM b THEN 'take_right' WHEN lv IS NULL THEN 'conflict_delete' ELSE 'conflict_value' END AS decision,
        CASE WHEN lv IS NOT DISTINCT FROM b AND rv IS DISTINCT FROM b THEN rv ELSE lv END AS merged
        FROM al WHERE lv IS DISTINCT FROM b OR rv IS DISTINCT FROM b"""
)
def merge_trace(spark, sf_dir):
    return merge.trace(*_three(spark, sf_dir), "k", "v", merge.prefer_left)


@query(
    """WITH e AS (SELECT user_id, event_type AS v, event_id // 3 AS t FROM events), m AS (SELECT user_id, max(t) AS t, count(*) AS n FROM e GROUP BY 1)
       SELECT m.user_id, max(e.v) AS v, m.t, (any_value(m.n) - 1)::BIGINT AS n_beaten, count(*) > 1 AS tied FROM m JOIN e ON e.user_id = m.user_id AND e.t = m.t GROUP BY m.user_id, m.t"""
)
def crdt_explain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("v"), F.floor(F.col("event_id") / 3).alias("t"))
    return merge.crdt_explain(rows, ["user_id"], "v", "t")


@query(
    f"""WITH {VERSIONS}, m AS (SELECT k, CASE WHEN lv IS NOT DISTINCT FROM rv OR rv IS NOT DISTINCT FROM b THEN lv WHEN lv IS NOT DISTINCT FROM b THEN rv
        WHEN k % 3 > k % 2 THEN lv WHEN k % 2 > k % 3 THEN rv ELSE greatest(lv, rv) END AS v FROM al) SELECT k, v FROM m WHERE v IS NOT NULL"""
)
def merge_timestamps(spark, sf_dir):
    """Three-way last-writer-wins, times being given beside the values."""
    aligned = merge.align(*_three(spark, sf_dir), "k", "v").withColumn("lt", F.expr("abs(k) % 3 * sign(k)").cast("int")).withColumn("rt", F.expr("abs(k) % 2 * sign(k)").cast("int"))
    return merge.decide(aligned, merge.resolve_lww("v", "lt", "rt")).select("k", F.col("merged").alias("v")).where("v IS NOT NULL")


@query(
    """SELECT 'status' AS term, o_orderstatus AS value, count(*)::BIGINT AS n_rows, min(o_orderkey) AS first_pk, max(o_orderkey) AS last_pk FROM orders GROUP BY 2
       UNION ALL SELECT 'priority', o_orderpriority, count(*), min(o_orderkey), max(o_orderkey) FROM orders GROUP BY 2"""
)
def summary_index(spark, sf_dir):
    return views.summary_index(table(spark, sf_dir, "orders"), "o_orderkey", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


# expressions over collections


def _tagged(spark, sf_dir):
    words = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", words.alias("words"), F.array_sort(F.array_distinct(words)).alias("tags"), F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("of")).alias("info"), F.create_map(F.lit("type"), F.col("p_type")).alias("more"))


PARTS = "(SELECT p_partkey, string_split(p_name, ' ') AS words, list_sort(list_distinct(string_split(p_name, ' '))) AS tags, p_size, p_brand, p_type FROM part)"
ANY_WORD = "(SELECT min(string_split(p_name, ' ')[1]) FROM part)"


def _any_word(spark, sf_dir) -> str:
    return table(spark, sf_dir, "part").agg(F.min(F.split("p_name", " ")[0])).first()[0]


@query(f"SELECT p_partkey FROM {PARTS} WHERE list_contains(words, {ANY_WORD})")
def doc_filter_contains_list(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return rows.where(conditions.condition("contains(words, :w)", rows, None, {":w": _any_word(spark, sf_dir)})).select("p_partkey")


@query(f"SELECT p_partkey FROM {PARTS} WHERE len(words) > 1 AND len(tags) < 9 AND p_size > 10")
def doc_filter_size_list(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return rows.where(conditions.condition("size(words) > :n AND size(#t) < :m AND info.size > :s", rows, {"#t": "tags"}, {":n": 1, ":m": 9, ":s": 10})).select("p_partkey")


@query(f"SELECT p_partkey FROM {PARTS} WHERE p_partkey % 2 = 0")
def doc_filter_type(spark, sf_dir):
    rows = _tagged(spark, sf_dir).withColumn("even", F.when(F.col("p_partkey") % 2 == 0, "yes"))
    text = "attribute_type(even, :s) AND attribute_type(words, :l) AND attribute_type(tags, :ss) AND attribute_type(info, :m) AND NOT attribute_type(p_partkey, :s) AND attribute_type(p_partkey, :n)"
    bound = {":s": "S", ":l": "L", ":ss": "SS", ":m": "M", ":n": "N"}
    return rows.where(conditions.condition(text, rows, None, bound, frozenset({"tags"}))).select("p_partkey")


@query(f"SELECT p_partkey, words[1] AS words_0, p_brand AS info_of_brand, p_type AS more_type FROM {PARTS}")
def doc_projection_nested(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return rows.select(*conditions.projection("p_partkey, words[0], info.of.brand, #m.#t", rows, {"#m": "more", "#t": "type"}))


@query(f"SELECT p_partkey, p_size + 1 AS size, 'none' AS brand, words[1] AS w0, 'last' AS w_last, len(words)::INT AS n_words, 'x' AS new_entry, NULL::VARCHAR AS type FROM {PARTS}")
def doc_update_nested(spark, sf_dir):
    """Paths inside structs, lists and maps set and removed at once."""
    rows = _tagged(spark, sf_dir)
    text = "SET info.size = info.size + :one, info.of.brand = :b, words[99] = :l, more.#n = :x REMOVE words[1], more.#t"
    new = conditions.update(text, rows, {"p_partkey"}, {"#n": "new", "#t": "type"}, {":one": 1, ":b": "none", ":l": "last", ":x": "x"})
    out = rows.select("p_partkey", *[c.alias(n) for n, c in new.items()])
    last = F.element_at("words", -1)
    return out.select(
        "p_partkey", F.col("info.size").alias("size"), F.col("info.of.brand").alias("brand"), F.col("words")[0].alias("w0"), last.alias("w_last"),
        F.when(F.size("words") > 1, F.size("words")).otherwise(F.size("words") - 1).alias("n_words"), F.col("more")["new"].alias("new_entry"), F.col("more")["type"].alias("type"),
    )


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(tags, ['zz', 'aa']))), ',') AS tags FROM {PARTS}")
def doc_update_add_set(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    new = conditions.update("ADD tags :more", rows, {"p_partkey"}, None, {":more": {"zz", "aa"}})
    return rows.select("p_partkey", F.array_join(new["tags"], ",").alias("tags"))


@query(f"SELECT p_partkey, CASE WHEN len(list_filter(tags, lambda x: x <> w)) > 0 THEN array_to_string(list_filter(tags, lambda x: x <> w), ',') END AS tags FROM {PARTS}, (SELECT {ANY_WORD} AS w)")
def doc_update_delete_set(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    new = conditions.update("DELETE tags :gone", rows, {"p_partkey"}, None, {":gone": {_any_word(spark, sf_dir)}})
    return rows.select("p_partkey", F.array_join(new["tags"], ",").alias("tags"))


@query(f"SELECT p_partkey, array_to_string(list_concat(words, ['end']), ',') AS words FROM {PARTS}")
def doc_list_append(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    new = conditions.update("SET words = list_append(words, :e)", rows, {"p_partkey"}, None, {":e": ["end"]})
    return rows.select("p_partkey", F.array_join(new["words"], ",").alias("words"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn BETWEEN 0 AND 5 AND role = 'user'")
def doc_read_expressions(spark, sf_dir):
    """Key condition, filter and projection over one set of bindings."""
    rows = table(spark, sf_dir, "conversations")
    names, bound = {"#r": "role", "#c": "conv_id"}, {":c": 3, ":a": 0, ":b": 5, ":u": "user"}
    found = conditions.read_expressions(rows, "conv_id", "turn", "#c = :c AND turn BETWEEN :a AND :b", "#r = :u", "#c, turn, #r", names, bound)
    return rows.where(found.key).where(found.filter).select(*found.shown)


# document tables


def _conversations(spark, sf_dir) -> DocumentTable:
    return DocumentTable(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT conv_id, turn, role FROM (SELECT * FROM conversations WHERE conv_id = 5 ORDER BY turn DESC LIMIT 3) WHERE role = 'user'")
def doc_table_query(spark, sf_dir):
    found = _conversations(spark, sf_dir).query("conv_id = :c", {":c": 5}, "role = :u", {":u": "user"}, limit=3, forward=False)
    return _rows(spark, found.items, "conv_id long, turn long, role string")


@query("SELECT conv_id, turn FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 30) WHERE role = 'user'")
def doc_table_scan(spark, sf_dir):
    """Two pages of a scan; the filter comes after each page's limit."""
    rows = _conversations(spark, sf_dir)
    one = rows.scan("role = :u", {":u": "user"}, limit=15, project="conv_id, turn")
    two = rows.scan("role = :u", {":u": "user"}, limit=15, project="conv_id, turn", after=one.last_key)
    return _rows(spark, one.items + two.items, "conv_id long, turn long")


@query("SELECT count_if(role = 'user')::BIGINT AS n, count(*)::BIGINT AS scanned FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 50)")
def doc_select_count(spark, sf_dir):
    found = _conversations(spark, sf_dir).scan("role = :u", {":u": "user"}, limit=50, select="COUNT")
    return spark.createDataFrame([(found.count, found.scanned_count)], "n long, scanned long")


def _document_database(spark, sf_dir) -> DocumentDatabase:
    db = DocumentDatabase(spark, fresh_path(spark, "documents"))
    db.create_table("turns", "conv_id BIGINT, turn BIGINT, role STRING, expires BIGINT", "conv_id", "turn", {"by_role": ("role", "conv_id")}, "expires")
    db.create_table("totals", "conv_id BIGINT, n BIGINT", "conv_id")
    rows = table(spark, sf_dir, "conversations").where("conv_id < 20").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    db.bulk_load("turns", rows.withColumn("expires", F.when(F.col("turn") == 0, 1000 + F.col("conv_id"))))
    return db


TURNS = "(SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, CASE WHEN turn = 0 THEN 1000 + conv_id END AS expires FROM conversations WHERE conv_id < 20)"


@query(f"SELECT conv_id, turn, CASE WHEN conv_id = 1 AND turn = 0 THEN 'put' WHEN conv_id = 2 AND turn = 0 THEN role || '?' ELSE role END AS role FROM {TURNS} WHERE NOT (conv_id = 3 AND turn = 0) UNION ALL SELECT 99, 0, 'new'")
def docdb_items(spark, sf_dir):
    """Conditional puts, an update and a deletion, each a version."""
    db = _document_database(spark, sf_dir)
    db.put_item("turns", {"conv_id": 1, "turn": 0, "role": "put"}, "attribute_exists(conv_id)")
    db.put_item("turns", {"conv_id": 99, "turn": 0, "role": "new"}, "attribute_not_exists(conv_id)")
    db.delete_item("turns", {"conv_id": 3, "turn": 0})
    role = db.get_item("turns", {"conv_id": 2, "turn": 0})["role"]
    db.update_item("turns", {"conv_id": 2, "turn": 0}, "SET #r = :r", names={"#r": "role"}, values={":r": role + "?"})
    return db.table("turns").rows.select("conv_id", "turn", "role")


@query(f"SELECT conv_id, turn FROM {TURNS} WHERE NOT (conv_id = 4 AND turn = 0) UNION ALL SELECT 4, -1")
def docdb_transaction(spark, sf_dir):
    """Several tables at once; a failed check and a repeated token change nothing."""
    db = _document_database(spark, sf_dir)
    actions = [("turns", "delete", {"conv_id": 4, "turn": 0}, {}), ("totals", "update", {"conv_id": 4}, {"expression": "ADD n :x", "values": {":x": -1}})]
    for _ in range(2):
        db.transact_write(actions, token="once")
    try:
        db.transact_write([("turns", "delete", {"conv_id": 5, "turn": 0}, {}), ("totals", "check", {"conv_id": 5}, {"condition": "attribute_exists(n)"})])
    except RuntimeError:
        pass
    n = db.transact_get([("totals", {"conv_id": 4}), ("turns", {"conv_id": 4, "turn": 0})])
    kept = db.table("turns").rows.select("conv_id", "turn")
    return kept.unionByName(spark.createDataFrame([(n[0]["conv_id"], n[0]["n"])], "conv_id long, turn long")) if n[1] is None else kept


@query(f"SELECT conv_id, turn, role FROM {TURNS} WHERE role = 'user' AND conv_id >= 10")
def docdb_index(spark, sf_dir):
    """A secondary index of a table, by a range of its sort key."""
    found = _document_database(spark, sf_dir).index("turns", "by_role").query("role = :r AND conv_id >= :c", {":r": "user", ":c": 10}, limit=10**6)
    return _rows(spark, [r[:3] for r in map(tuple, found.items)], "conv_id long, turn long, role string")


@query(f"SELECT conv_id, turn FROM {TURNS} WHERE expires IS NULL OR expires > 1010")
def docdb_expiry(spark, sf_dir):
    db = _document_database(spark, sf_dir)
    db.expire("turns", 1010)
    return db.table("turns").rows.select("conv_id", "turn")


@query(f"SELECT conv_id, turn, role, expires FROM {TURNS}")
def docdb_archive(spark, sf_dir):
    """A table exported and imported under another name."""
    db, target = _document_database(spark, sf_dir), fresh_path(spark, "archive")
    db.export_table("turns", target)
    db.import_table("copy", target)
    return db.table("copy").rows


@query("SELECT * FROM (VALUES (1, 'turns'), (2, 'totals'), (3, 'turns')) t(sequence, name)")
def docdb_feed(spark, sf_dir):
    """Commits handed to a worker under a lease, from its checkpoint on."""
    db, seen = _document_database(spark, sf_dir), []
    while db.run_worker("copy", "worker", lambda c: seen.extend((c["sequence"], n) for n in c["versions"]), limit=2):
        pass
    return spark.createDataFrame(seen, "sequence int, name string")


@query(f"SELECT conv_id, turn FROM {TURNS}")
def docdb_restore(spark, sf_dir):
    """Back to an earlier version; retention then drops the others."""
    db = _document_database(spark, sf_dir)
    first = db.heads()["turns"]
    db.batch_write({"turns": ([{"conv_id": 77, "turn": 0}], [{"conv_id": 1, "turn": 0}])})
    db.restore("turns", first)
    if not db.apply_retention("turns", 1):
        raise RuntimeError("retention dropped nothing")
    return db.table("turns").rows.select("conv_id", "turn")


@query(f"SELECT conv_id, turn, role FROM {TURNS} WHERE conv_id IN (1, 2) AND turn = 0")
def docdb_batch_get(spark, sf_dir):
    got = _document_database(spark, sf_dir).batch_get({"turns": [{"conv_id": c, "turn": 0} for c in (1, 2, 500)], "totals": [{"conv_id": 1}]})
    return got["turns"].select("conv_id", "turn", "role")


# indexed stores


def _customers(spark, sf_dir) -> IndexedStore:
    store = IndexedStore(spark, fresh_path(spark, "indexed"), "c_custkey")
    store.register(Definition("segment", "c_mktsegment", ("c_nationkey",)))
    store.register(Definition("words", "split(c_name, '#')", many=True))
    store.initialize(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    return store


@query("SELECT 'MOVED' AS term, c_custkey AS pk, c_nationkey FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0")
def indexed_apply(spark, sf_dir):
    """Rows changed and deleted, with their entries, under one head."""
    store = _customers(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select("c_custkey", "c_name", F.lit("MOVED").alias("c_mktsegment"), "c_nationkey")
    store.apply(rows.withColumn("op", F.expr("if(c_custkey % 8 = 0, 'delete', 'upsert')")))
    return store.snapshot().exact("segment", "MOVED")


@query("SELECT c_mktsegment AS term, c_custkey AS pk FROM customer WHERE c_mktsegment >= 'B' ORDER BY 1, 2 LIMIT 50")
def indexed_pages(spark, sf_dir):
    """Two pages of a range, by a cursor that fits this query of this snapshot only."""
    now = _customers(spark, sf_dir).snapshot()
    one, cursor = now.page("segment", 25, start="B")
    two, _ = now.page("segment", 25, cursor, start="B")
    return _rows(spark, [r[:2] for r in map(tuple, one + two)], "term string, pk long")


@query("SELECT c_custkey AS pk, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def indexed_old_snapshot(spark, sf_dir):
    """An earlier snapshot by its id, joined back to its own source."""
    store = _customers(spark, sf_dir)
    first = store.snapshot().id
    store.apply(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("GONE").alias("c_mktsegment"), "c_nationkey", F.lit("upsert").alias("op")))
    old = store.snapshot_by_id(first)
    return old.records(old.exact("segment", "MACHINERY")).select("pk", "c_name")


@query("SELECT lower(c_mktsegment) AS term, count(*)::BIGINT AS n, 0::BIGINT AS wrong FROM customer GROUP BY 1")
def indexed_replaced(spark, sf_dir):
    """An index replaced by a later generation, another taken out; both verified against fresh builds."""
    store = _customers(spark, sf_dir)
    store.replace(Definition("segment", "lower(c_mktsegment)", generation=2))
    store.deactivate("words")
    wrong = sum(store.verify_all().values())
    return store.snapshot().index("segment").groupBy("term").agg(F.count("*").alias("n"), F.lit(wrong).cast("long").alias("wrong"))


@query("SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(c_name, '#')) AS term FROM customer) GROUP BY term")
def indexed_bundle(spark, sf_dir):
    """Source and indexes exported, imported and checked."""
    target, other = fresh_path(spark, "bundle"), IndexedStore(spark, fresh_path(spark, "other"), "c_custkey")
    _customers(spark, sf_dir).export_current(target)
    other.import_current(target)
    return other.snapshot().index("words").groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT 'segment' AS name, 'active' AS health, 1 AS collected UNION ALL SELECT 'words', 'active', 1")
def indexed_collection(spark, sf_dir):
    """A pin holds a snapshot's versions; without it they are collected."""
    store = _customers(spark, sf_dir)
    store.pin("hold", store.snapshot())
    store.delete(1)
    held = store.collect()
    store.release_pin("hold")
    freed = store.collect(apply=True)
    return spark.createDataFrame([(n, h, len(freed[f"index-{n}"]) - len(held[f"index-{n}"])) for n, h in store.health().items()], "name string, health string, collected int")


@query("SELECT c_mktsegment AS term, c_custkey AS pk FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey <= 40")
def index_budget(spark, sf_dir):
    """A query within its budget; one row over it would be an error."""
    entries = index.build(table(spark, sf_dir, "customer").where("c_custkey <= 40"), "c_custkey", F.col("c_mktsegment"))
    return index.budgeted(index.exact(entries, "BUILDING"), 40)


@query("SELECT '/' || split_part(url, '/', 3) AS term, page_id AS pk FROM pages WHERE '/' || split_part(url, '/', 3) >= '/a' AND '/' || split_part(url, '/', 3) < '/n'")
def index_paths(spark, sf_dir):
    """Pages by canonical path, as a range of a subtree."""
    path = index.canonical_path(F.concat(F.lit("//"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/")))
    return index.term_range(index.build(table(spark, sf_dir, "pages"), "page_id", path), "/a", "/n")


# vectors


def _vector_map(spark, sf_dir) -> VectorMap:
    found = VectorMap(spark, fresh_path(spark, "vectors"), 0)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("key"), F.col("embedding").alias("vec"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("value"))
    found.dimensions = len(rows.first()["vec"])
    found.build(rows)
    return found


def _hits(spark, result):
    return spark.createDataFrame(result.hits, "vec_id long, distance double").select("vec_id", (F.round("distance", 9) + 0.0).alias("distance"))


@query(f"SELECT e.vec_id::BIGINT AS vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q WHERE e.vec_id >= 100 AND e.vec_id < 400 ORDER BY list_sum({L2}), 1 LIMIT 10")
def vector_search_range(spark, sf_dir):
    """A planned search among a key range."""
    found = _vector_map(spark, sf_dir).search(SearchRequest(tuple(_query_vector(spark, sf_dir)), 10, start=100, end=400))
    return _hits(spark, found)


@query(f"SELECT e.vec_id::BIGINT AS vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q WHERE e.vec_id % 7 = 0 AND e.vec_id < 500 ORDER BY list_sum({L2}), 1 LIMIT 5")
def vector_search_listed(spark, sf_dir):
    """A short list of keys is searched exactly, whatever was built."""
    vectors = _vector_map(spark, sf_dir)
    vectors.accelerate("sq8")
    found = vectors.search(SearchRequest(tuple(_query_vector(spark, sf_dir)), 5, keys=tuple(range(0, 500, 7))))
    return _hits(spark, found)


@query(f"SELECT e.vec_id::BIGINT AS vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q WHERE e.vec_id % 10 <> 3 ORDER BY list_sum({L2}), 1 LIMIT 10")
def vector_changes(spark, sf_dir):
    """Deletions committed, then searched over the older version and the changes."""
    vectors = _vector_map(spark, sf_dir)
    base = vectors.store.head()
    vectors.mutate(vectors.records().where("key % 10 = 3").withColumn("op", F.lit("delete")))
    hits = vectors.search_composite(base, SearchRequest(tuple(_query_vector(spark, sf_dir)), 10))
    return spark.createDataFrame(hits, "vec_id long, distance double").select("vec_id", (F.round("distance", 9) + 0.0).alias("distance"))


@query()
def vector_graph(spark, sf_dir):
    """The ten nearest by walks over neighbour graphs; recall is tested and stated in the README."""
    vectors = _vector_map(spark, sf_dir)
    vectors.accelerate("graph")
    return _hits(spark, vectors.search(SearchRequest(tuple(_query_vector(spark, sf_dir)), 10)))


@query(f"SELECT true AS replays, false AS forged, string_agg('text ' || vec_id, ' | ' ORDER BY d, vec_id) AS context FROM (SELECT e.vec_id, list_sum({L2}) AS d FROM embeddings e, {QUERY} q ORDER BY d, 1 LIMIT 3)")
def vector_proof(spark, sf_dir):
    """A search that can be replayed, and its context."""
    vectors = _vector_map(spark, sf_dir)
    request = SearchRequest(tuple(_query_vector(spark, sf_dir)), 3)
    proof = vectors.prove(request)
    checked = (vectors.verify_proof(proof), vectors.verify_proof(proof | {"hits": proof["hits"][:-1]}), vectors.context(vectors.search(request), " | "))
    return spark.createDataFrame([checked], "replays boolean, forged boolean, context string")


@query("SELECT (SELECT count(*) FROM embeddings)::BIGINT AS records, 0 AS bad_vectors, 0 AS stale_accelerators")
def vector_verify(spark, sf_dir):
    vectors = _vector_map(spark, sf_dir)
    vectors.accelerate("sq8")
    found = vectors.verify()
    return spark.createDataFrame([(found["records"], found["bad_vectors"], found["stale_accelerators"])], "records long, bad_vectors int, stale_accelerators int")


@query("SELECT vec_id::BIGINT AS vec_id, 'text ' || vec_id AS value FROM embeddings WHERE vec_id >= 10 AND vec_id < 30")
def vector_records(spark, sf_dir):
    vectors = _vector_map(spark, sf_dir)
    return vectors.scan(10, 30).select(F.col("key").alias("vec_id"), "value")


@query("SELECT vec_id, true AS unit FROM embeddings")
def vector_unit(spark, sf_dir):
    """Checked and brought to unit length."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", proximity.normalized(F.col("embedding")).alias("u"))
    return rows.select("vec_id", (F.abs(proximity.dot(F.col("u"), F.col("u")) - 1.0) < 1e-6).alias("unit"))


@query(f"SELECT vec_id, round(s, 4) + 0.0 AS similarity FROM (SELECT e.vec_id, list_sum({L2.replace('- p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)', '* 1.0 * p[2]::DOUBLE)')}) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS s FROM embeddings e, {QUERY} q)")
def cosine_similarities(spark, sf_dir):
    target = F.array(*[F.lit(x).cast("float") for x in _query_vector(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", (F.round(proximity.cosine_similarity(F.col("embedding"), target).cast("double"), 4) + 0.0).alias("similarity"))


# SQL


def _database(spark, sf_dir) -> SqlDatabase:
    db = SqlDatabase(spark, fresh_path(spark, "sql"))
    db.begin()
    db.execute("CREATE TABLE regions (r_regionkey BIGINT PRIMARY KEY, r_name STRING NOT NULL UNIQUE)")
    db.execute("CREATE TABLE nations (n_nationkey BIGINT PRIMARY KEY, n_name STRING, n_regionkey BIGINT, FOREIGN KEY (n_regionkey) REFERENCES regions (r_regionkey))")
    db.insert("regions", table(spark, sf_dir, "region"))
    db.insert("nations", table(spark, sf_dir, "nation"))
    db.commit("load")
    return db


@query("SELECT r_name, count(*)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sql_query(spark, sf_dir):
    return _database(spark, sf_dir).execute("SELECT r_name, count(*) AS n FROM nations JOIN regions ON n_regionkey = r_regionkey GROUP BY 1")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 2 THEN 'TWO' WHEN n_nationkey > 20 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 100, 'NEW'")
def sql_changes(spark, sf_dir):
    """Upsert, update and delete statements."""
    db = _database(spark, sf_dir)
    db.execute("UPSERT INTO nations VALUES (2, 'TWO', 1), (100, 'NEW', 0)")
    db.execute("UPDATE nations SET n_name = lower(n_name) WHERE n_nationkey > 20 AND n_nationkey < 100")
    db.execute("DELETE FROM nations WHERE n_nationkey = 5")
    return db.scan("nations").select("n_nationkey", "n_name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::BIGINT AS id, (SELECT count(*) FROM nation)::BIGINT + 1 AS next_id FROM nation")
def sql_generated_ids(spark, sf_dir):
    """Rows of a table without a key are numbered without gaps, over several inserts."""
    db = SqlDatabase(spark, fresh_path(spark, "sql"))
    db.execute("CREATE TABLE names (n_name STRING)")
    db.append("names", table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_name").repartition(3))
    db.append("names", table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select("n_name"))
    return db.table("names").select(F.col("_row_id").alias("id"), F.lit(db.state["tables"]["names"]["sequence"] + 1).cast("long").alias("next_id"))


@query("SELECT n_name FROM nation WHERE n_regionkey % 2 = 1 AND n_regionkey * 10 > 10 OR n_regionkey % 2 = 0")
def sql_index_scan(spark, sf_dir):
    """Rows by a stored expression index; null is above every value."""
    db = _database(spark, sf_dir)
    db.execute("CREATE INDEX by_region ON nations (if(n_regionkey % 2 = 1, n_regionkey * 10, NULL))")
    return db.scan_index("nations", "by_region", ">", 10, descending=True).select("n_name")


@query("SELECT n_name, n_regionkey * 2 + 1 AS twice FROM nation")
def sql_functions(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE FUNCTION twice_and_one(n BIGINT) RETURNS BIGINT RETURN n * 2 + 1")
    return db.execute("SELECT n_name, twice_and_one(n_regionkey) AS twice FROM nations")


@query("SELECT (SELECT count(*) FROM nation)::BIGINT AS n, 1 AS refused")
def sql_transactions(spark, sf_dir):
    """A rolled-back deletion, and a late transaction that is refused."""
    db = _database(spark, sf_dir)
    db.begin()
    db.execute("DELETE FROM nations")
    db.execute("ROLLBACK")
    late, refused = SqlDatabase(spark, db.files.root), 0
    late.begin()
    late.execute("DELETE FROM nations WHERE n_nationkey = 1")
    db.execute("UPDATE regions SET r_name = lower(r_name)")
    try:
        late.commit()
    except RuntimeError:
        refused = 1
    return spark.createDataFrame([(db.table("nations").count(), refused)], "n long, refused int")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 1 THEN 'ours' WHEN n_nationkey = 2 THEN 'theirs' ELSE n_name END AS n_name FROM nation")
def sql_merge(spark, sf_dir):
    """Two branches that changed different rows, merged by key."""
    db = _database(spark, sf_dir)
    db.create_branch("side")
    db.execute("UPDATE nations SET n_name = 'ours' WHERE n_nationkey = 1")
    side = SqlDatabase(spark, db.files.root, "side")
    side.execute("UPDATE nations SET n_name = 'theirs' WHERE n_nationkey = 2")
    db.merge("side")
    return db.table("nations").select("n_nationkey", "n_name")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey = 4")
def sql_merge_violations(spark, sf_dir):
    """A merge whose result would break a foreign key: the rows, with the branch unmoved."""
    db = _database(spark, sf_dir)
    db.execute("INSERT INTO regions VALUES (9, 'SPARE')")
    db.execute("UPDATE nations SET n_regionkey = 9 WHERE n_regionkey = 4")
    db.create_branch("side")
    side = SqlDatabase(spark, db.files.root, "side")
    side.execute("DELETE FROM regions WHERE r_regionkey = 4")
    db.execute("UPDATE nations SET n_regionkey = 4 WHERE n_regionkey = 9")
    outcome, trouble = db.merge("side")
    return trouble["foreign key nations.n_regionkey"].select("n_nationkey", "n_regionkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'changed' AS kind, 'extra' AS added, 1 AS n_functions FROM nation WHERE n_regionkey = 2")
def sql_diff(spark, sf_dir):
    """The typed difference of two commits."""
    db = _database(spark, sf_dir)
    first = db.at
    db.execute("UPDATE nations SET n_name = upper(n_name) || '!' WHERE n_regionkey = 2")
    db.execute("CREATE TABLE extra (id BIGINT PRIMARY KEY)")
    db.execute("CREATE FUNCTION one() RETURNS INT RETURN 1")
    found = db.diff(first, db.at)
    return found["rows"]["nations"].select("n_nationkey", "kind", F.lit(",".join(found["added"])).alias("added"), F.lit(len(found["functions"])).alias("n_functions"))


@query("SELECT * FROM (VALUES ('nations', 'n_nationkey', 3, 25, 1), ('regions', 'r_regionkey', 2, 5, 0)) t(\"table\", key, n_columns, n_rows, n_indexes)")
def sql_table_meta(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.create_index("nations", "by_name", "n_name")
    return db.table_meta().withColumn("n_rows", F.col("n_rows").cast("int"))


@query("SELECT * FROM (VALUES (0, 'two'), (1, 'one'), (2, 'load')) t(depth, message)")
def sql_log(spark, sf_dir):
    db = _database(spark, sf_dir)
    for name in ("one", "two"):
        db.begin()
        db.execute(f"UPDATE regions SET r_name = concat(r_name, '{name}')")
        db.commit(name)
    return spark.createDataFrame([(i, m) for i, (_, m) in enumerate(db.log())], "depth int, message string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def sql_checkout(spark, sf_dir):
    """An old commit looked at, and the branch reset to it."""
    db = _database(spark, sf_dir)
    first = db.at
    db.execute("DELETE FROM nations")
    db.reset(first)
    return db.scan("nations").select("n_nationkey", "n_name")


# objects


def _repository(spark, sf_dir) -> ObjectRepository:
    repo = ObjectRepository(spark, fresh_path(spark, "objects"))
    names = {f"n/{r['n_name']}": r["n_name"].encode() for r in table(spark, sf_dir, "nation").collect()}
    repo.write(names)
    return repo


@query("SELECT 'n/' || n_name AS key, octet_length(encode(n_name))::BIGINT AS size, sha256(n_name) AS etag FROM nation")
def object_puts(spark, sf_dir):
    return _repository(spark, sf_dir).at().select("key", "size", "etag")


@query("SELECT 'n/' || n_name AS key, substr(n_name, 2, 3) AS part FROM nation WHERE n_nationkey < 3")
def object_ranges(spark, sf_dir):
    """Ranges of bytes of a few objects."""
    repo = _repository(spark, sf_dir)
    found = [f"n/{r['n_name']}" for r in table(spark, sf_dir, "nation").where("n_nationkey < 3").collect()]
    return spark.createDataFrame([(k, repo.read(k, start=1, end=4).decode()) for k in found], "key string, part string")


@query("SELECT 'n/' || n_name AS key FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'copy'")
def object_session(spark, sf_dir):
    """A copy and a deletion staged together and published as one commit."""
    repo = _repository(spark, sf_dir)
    name = table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    session = repo.session()
    session.put("copy", repo.read(f"n/{name}"))
    session.delete(f"n/{name}")
    session.publish()
    return repo.at().select("key")


@query("SELECT 'n/' || n_name AS key, n_nationkey = 4 AS ours FROM nation")
def object_merge_branches(spark, sf_dir):
    """Branches merged object by object; the conflict goes to our side."""
    repo = _repository(spark, sf_dir)
    name = "n/" + table(spark, sf_dir, "nation").where("n_nationkey = 4").first()["n_name"]
    repo.store.branch("side", repo.store.head())
    repo.write({name: b"ours"})
    repo.write({name: b"theirs"}, branch="side")
    if repo.merge("main", "side")[0] != "conflicts":
        raise RuntimeError("no conflict")
    repo.merge("main", "side", "ours")
    return repo.at().select("key", (F.col("payload").cast("string") == "ours").alias("ours"))


@query("SELECT * FROM (VALUES (0, 1), (1, 0)) t(depth, generation)")
def object_log(spark, sf_dir):
    """Commits behind a branch in pages, with every object whole."""
    repo = _repository(spark, sf_dir)
    repo.write({"extra": b"x"})
    if repo.check():
        raise RuntimeError("damaged objects")
    one, cursor = repo.log_page(1)
    two, _ = repo.log_page(5, cursor)
    return spark.createDataFrame([(i, v.generation) for i, v in enumerate(one + two)], "depth int, generation int")


# proofs and graphs


def _tree(spark, sf_dir) -> proofs.ProofTree:
    return proofs.ProofTree(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name")


@query("SELECT k::BIGINT AS c_custkey, sha256(c_name) AS digest FROM (VALUES (-5), (1), (64), (65), (100), (99999999)) t(k) LEFT JOIN customer ON c_custkey = k")
def proof_keys(spark, sf_dir):
    """Keys proven present, with their values' digests, or absent."""
    tree, wanted = _tree(spark, sf_dir), [-5, 1, 64, 65, 100, 99999999]
    found = [(k, proofs.verify_key(p, tree.root, k)) for k, p in zip(wanted, tree.prove_keys(wanted), strict=True)]
    return spark.createDataFrame([(k, d or None) for k, d in found if d is not False], "c_custkey long, digest string")


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer WHERE c_custkey >= 50 AND c_custkey < 300")
def proof_range(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return _rows(spark, proofs.verify_range(tree.prove_range(50, 300), tree.root), "c_custkey long, digest string")


@query("SELECT c_name AS key, sha256(c_custkey::VARCHAR) AS digest FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def proof_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").cast("string").alias("v"))
    tree = proofs.ProofTree(rows, "c_name", "v")
    return _rows(spark, proofs.verify_range(tree.prove_prefix("Customer#00000001"), tree.root), "key string, digest string")


@query(f"WITH {VERSIONS}, d AS ({DIFF} AND coalesce(base.k, l.k) >= 100 AND coalesce(base.k, l.k) < 700) SELECT k, kind FROM d")
def proof_diff(spark, sf_dir):
    """The difference of two versions inside a range, from two proofs."""
    old, new = (proofs.ProofTree(v, "k", "v") for v in (base_version(spark, sf_dir), left_version(spark, sf_dir)))
    found = proofs.verify_diff(old.prove_range(100, 700), new.prove_range(100, 700), old.root, new.root)
    return spark.createDataFrame(found, "k long, kind string")


@query("SELECT true AS valid, false AS late, false AS forged")
def proof_signed(spark, sf_dir):
    """A root under a signature with a validity window."""
    sealed = integrity.sign(_tree(spark, sf_dir).root.encode(), b"secret", 100, 200)
    checks = (integrity.verify_signature(sealed, b"secret", 150), integrity.verify_signature(sealed, b"secret", 201), integrity.verify_signature(sealed | {"payload": b"x"}, b"secret", 150))
    return spark.createDataFrame([checks], "valid boolean, late boolean, forged boolean")


def _graph(spark, sf_dir):
    """A binary tree over the first 1,000 parts: part n refers to 2n and 2n + 1; part 0 to itself alone."""
    part = table(spark, sf_dir, "part").where("p_partkey < 1000").select(F.col("p_partkey").alias("n"))
    top = part.agg(F.max("n")).first()[0]
    children = F.filter(F.array(F.col("n") * 2, F.col("n") * 2 + 1), lambda c: c <= top)
    return part.select(F.col("n").cast("string").alias("cid"), F.lit("node").alias("kind"), F.transform(children, lambda c: c.cast("string")).alias("children"))


GRAPH = "n AS (SELECT p_partkey AS n FROM part WHERE p_partkey < 1000), w AS (SELECT 3 AS n, 0 AS level UNION ALL SELECT c.n, w.level + 1 FROM w JOIN n c ON c.n = w.n * 2 OR c.n = w.n * 2 + 1)"


@query(f"WITH RECURSIVE {GRAPH} SELECT n::VARCHAR AS cid, level FROM w")
def content_walk(spark, sf_dir):
    return content.walk(_graph(spark, sf_dir), spark.createDataFrame([("3",)], "cid string")).select("cid", "level")


@query(f"WITH RECURSIVE {GRAPH} SELECT n::VARCHAR AS cid FROM n WHERE n NOT IN (SELECT n FROM w)")
def content_collection(spark, sf_dir):
    """Nodes that the retained root doesn't reach."""
    return content.plan_collection(_graph(spark, sf_dir), spark.createDataFrame([("3",)], "cid string"))


@query(f"WITH RECURSIVE {GRAPH} SELECT n::VARCHAR AS cid FROM w UNION SELECT n::VARCHAR FROM n WHERE n % 5 = 0")
def content_copy(spark, sf_dir):
    nodes = _graph(spark, sf_dir)
    return content.copy_graph(nodes, nodes.where("cid % 5 = 0"), spark.createDataFrame([("3",)], "cid string")).select("cid")


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE octet_length(encode(text)) > 4096 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def blob_collection(spark, sf_dir):
    """Blobs that no kept version refers to."""
    refs, blobs = values.split_large(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")))
    return values.reclaimable_blobs(blobs, refs.where("key % 4 = 0"), refs.where("key % 4 = 2"))


# feeds, files and stores


@query(f"WITH {VERSIONS} {DIFF}")
def feed_follow(spark, sf_dir):
    """Changes delivered by a stream of moves; started again, it delivers nothing twice."""
    store, first, _ = _grown(spark, sf_dir)
    seen, place = [], fresh_path(spark, "position")
    for _ in range(2):
        feed.follow(store, "v", place, lambda rows, at: seen.append(staged(rows, "delivered")), last_seen=first).awaitTermination(300)
    if len(seen) != 1:
        raise RuntimeError(f"{len(seen)} deliveries")
    return seen[0]


@query("SELECT user_id AS run, epoch_us(ts) AS ts, event_id AS sequence FROM events")
def event_log(spark, sf_dir):
    """Events appended in two batches and read back in order."""
    path = fresh_path(spark, "events")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("sequence"))
    feed.append_events(rows.where("sequence % 2 = 0"), path)
    feed.append_events(rows.where("sequence % 2 = 1"), path)
    return feed.load_events(spark, path)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 50, 'FIFTY'")
def sqlite_table(spark, sf_dir):
    """A table written to and read from SQLite over DB-API, by key ranges."""
    connect = _sqlite(_database_file(spark), "CREATE TABLE IF NOT EXISTS nations (n_nationkey INTEGER PRIMARY KEY, n_name TEXT)")
    connectors.write_dbapi(table(spark, sf_dir, "nation").where("n_nationkey <> 3").select("n_nationkey", "n_name"), connect, "nations", "n_nationkey")
    connectors.write_dbapi(spark.createDataFrame([(50, "FIFTY")], "n_nationkey long, n_name string"), connect, "nations", "n_nationkey")
    return connectors.read_dbapi(spark, connect, "nations", "n_nationkey", "n_nationkey long, n_name string", [10, 20])


def _database_file(spark) -> str:
    """A place for a SQLite file, which workers reach on a shared POSIX file system."""
    folder = fresh_path(spark, "sqlite").removeprefix("file://")
    os.makedirs(folder)
    return f"{folder}/one.db"


def _sqlite(path: str, statement: str):
    def connect():
        import sqlite3

        found = sqlite3.connect(path, timeout=60)
        found.execute(statement)
        return found

    return connect


@query("SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation WHERE n_nationkey % 4 <> 0")
def key_value_store(spark, sf_dir):
    """Pairs put into a key-value store, some deleted, and scanned by key ranges."""
    adapter = connectors.sqlite_adapter(_database_file(spark))
    pairs = table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("key"), F.col("n_nationkey").cast("string").cast("binary").alias("value"), "n_nationkey")
    connectors.put_pairs(pairs, adapter)
    connectors.put_pairs(pairs.where("n_nationkey % 4 = 0").select("key", F.lit(None).cast("binary").alias("value")), adapter)
    return connectors.scan_pairs(spark, adapter, [b"F", b"M"]).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT 'csv' AS kind, count(*)::BIGINT AS n, sum(n_nationkey)::BIGINT AS total FROM nation UNION ALL SELECT 'json', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'orc', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'parquet', count(*), sum(n_nationkey) FROM nation")
def file_formats(spark, sf_dir):
    """Sorted files of each format, read back."""
    found = None
    for kind in ("csv", "json", "orc", "parquet"):
        path = fresh_path(spark, kind)
        connectors.write_sorted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, "n_nationkey", 2, kind)
        one = connectors.read(spark, path, kind, "n_nationkey long, n_name string").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT i::BIGINT AS ordinal, n_nationkey::VARCHAR AS value FROM (VALUES (0, 'FRANCE'), (1, 'nowhere'), (2, 'JAPAN'), (3, 'FRANCE')) t(i, name) LEFT JOIN nation ON n_name = name")
def key_value_get(spark, sf_dir):
    """Pairs fetched in the order asked for, repeats kept, null where a key is missing."""
    adapter = connectors.sqlite_adapter(_database_file(spark))
    connectors.put_pairs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")), adapter)
    probes = spark.createDataFrame(list(enumerate(["FRANCE", "nowhere", "JAPAN", "FRANCE"])), "ordinal long, key string")
    return connectors.get_pairs(probes, adapter).select("ordinal", F.col("value").cast("string").alias("value"))


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def memory_table(spark, sf_dir):
    """A table that the cluster keeps."""
    return connectors.in_memory(table(spark, sf_dir, "nation")).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, 'U' AS v, 'upsert' AS op FROM orders WHERE o_orderkey IN (3, 8) UNION ALL SELECT 5, NULL, 'delete'")
def session_drain(spark, sf_dir):
    """What a session has buffered, taken out of it in key order."""
    store = _store(spark)
    store.commit(base_version(spark, sf_dir))
    session = WriteSession(store, most=3)
    for k in (8, 3):
        session.put(k, "U")
    session.delete(5)
    if not session.is_full():
        raise RuntimeError("the buffer should be full")
    return spark.createDataFrame([(k, row and row[1], "delete" if row is None else "upsert") for k, row in session.drain()], "k long, v string, op string")
