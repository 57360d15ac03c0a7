"""Registry of the engine's own queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import conditions, keys, values
from loomstone.operators import diff, history, index, integrity, merge, mutate, objects, proximity, scan, views
from loomstone.plans.fixtures import base_version, left_version, right_version, table
from loomstone.staging import staged
from loomstone.workers import reachable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VERSIONS = """
base AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders),
l AS (SELECT k, CASE WHEN k%10=0 THEN 'L' ELSE v END AS v FROM base WHERE k%7<>0
      UNION ALL SELECT -k AS k, 'NL' AS v FROM base WHERE k%50=0),
r AS (SELECT k, CASE WHEN k%20=0 THEN 'L' WHEN k%10=0 THEN 'R' WHEN k%11=0 THEN 'R2' ELSE v END AS v
      FROM base WHERE k%13<>0
      UNION ALL SELECT -k AS k, 'NR' AS v FROM base WHERE k%70=0),
al AS (SELECT coalesce(base.k, l.k, r.k) AS k, base.v AS b, l.v AS lv, r.v AS rv
       FROM base FULL OUTER JOIN l ON base.k = l.k FULL OUTER JOIN r ON coalesce(base.k, l.k) = r.k)
"""
DIFF = """
SELECT coalesce(base.k, l.k) AS k,
       CASE WHEN base.k IS NULL THEN 'added' WHEN l.k IS NULL THEN 'removed' ELSE 'changed' END AS kind,
       base.v AS old, l.v AS new
FROM base FULL OUTER JOIN l ON base.k = l.k
WHERE (base.k IS NULL OR l.k IS NULL OR base.v IS DISTINCT FROM l.v)"""
CONFLICT = "lv IS DISTINCT FROM b AND rv IS DISTINCT FROM b AND lv IS DISTINCT FROM rv"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return base_version(spark, sf_dir), left_version(spark, sf_dir), right_version(spark, sf_dir)


# comparison


@query(f"WITH {VERSIONS} {DIFF}")
def diff_versions(spark, sf_dir):
    return diff.diff_versions(base_version(spark, sf_dir), left_version(spark, sf_dir), ["k"], "v")


@query(f"WITH {VERSIONS} {DIFF}")
def diff_pruned(spark, sf_dir):
    return diff.pruned_diff(base_version(spark, sf_dir), left_version(spark, sf_dir), "k", "v")


@query(f"WITH {VERSIONS} {DIFF} AND coalesce(base.k, l.k) >= 1000 AND coalesce(base.k, l.k) < 9000")
def diff_range(spark, sf_dir):
    return diff.range_diff(base_version(spark, sf_dir), left_version(spark, sf_dir), "k", "v", 1000, 9000)


@query(f"WITH {VERSIONS} {DIFF} AND coalesce(base.k, l.k) > 100 ORDER BY 1 LIMIT 50")
def diff_page(spark, sf_dir):
    found = diff.range_diff(base_version(spark, sf_dir), left_version(spark, sf_dir), "k", "v", after=100)
    return found.orderBy("k").limit(50)


@query(f"WITH {VERSIONS} SELECT count(*)::BIGINT AS n_keys, sum(CASE WHEN b IS DISTINCT FROM rv THEN 1 ELSE 0 END)::BIGINT AS n_changed FROM al WHERE b IS NOT NULL OR rv IS NOT NULL")
def change_feed_counts(spark, sf_dir):
    base, _, right = _three(spark, sf_dir)
    changed = diff.diff_versions(base, right, ["k"], "v").agg(F.count("*").alias("n_changed"))
    n_keys = base.select("k").union(right.select("k")).distinct().agg(F.count("*").alias("n_keys"))
    return n_keys.join(changed)


@query(
    f"""WITH {VERSIONS} SELECT coalesce(base.k, r.k) AS k,
        CASE WHEN base.k IS NULL THEN 'added' WHEN r.k IS NULL THEN 'removed' ELSE 'changed' END AS kind, base.v AS old, r.v AS new
        FROM base FULL OUTER JOIN r ON base.k = r.k WHERE base.k IS NULL OR r.k IS NULL OR base.v IS DISTINCT FROM r.v"""
)
def change_feed(spark, sf_dir):
    """What a subscriber that saw the base sees at the right version: steps between are not shown."""
    base, _, right = _three(spark, sf_dir)
    return diff.diff_versions(base, right, ["k"], "v")


# merge


@query(f"WITH {VERSIONS} SELECT k, b AS base, lv AS \"left\", rv AS \"right\" FROM al WHERE {CONFLICT}")
def conflicts(spark, sf_dir):
    return merge.conflicts(*_three(spark, sf_dir), "k", "v")


def _merge_sql(conflict: str, where: str = "") -> str:
    return f"""WITH {VERSIONS}, m AS (SELECT k, CASE WHEN lv IS NOT DISTINCT FROM rv OR rv IS NOT DISTINCT FROM b THEN lv
        WHEN lv IS NOT DISTINCT FROM b THEN rv ELSE {conflict} END AS v FROM al {where}) SELECT k, v FROM m WHERE v IS NOT NULL"""


@query(_merge_sql("lv"))
def merge_prefer_left(spark, sf_dir):
    return merge.merge(*_three(spark, sf_dir), "k", "v", merge.prefer_left)


@query(_merge_sql("rv"))
def merge_prefer_right(spark, sf_dir):
    return merge.merge(*_three(spark, sf_dir), "k", "v", merge.prefer_right)


@query(_merge_sql("NULL"))
def merge_delete_wins(spark, sf_dir):
    return merge.merge(*_three(spark, sf_dir), "k", "v", merge.delete_wins, strict=False)


@query(_merge_sql("CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN coalesce(lv, rv) END"))
def merge_update_wins(spark, sf_dir):
    return merge.merge(*_three(spark, sf_dir), "k", "v", merge.update_wins, strict=False)


@query(_merge_sql("CASE WHEN k % 2 = 0 AND k < 5000 THEN rv WHEN k < 10000 THEN lv END"))
def merge_policy(spark, sf_dir):
    """Rules by key; the newest that matches decides."""
    policy = merge.Policy([]).where(lambda k: k < 10000, merge.prefer_left).where(lambda k: (k % 2 == 0) & (k < 5000), merge.prefer_right)
    return merge.merge(*_three(spark, sf_dir), "k", "v", policy, strict=False)


@query(
    f"""WITH {VERSIONS}, m AS (SELECT k, CASE WHEN NOT (k >= 2000 AND k < 6000) THEN lv
        WHEN lv IS NOT DISTINCT FROM rv OR rv IS NOT DISTINCT FROM b THEN lv WHEN lv IS NOT DISTINCT FROM b THEN rv ELSE lv END AS v FROM al)
        SELECT k, v FROM m WHERE v IS NOT NULL"""
)
def merge_prefix_range(spark, sf_dir):
    return merge.merge_range(*_three(spark, sf_dir), "k", "v", 2000, 6000, merge.prefer_left)


@query(
    f"""WITH {VERSIONS} SELECT CASE WHEN lv IS NOT DISTINCT FROM rv THEN 'same' WHEN rv IS NOT DISTINCT FROM b THEN 'take_left'
        WHEN lv IS NOT DISTINCT FROM b THEN 'take_right' WHEN lv IS NULL THEN 'conflict_delete' ELSE 'conflict_value' END AS decision,
        count(*)::BIGINT AS n FROM al GROUP BY 1"""
)
def merge_explain(spark, sf_dir):
    return merge.explain(*_three(spark, sf_dir), "k", "v", merge.prefer_left)


@query(
    """SELECT user_id, value, ts_us FROM (SELECT user_id, value, epoch_us(ts) AS ts_us,
       row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, value DESC) AS n FROM events) WHERE n = 1"""
)
def merge_lww(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return merge.lww_register(rows, ["user_id"], "value", "ts_us")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM events GROUP BY user_id")
def merge_multivalue(spark, sf_dir):
    sets = merge.multi_value(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return sets.select("user_id", F.array_join("event_type", ",").alias("event_types"))


# changes


@query(
    f"""WITH {VERSIONS} SELECT k, v FROM base WHERE k % 9 <> 0 AND k % 4 <> 0 UNION ALL SELECT k, 'U' AS v FROM base WHERE k % 4 = 0 AND k % 9 <> 0
        UNION ALL SELECT -k AS k, 'I' AS v FROM base WHERE k % 25 = 0"""
)
def batch_apply(spark, sf_dir):
    """Updates, then deletes that override them, then inserts, as one batch; the last change of a key counts."""
    base, k = base_version(spark, sf_dir), F.col("k")
    change = lambda rows, key, v, op, n: rows.select(key.alias("k"), F.lit(v).alias("v"), F.lit(op).alias("op"), F.lit(n).alias("n"))
    changes = change(base.where(k % 4 == 0), k, "U", "upsert", 1).unionAll(change(base.where(k % 9 == 0), k, None, "delete", 2)).unionAll(change(base.where(k % 25 == 0), -k, "I", "upsert", 3))
    return mutate.apply_batch(base, changes, "k", ordinal="n")


@query(f"WITH {VERSIONS} SELECT k, v FROM base WHERE NOT (k >= 500 AND k < 2500)")
def delete_range(spark, sf_dir):
    return mutate.delete_range(base_version(spark, sf_dir), "k", 500, 2500)


@query(f"WITH {VERSIONS} SELECT k, v FROM l")
def apply_patch(spark, sf_dir):
    base, left, _ = _three(spark, sf_dir)
    return mutate.apply_patch(base, diff.diff_versions(base, left, ["k"], "v"), "k", "v")


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"""
)
def last_write_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return mutate.last_write_wins(rows, ["user_id"], ["event_id"])


# scans and order statistics


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


COLUMNS = "o_orderkey, o_custkey, o_orderstatus"


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey > 100 AND o_orderkey < 5000 ORDER BY o_orderkey LIMIT 100")
def range_page(spark, sf_dir):
    return scan.scan(_orders(spark, sf_dir), "o_orderkey", end=5000, after=100).limit(100)


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 100")
def reverse_page(spark, sf_dir):
    return scan.scan(_orders(spark, sf_dir), "o_orderkey", start=100, end=5000, descending=True).limit(100)


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 4000")
def range_scan(spark, sf_dir):
    return scan.scan(_orders(spark, sf_dir), "o_orderkey", 1000, 4000)


@query("SELECT c_name, c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name LIMIT 20")
def prefix_page(spark, sf_dir):
    return scan.scan_prefix(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001").limit(20)


@query("SELECT count(*)::BIGINT AS rank FROM orders WHERE o_orderkey < 7777")
def rank(spark, sf_dir):
    return scan.rank(_orders(spark, sf_dir), "o_orderkey", 7777)


@query(f"SELECT {COLUMNS} FROM orders ORDER BY o_orderkey OFFSET 123 LIMIT 1")
def select_ordinal(spark, sf_dir):
    return scan.select(_orders(spark, sf_dir), "o_orderkey", 123)


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey >= 501 ORDER BY o_orderkey LIMIT 1")
def lower_bound(spark, sf_dir):
    return scan.lower_bound(_orders(spark, sf_dir), "o_orderkey", 501)


@query(f"SELECT {COLUMNS} FROM orders WHERE o_orderkey > 501 ORDER BY o_orderkey LIMIT 1")
def upper_bound(spark, sf_dir):
    return scan.upper_bound(_orders(spark, sf_dir), "o_orderkey", 501)


@query(
    """SELECT min(o_orderkey) AS first_key, arg_min(o_orderstatus, o_orderkey) AS first_value,
       max(o_orderkey) AS last_key, arg_max(o_orderstatus, o_orderkey) AS last_value FROM orders"""
)
def first_last(spark, sf_dir):
    return scan.first_last(_orders(spark, sf_dir), "o_orderkey", "o_orderstatus")


@query(
    f"""SELECT {COLUMNS}, (SELECT coalesce(max(CASE WHEN o_orderkey <= 333 THEN o_orderkey END), min(CASE WHEN o_orderkey > 333 THEN o_orderkey END)) FROM orders) AS position,
        EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 333) AS found FROM orders WHERE o_orderkey >= 333 ORDER BY o_orderkey LIMIT 10"""
)
def cursor_window(spark, sf_dir):
    return scan.cursor_window(_orders(spark, sf_dir), "o_orderkey", 333, 10)


@query(
    """WITH p AS (SELECT i::BIGINT AS ordinal, CASE WHEN i % 3 = 0 THEN -1 ELSE (i * 37) % 5000 END::BIGINT AS o_orderkey FROM range(200) t(i))
       SELECT ordinal, p.o_orderkey, o_orderstatus FROM p LEFT JOIN orders USING (o_orderkey)"""
)
def get_many(spark, sf_dir):
    probe = F.when(F.col("id") % 3 == 0, -1).otherwise((F.col("id") * 37) % 5000).cast("long")
    probes = spark.range(200).select(F.col("id").alias("ordinal"), probe.alias("o_orderkey"))
    return scan.get_many(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderkey", probes)


@query("SELECT n_nationkey, lpad(to_hex(n_nationkey::UBIGINT + 9223372036854775808::UBIGINT), 16, '0') AS key_hex FROM nation")
def key_i64(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", keys.printable(keys.i64_key(F.col("n_nationkey"))).alias("key_hex"))


@query("SELECT n_nationkey, lpad(to_hex(n_nationkey::UBIGINT), 16, '0') AS key_hex FROM nation")
def key_u64(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", keys.printable(keys.u64_key(F.col("n_nationkey"))).alias("key_hex"))


@query("SELECT n_nationkey, hex(encode(n_name)) || '0000' || hex(encode('r' || n_regionkey)) || '0000' AS key_hex FROM nation")
def key_segments(spark, sf_dir):
    composite = keys.segments(F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", keys.printable(composite).alias("key_hex"))


# aggregates


@query(
    """SELECT count(*)::BIGINT AS n_entries, min(octet_length(encode(doc_id::VARCHAR)))::BIGINT AS key_min_bytes, max(octet_length(encode(doc_id::VARCHAR)))::BIGINT AS key_max_bytes,
       sum(octet_length(encode(doc_id::VARCHAR)))::BIGINT AS key_total_bytes, min(octet_length(encode(text)))::BIGINT AS value_min_bytes,
       max(octet_length(encode(text)))::BIGINT AS value_max_bytes, sum(octet_length(encode(text)))::BIGINT AS value_total_bytes,
       avg(octet_length(encode(doc_id::VARCHAR))) AS key_avg_bytes, avg(octet_length(encode(text))) AS value_avg_bytes FROM documents"""
)
def tree_stats(spark, sf_dir):
    return scan.stats(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.col("text"))


@query(
    """WITH a AS (SELECT count(*)::DOUBLE AS n_entries, sum(octet_length(encode(o_orderstatus)))::DOUBLE AS value_total_bytes FROM orders),
       b AS (SELECT count(*)::DOUBLE AS n_entries, sum(octet_length(encode(o_orderstatus)))::DOUBLE AS value_total_bytes FROM orders WHERE o_orderkey % 3 <> 0),
       t AS (SELECT 'n_entries' AS field, a.n_entries AS before, b.n_entries AS after FROM a, b UNION ALL SELECT 'value_total_bytes', a.value_total_bytes, b.value_total_bytes FROM a, b)
       SELECT field, before, after, after - before AS change, (after - before) * 100 / before AS percent FROM t"""
)
def stats_change(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    measure = lambda r: scan.stats(r, F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    return views.stats_change(measure(rows), measure(rows.where(F.col("o_orderkey") % 3 != 0)), ["n_entries", "value_total_bytes"])


def _priced(spark, sf_dir, factor=None):
    key = F.col("o_orderkey")
    amount = views.cents(F.col("o_totalprice"))
    status = F.col("o_orderstatus")
    if factor:
        amount, status = F.when(key % 5 == 0, amount + factor).otherwise(amount), F.when(key % 8 == 0, F.lit("X")).otherwise(status)
    rows = table(spark, sf_dir, "orders").select(key, status.alias("status"), amount.alias("cents"))
    return rows.where(key % 17 != 0) if factor else rows


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n_rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY 1")
def view_full(spark, sf_dir):
    return views.view(_priced(spark, sf_dir), ["status"], "cents")


@query(
    """SELECT CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS status, count(*)::BIGINT AS n_rows,
       sum(round(o_totalprice * 100)::BIGINT + CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 0 END)::BIGINT AS total FROM orders WHERE o_orderkey % 17 <> 0 GROUP BY 1"""
)
def view_incremental(spark, sf_dir):
    old, new = _priced(spark, sf_dir), _priced(spark, sf_dir, 1000)
    packed = lambda r: r.select("o_orderkey", F.struct("status", "cents").alias("row"))
    changes = diff.diff_versions(packed(old), packed(new), ["o_orderkey"], "row")
    return views.maintain(views.view(old, ["status"], "cents"), changes, ["status"], "cents")


@query(
    """SELECT user_id, event_id, event_type, 1::BIGINT AS n_events FROM events WHERE NOT (event_id BETWEEN 100 AND 5000)
       UNION ALL SELECT user_id, min(event_id), 'summary', count(*)::BIGINT FROM events WHERE event_id BETWEEN 100 AND 5000 GROUP BY user_id"""
)
def compact_events(spark, sf_dir):
    return views.compact_window(table(spark, sf_dir, "events"), "user_id", "event_id", 100, 5000, "event_type", "summary")


@query("SELECT event_id, expires FROM (SELECT event_id, (epoch_us(ts) // 1000000)::BIGINT AS expires FROM events) WHERE expires <= 1706000000 AND expires >= 1706000000 - 157680000")
def ttl_candidates(spark, sf_dir):
    expires = F.unix_seconds(F.col("ts").cast("timestamp"))
    return views.ttl_candidates(table(spark, sf_dir, "events").select("event_id", expires.alias("expires")), "expires", 1706000000)


@query(
    """SELECT doc_id, score FROM (SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'public')::INT + contains(lower(text), 'the')::INT)::BIGINT AS score FROM documents)
       WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25"""
)
def rag_term_overlap(spark, sf_dir):
    return views.term_overlap(table(spark, sf_dir, "documents"), "doc_id", "text", "The public License", 25)


# secondary indexes


def _segments(spark, sf_dir):
    return index.build(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_mktsegment"), "c_nationkey")


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_exact(spark, sf_dir):
    return index.exact(_segments(spark, sf_dir), "BUILDING")


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey FROM customer WHERE c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'AU%'")
def index_prefix(spark, sf_dir):
    entries = _segments(spark, sf_dir)
    return index.prefix(entries, "B").unionByName(index.prefix(entries, "AU"))


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey FROM customer WHERE c_mktsegment >= 'B' AND c_mktsegment < 'I'")
def index_range(spark, sf_dir):
    return index.term_range(_segments(spark, sf_dir), "B", "I")


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey FROM customer ORDER BY 1 DESC, 2 DESC LIMIT 40")
def index_reverse(spark, sf_dir):
    return index.term_range(_segments(spark, sf_dir), descending=True).limit(40)


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS term, c_custkey AS pk, c_nationkey FROM customer")
def index_maintained(spark, sf_dir):
    """An index after its source changed, from the changes only."""
    source, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    moved = source.where(key % 4 == 0)
    after = index.build(moved.withColumn("c_mktsegment", F.lit("MOVED")), "c_custkey", F.col("c_mktsegment"), "c_nationkey")
    return index.apply_diff(_segments(spark, sf_dir), index.build(moved, "c_custkey", F.col("c_mktsegment"), "c_nationkey"), after)


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey FROM customer WHERE c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND c_custkey > 500) ORDER BY 1, 2 LIMIT 30")
def index_page(spark, sf_dir):
    return index.page(_segments(spark, sf_dir), 30, ("BUILDING", 500))


@query("SELECT o_orderpriority AS term, o_orderkey AS pk FROM orders WHERE o_orderstatus = 'P'")
def index_sparse(spark, sf_dir):
    return index.build(table(spark, sf_dir, "orders"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))


@query("SELECT o_custkey || '|' || o_orderstatus AS term, o_orderkey AS pk, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def index_covering(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("cents", views.cents(F.col("o_totalprice")))
    return index.build(rows, "o_orderkey", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus"), "cents")


@query(r"SELECT term, count(*)::BIGINT AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY term")
def index_tokens(spark, sf_dir):
    entries = index.build(table(spark, sf_dir, "documents"), "doc_id", index.normalized_tokens(F.col("text")), many=True)
    return entries.groupBy("term").agg(F.count("*").alias("n_docs"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term, p_partkey AS pk FROM part")
def index_multivalue(spark, sf_dir):
    return index.build(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "), many=True)


@query("SELECT c_custkey AS pk, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def index_join_back(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return index.join_back(index.exact(_segments(spark, sf_dir), "MACHINERY"), source, "c_custkey").select("pk", "c_name")


@query("SELECT c_mktsegment AS term, c_custkey AS pk, c_nationkey, CASE WHEN c_custkey % 100 = 0 THEN 'missing' ELSE 'surplus' END AS problem FROM customer WHERE c_custkey % 100 IN (0, 1)")
def index_verify(spark, sf_dir):
    """A damaged index against a fresh build: some entries lost, some of rows that are gone."""
    entries, key = _segments(spark, sf_dir), F.col("pk")
    return index.verify(entries.where(key % 100 != 0), entries.where(key % 100 != 1))


# documents and conditions


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("note"))


DOCS = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN event_type END AS note FROM events)"


def _filtered(spark, sf_dir, text, names=None, values=None):
    rows = _events(spark, sf_dir)
    fields = {c: F.col(c) for c in rows.columns}
    return rows.where(conditions.condition(text, fields, names, values)).select("event_id")


def _condition_query(name: str, text: str, sql: str, names=None, values=None) -> None:
    def run(spark, sf_dir):
        return _filtered(spark, sf_dir, text, names, values)

    run.__name__ = f"doc_filter_{name}"
    query(f"SELECT event_id FROM {DOCS} WHERE {sql}")(run)


_condition_query("compare", "#v >= :low AND user_id < :u", "value >= 50 AND user_id < 100", {"#v": "value"}, {":low": 50.0, ":u": 100})
_condition_query("not_missing", "NOT note = :n", "NOT coalesce(note = 'click', false)", None, {":n": "click"})
_condition_query("unequal_missing", "note <> :n", "coalesce(note <> 'click', false)", None, {":n": "click"})
_condition_query("between", "value BETWEEN :a AND :b", "value BETWEEN 10 AND 20", None, {":a": 10.0, ":b": 20.0})
_condition_query("in", "event_type IN (:a, :b)", "event_type IN ('click', 'view')", None, {":a": "click", ":b": "view"})
_condition_query("exists", "attribute_exists(note) OR NOT attribute_not_exists(note)", "note IS NOT NULL")
_condition_query("begins_with", "begins_with(event_type, :p)", "starts_with(event_type, 'p')", None, {":p": "p"})
_condition_query("contains", "contains(event_type, :p)", "contains(event_type, 'i')", None, {":p": "i"})
_condition_query("size", "size(event_type) > :n AND NOT (user_id = :u OR value < :v)", "octet_length(encode(event_type)) > 4 AND NOT (user_id = 5 OR value < 30)", None, {":n": 4, ":u": 5, ":v": 30.0})


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn >= 1")
def doc_key_condition(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    fields = {c: F.col(c) for c in rows.columns}
    found = conditions.key_condition("conv_id = :c AND turn >= :t", "conv_id", "turn", fields, {":c": 3, ":t": 1})
    return rows.where(found).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations")
def doc_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(*conditions.projection("conv_id, #t, role", {c: F.col(c) for c in rows.columns}, {"#t": "turn"}))


@query("SELECT event_id, user_id + 1000 AS user_id, coalesce(note, 'none') AS note, NULL::VARCHAR AS event_type FROM " + DOCS)
def doc_update(spark, sf_dir):
    rows = _events(spark, sf_dir)
    new = conditions.update("SET note = if_not_exists(note, :n), user_id = user_id + :k REMOVE event_type", {c: F.col(c) for c in rows.columns}, {"event_id"}, None, {":n": "none", ":k": 1000})
    return rows.select("event_id", new["user_id"].alias("user_id"), new["note"].alias("note"), new["event_type"].cast("string").alias("event_type"))


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey > 50 ORDER BY o_orderkey LIMIT 200) WHERE o_orderstatus = 'F'")
def doc_query_limit_then_filter(spark, sf_dir):
    """The limit counts rows before the filter."""
    page = scan.scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", after=50).limit(200)
    return page.where(F.col("o_orderstatus") == "F")


# vectors

QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
PAIR = "list_transform(list_zip(e.embedding, q.embedding), lambda p: {})"


def _query_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# Settings of the approximate searches: cells and product codes as built, probes and rerank depth by measured recall.
CELLS, PROBES = 32, 24
PARTS, CENTROIDS, RERANK, RERANK_SHARE = 8, 256, 32, 0.05

L2 = PAIR.format("(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)")
DOT = PAIR.format("p[1]::DOUBLE * p[2]::DOUBLE")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumn("distance", F.round("distance", digits) + 0.0)


@query(f"SELECT e.vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q ORDER BY list_sum({L2}), 1 LIMIT 10")
def knn_l2(spark, sf_dir):
    return _rounded(proximity.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10))


@query(f"SELECT e.vec_id, round(-list_sum({DOT}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q ORDER BY -list_sum({DOT}), 1 LIMIT 10")
def knn_ip(spark, sf_dir):
    return _rounded(proximity.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10, "inner_product"))


@query(
    f"""SELECT vec_id, round(d, 9) + 0.0 AS distance FROM (SELECT e.vec_id, 1.0 - list_sum({DOT})
        / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS d
        FROM embeddings e, {QUERY} q) ORDER BY d, vec_id LIMIT 10"""
)
def knn_cosine(spark, sf_dir):
    return _rounded(proximity.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10, "cosine"))


@query(f"SELECT e.vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q WHERE e.label = 1 ORDER BY list_sum({L2}), 1 LIMIT 10")
def knn_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    eligible = vectors.where("label = 1").select("vec_id")
    return _rounded(proximity.nearest_eligible(vectors, eligible, "vec_id", "embedding", _query_vector(spark, sf_dir), 10))


@query(
    f"""SELECT query, vec_id, round(d, 9) + 0.0 AS distance, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id)::INT AS n FROM (
        SELECT q.vec_id AS query, e.vec_id, list_sum({L2}) AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE n <= 5"""
)
def knn_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries_ = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("target"))
    return _rounded(proximity.nearest_for_each(vectors, queries_, "vec_id", "embedding", 5))


@query()
def knn_sq8(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    codes = staged(proximity.encode_sq8(vectors, "vec_id", "embedding"), "sq8-codes")
    return _rounded(proximity.nearest_sq8(codes, vectors, "vec_id", "embedding", _query_vector(spark, sf_dir), 10))


@query()
def knn_cells(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = proximity.train_cells(vectors, "embedding", CELLS)
    return _rounded(proximity.nearest_in_cells(proximity.assign_cells(vectors, "embedding", model), "vec_id", "embedding", model, _query_vector(spark, sf_dir), 10, PROBES))


@query(f"SELECT e.vec_id, round(list_sum({L2}), 9) + 0.0 AS distance FROM embeddings e, {QUERY} q WHERE e.vec_id % 10 <> 3 ORDER BY list_sum({L2}), 1 LIMIT 10")
def knn_composite(spark, sf_dir):
    """A base with stale and removed vectors under newer ones: the same as a clean rebuild."""
    vectors, key = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id")
    stale = vectors.withColumn("embedding", F.when(key % 10 == 1, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")))
    removed = vectors.where(key % 10 == 3)
    return _rounded(proximity.nearest_composite(stale, vectors.where(key % 10 == 1), removed, "vec_id", "embedding", _query_vector(spark, sf_dir), 10))


@query()
def knn_pq(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = proximity.train_product_quantizer(vectors, "embedding", PARTS, CENTROIDS)
    encoded = staged(proximity.encode_product(vectors, "embedding", models), "knn_pq")
    return _rounded(proximity.nearest_product(encoded, "vec_id", "embedding", models, _query_vector(spark, sf_dir), 10, RERANK, RERANK_SHARE))


# loads and values


@query("SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def build_entries(spark, sf_dir):
    """Unsorted entries with repeated keys: the last of a key stays."""
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("o"), F.col("user_id").alias("k"), F.col("event_type").alias("v"))
    return mutate.build(entries, "k", "o", 4)


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders")
def build_sorted(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return mutate.build_sorted(entries, "k", "o")


@query("SELECT doc_id AS key, sha256(text) AS value_sha FROM documents")
def large_values(spark, sf_dir):
    """Values over the threshold go through the blob table and come back."""
    refs, blobs = values.split_large(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")))
    return values.join_large(refs, blobs).select("key", F.sha2("value", 256).alias("value_sha"))


@query("SELECT sha256(text) AS cid, octet_length(encode(text))::BIGINT AS n_bytes, count(*)::BIGINT AS n_refs FROM documents WHERE octet_length(encode(text)) > 4096 GROUP BY 1, 2")
def large_value_refs(spark, sf_dir):
    refs, _ = values.split_large(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")))
    return refs.where("cid IS NOT NULL").groupBy("cid", "n_bytes").agg(F.count("*").alias("n_refs"))


@query("SELECT event_id, event_type, user_id FROM events")
def json_round_trip(spark, sf_dir):
    """Typed values through their JSON encoding."""
    rows = table(spark, sf_dir, "events").select("event_id", values.encode_json(F.struct("event_type", "user_id")).alias("value"))
    return rows.select("event_id", values.decode_json(F.col("value"), "event_type string, user_id bigint").alias("d")).select("event_id", "d.event_type", "d.user_id")


@query("SELECT user_id, event_type AS value, epoch_us(ts) AS micros FROM events")
def timestamped_values(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", values.with_timestamp(F.col("event_type"), micros).alias("s"))
    return rows.select("user_id", values.bytes_of(F.col("s")).cast("string").alias("value"), values.timestamp_of(F.col("s")).alias("micros"))


# history


def _edges(spark, sf_dir):
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    one = nation.where(key > 0).select(key.alias("child"), (key - 1).alias("parent"))
    return one.unionAll(nation.where(key > 1).select(key.alias("child"), F.floor(key / 2).cast("int").alias("parent"))).distinct()


EDGES = """e AS (SELECT n_nationkey AS child, n_nationkey - 1 AS parent FROM nation WHERE n_nationkey > 0
    UNION SELECT n_nationkey, (n_nationkey // 2)::INT FROM nation WHERE n_nationkey > 1)"""


def _walk(name: str, start: int) -> str:
    return f"{name} AS (SELECT {start}::INT AS id, 0 AS depth UNION SELECT e.parent, {name}.depth + 1 FROM {name} JOIN e ON e.child = {name}.id WHERE {name}.depth < 30)"


@query(f"WITH RECURSIVE {EDGES}, {_walk('w', 20)} SELECT id, min(depth) AS depth FROM w GROUP BY id ORDER BY 2, 1 LIMIT 12")
def history_log(spark, sf_dir):
    return history.log(spark, _edges(spark, sf_dir), "20", 12)


@query(f"WITH RECURSIVE {EDGES}, {_walk('a', 21)}, {_walk('b', 18)}, x AS (SELECT id, min(depth) AS d FROM a GROUP BY id), y AS (SELECT id, min(depth) AS d FROM b GROUP BY id) SELECT id, x.d AS d_a, y.d AS d_b, id AS generation FROM x JOIN y USING (id) ORDER BY id DESC LIMIT 1")
def merge_base(spark, sf_dir):
    commits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("generation"))
    return history.merge_base(spark, commits, _edges(spark, sf_dir), "21", "18")


VERSION_LIST = "(SELECT n_name AS id, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 7) % 11 END AS created_at FROM nation)"


@query(f"SELECT id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM {VERSION_LIST}) WHERE n <= 6 OR id = (SELECT min(n_name) FROM nation)")
def versions_retention(spark, sf_dir):
    key, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    listed = nation.select(F.col("n_name").alias("id"), F.when(key % 5 != 0, (key * 7) % 11).alias("created_at"))
    return history.retained(listed, 6, nation.agg(F.min("n_name")).first()[0])


# integrity


@query("SELECT o_custkey, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_violation(spark, sf_dir):
    return integrity.unique_violations(table(spark, sf_dir, "orders").select("o_custkey"), ["o_custkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_violation(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0)
    return integrity.foreign_key_violations(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", parents, "c_custkey")


def _chunks(spark, sf_dir, where):
    return table(spark, sf_dir, "part").where(where).select(F.sha2(F.concat(F.col("p_partkey").cast("string"), "p_name"), 256).alias("cid"))


@query("SELECT DISTINCT sha256(p_partkey || p_name) AS cid FROM part WHERE p_partkey % 3 <> 0")
def sync_missing(spark, sf_dir):
    return integrity.missing(_chunks(spark, sf_dir, "true"), _chunks(spark, sf_dir, "p_partkey % 3 = 0"))


@query("SELECT DISTINCT sha256(p_partkey || p_name) AS cid FROM part WHERE p_size > 10 AND p_partkey % 2 <> 0")
def gc_reclaimable(spark, sf_dir):
    return integrity.reclaimable(_chunks(spark, sf_dir, "p_size > 10"), _chunks(spark, sf_dir, "p_partkey % 2 = 0"))


# objects


def _objects(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key"), "page_id")


@query("SELECT url AS key, page_id FROM pages WHERE starts_with(url, 'http') ORDER BY url, page_id LIMIT 40")
def list_objects(spark, sf_dir):
    return objects.list_objects(_objects(spark, sf_dir), "http").orderBy("key", "page_id").limit(40)


@query(
    """WITH o AS (SELECT DISTINCT url AS key FROM pages WHERE starts_with(url, 'https://') ORDER BY 1 LIMIT 100)
       SELECT CASE WHEN position('/' IN substr(key, 9)) > 0 THEN substr(key, 1, 8 + position('/' IN substr(key, 9))) ELSE key END AS entry,
       CASE WHEN position('/' IN substr(key, 9)) > 0 THEN 'prefix' ELSE 'object' END AS kind, count(*)::BIGINT AS n_objects FROM o GROUP BY 1, 2"""
)
def list_delimited(spark, sf_dir):
    return objects.list_delimited(_objects(spark, sf_dir).select("key").distinct(), "https://", "/", 100)


HISTORY = "(SELECT user_id AS key, event_id AS version_id, (event_id % 50)::INT AS generation, event_type = 'error' OR event_id % 7 = 0 AS deleted FROM events)"


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    deleted = (F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("version_id"), (F.col("event_id") % 50).cast("int").alias("generation"), deleted.alias("deleted"))


@query(f"SELECT key, version_id, generation, deleted, n AS nth FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY generation DESC, version_id DESC)::INT AS n FROM {HISTORY}) WHERE n <= 3")
def object_versions(spark, sf_dir):
    return objects.versions(_history(spark, sf_dir), 3)


@query(f"SELECT key, version_id, generation, deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY generation DESC, version_id DESC) AS n FROM {HISTORY}) WHERE n = 1 AND NOT deleted")
def object_live(spark, sf_dir):
    return objects.live(_history(spark, sf_dir))


def _named(rows):
    return rows.select(F.col("k").alias("key"), F.col("v").alias("version_id"))


@query(f"WITH {VERSIONS} SELECT coalesce(base.k, l.k) AS key, base.v AS from_version, l.v AS to_version FROM base FULL OUTER JOIN l ON base.k = l.k WHERE base.v IS DISTINCT FROM l.v")
def object_diff(spark, sf_dir):
    return objects.object_diff(_named(base_version(spark, sf_dir)), _named(left_version(spark, sf_dir)))


@query(_merge_sql("rv").replace("SELECT k, v FROM m", "SELECT k AS key, v AS version_id FROM m"))
def object_merge(spark, sf_dir):
    return objects.merge_objects(*map(_named, _three(spark, sf_dir)), "theirs")[0]


def queries() -> dict[str, Query]:
    """All queries by name."""
    from loomstone.plans import surfaces  # noqa: F401  registers its own

    return {name: (lambda spark, sf_dir, run=run: run(reachable(spark), sf_dir)) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that have one."""
    queries()
    return dict(SQL)
