"""The version store, its feed and the registered queries."""

import duckdb
import pytest

from loomstone.operators import merge
from loomstone.plans import catalog
from loomstone.sources import connectors
from loomstone.sources.store import StaleRef, VersionStore
from loomstone.streaming import feed

KV = "k long, v string"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"), "k")


def frame(spark, **rows):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in rows.items()], KV)


def as_dict(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_commits_and_time_travel(spark, store):
    outcome, one = store.commit(frame(spark, _1="active"))
    assert outcome == "applied" and store.commit(frame(spark, _1="active"))[0] == "unchanged"
    pinned = store.snapshot(one.id)
    _, two = store.commit(frame(spark, _1="disabled"))
    assert as_dict(pinned) == {1: "active"} and as_dict(store.snapshot(store.head())) == {1: "disabled"}
    with pytest.raises(StaleRef):
        store.commit(frame(spark, _1="late"), expected=one.id)
    store.rollback(one.id)
    assert store.head() == one.id and len(store.versions()) >= 2 and two.parents == (one.id,)


def test_merges_move_the_ref_only_without_conflicts(spark, store):
    _, base = store.commit(frame(spark, _1="a", _2="b"))
    store.branch("side", base.id)
    store.commit(frame(spark, _1="left", _2="b", _3="c"))
    store.commit(frame(spark, _1="right", _2="b", _4="d"), ref="side")
    before = store.head()
    outcome, found = store.merge("main", store.head("side"), "v")
    assert outcome == "conflicts" and store.head() == before and [r["k"] for r in found.collect()] == [1]
    outcome, merged = store.merge("main", store.head("side"), "v", merge.prefer_right)
    assert outcome == "applied" and as_dict(store.snapshot(merged.id)) == {1: "right", 2: "b", 3: "c", 4: "d"}
    assert store.merge_base(merged.id, base.id) == base.id


def test_feed_retention_and_backup(spark, store, tmp_path):
    _, one = store.commit(frame(spark, _1="a"))
    _, two = store.commit(frame(spark, _1="b"))
    _, three = store.commit(frame(spark, _1="c", _2="x"))
    head, changes = store.poll(one.id, "v")
    assert head == three.id and sorted(map(tuple, changes.collect())) == [(1, "changed", "a", "c"), (2, "added", None, "x")]
    assert store.poll(three.id, "v") is None
    seen = []
    feed.follow(store, "v", str(tmp_path / "check"), lambda rows, at: seen.append((at, rows.count())), last_seen=two.id).awaitTermination(120)
    assert seen == [(three.id, 2)]
    store.backup(str(tmp_path / "backup"))
    assert set(store.prune(keep_last=1)) == {one.id, two.id} and store.sweep() >= 2 and as_dict(store.snapshot(three.id)) == {1: "c", 2: "x"}
    with pytest.raises(KeyError, match="pruned"):
        store.poll(one.id, "v")
    other = VersionStore(spark, str(tmp_path / "other"), "k")
    other.restore(str(tmp_path / "backup"))
    assert len(other.versions()) == 3 and other.head() == three.id


def test_connectors(spark, tmp_path):
    rows = frame(spark, _3="c", _1="a", _2="b")
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        connectors.write_sorted(rows, path, "k", 2, kind)
        assert as_dict(connectors.read(spark, path, kind, KV)) == as_dict(rows)


def test_every_query_matches_its_sql(spark, sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, run in catalog.queries().items():
        found = run(spark, sf_dir)
        if name not in catalog.oracle_sql():
            assert found.count() > 0
            continue
        cursor = connection.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(found.columns), name
        plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
        assert plain(found.select(*columns).collect()) == plain(cursor.fetchall()), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_window(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:20", "a", 2.0), ("2024-01-01 00:06:00", "b", 3.0)], "ts string, kind string, value double").selectExpr("cast(ts as timestamp) ts", "kind", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = feed.windowed_counts(stream, "ts", "kind", "5 minutes", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
