"""Databases and key-value stores, on SQLite and on a store made for the test."""

import sqlite3

from loomstone.sources import connectors
from loomstone.sources.connectors import Adapter


def test_tables_over_dbapi(spark, tmp_path):
    path = str(tmp_path / "t.db")
    sqlite3.connect(path).execute("CREATE TABLE things (k INTEGER PRIMARY KEY, v TEXT)").connection.commit()
    rows = spark.range(2500).selectExpr("id as k", "concat('v', id) as v")
    connect = lambda: sqlite3.connect(path, timeout=60)
    assert connectors.write_dbapi(rows, connect, "things", "k") == 2500
    connectors.write_dbapi(spark.createDataFrame([(7, "seven"), (9999, "new")], "k long, v string"), connect, "things", "k")
    found = connectors.read_dbapi(spark, connect, "things", "k", "k long, v string", [1000, 2000])
    assert found.rdd.getNumPartitions() == 3
    got = {r["k"]: r["v"] for r in found.collect()}
    assert len(got) == 2501 and got[7] == "seven" and got[9999] == "new" and got[2000] == "v2000"


def test_sqlite_as_a_key_value_store(spark, tmp_path):
    adapter = connectors.sqlite_adapter(str(tmp_path / "kv.db"))
    pairs = spark.range(3000).selectExpr("cast(lpad(id, 6, '0') as binary) as key", "cast(concat('v', id) as binary) as value")
    assert connectors.put_pairs(pairs, adapter) == 3000
    connectors.put_pairs(spark.createDataFrame([(b"000001", None), (b"000002", b"two")], "key binary, value binary"), adapter)
    probes = spark.createDataFrame([(0, b"000002"), (1, b"000001"), (2, b"000003"), (3, b"000002")], "ordinal long, key binary")
    assert [r["value"] and bytes(r["value"]) for r in connectors.get_pairs(probes, adapter).collect()] == [b"two", None, b"v3", b"two"]
    scanned = connectors.scan_pairs(spark, adapter, [b"001000", b"002000"])
    assert scanned.count() == 2999 and scanned.rdd.getNumPartitions() == 3


def test_any_store_through_an_adapter(spark, tmp_path):
    """Files named by key, one folder."""
    root = str(tmp_path)

    def get_many(at, keys):
        from pathlib import Path

        return [Path(at, k.hex()).read_bytes() if Path(at, k.hex()).exists() else None for k in keys]

    def put_many(at, pairs):
        from pathlib import Path

        for k, v in pairs:
            Path(at, k.hex()).unlink(missing_ok=True) if v is None else Path(at, k.hex()).write_bytes(v)

    def scan(at, start, end):
        from pathlib import Path

        for p in sorted(Path(at).iterdir()):
            key = bytes.fromhex(p.name)
            if (start is None or key >= start) and (end is None or key < end):
                yield key, p.read_bytes()

    adapter = Adapter(lambda: root, get_many, put_many, scan)
    connectors.put_pairs(spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")], "key binary, value binary"), adapter, tasks=3)
    connectors.put_pairs(spark.createDataFrame([(b"b", None)], "key binary, value binary"), adapter)
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in connectors.scan_pairs(spark, adapter, [b"b"]).collect()) == [(b"a", b"1"), (b"c", b"3")]


def test_tables_in_memory(spark):
    kept = connectors.in_memory(spark.range(10))
    assert kept.is_cached and kept.count() == 10
    kept.unpersist()
