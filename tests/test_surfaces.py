"""Sessions, document tables, the object repository, the SQL surface and codecs."""

import pytest

from loomstone.functions import cbor, decimals
from loomstone.operators import mutate, proximity, scan
from loomstone.sources.documents import ConditionFailed, DocumentTable
from loomstone.sources.repository import ObjectRepository
from loomstone.sources.session import Catalog, WriteSession
from loomstone.sources.sql import ConstraintViolation, SerializationConflict, SqlDatabase
from loomstone.sources.store import StaleRef, VersionStore
from pyspark.sql import functions as F

KV = "k long, v string"


def pairs(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_write_session(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), "k")
    store.commit(spark.createDataFrame([(1, "a"), (2, "b")], KV))
    session = WriteSession(store, most=3)
    session.put(3, "c")
    session.savepoint("one")
    session.delete(1)
    session.put(2, "B")
    assert session.get(1) is None and session.get(2) == (2, "B") and session.get(9) is None
    assert pairs(session.range(2, 4)) == [(2, "B"), (3, "c")]
    with pytest.raises(RuntimeError):
        session.put(7, "x")
    session.revert("one")
    session.commit()
    assert pairs(store.snapshot(store.head())) == [(1, "a"), (2, "b"), (3, "c")]
    late, early = WriteSession(store), WriteSession(store)
    early.put(5, "e")
    early.commit()
    late.put(6, "f")
    with pytest.raises(StaleRef):
        late.commit()


def test_catalog_moves_tables_together(spark, tmp_path):
    stores = {n: VersionStore(spark, str(tmp_path / n), "k") for n in ("a", "b")}
    catalog = Catalog(str(tmp_path / "catalog"), stores)
    one = spark.createDataFrame([(1, "x")], KV)
    heads = catalog.commit({"a": one, "b": one}, {})
    assert pairs(catalog.snapshot()["b"]) == [(1, "x")]
    two = spark.createDataFrame([(1, "y")], KV)
    catalog.commit({"a": two}, heads)
    with pytest.raises(StaleRef):
        catalog.commit({"a": one, "b": two}, heads)
    assert pairs(catalog.snapshot()["a"]) == [(1, "y")] and pairs(catalog.snapshot()["b"]) == [(1, "x")]


def test_document_tables(spark):
    rows = spark.createDataFrame([("u", i, "even" if i % 2 == 0 else "odd", None) for i in range(6)], "owner string, n long, kind string, note string")
    table = DocumentTable(rows, "owner", "n")
    page = table.query("owner = :o AND n >= :n", {":o": "u", ":n": 1}, "kind = :k", {":k": "even"}, limit=3)
    assert (page.count, page.scanned_count, page.last_key) == (1, 3, ("u", 3)) and page.items[0]["n"] == 2
    assert [r["n"] for r in table.query("owner = :o", {":o": "u"}, forward=False, limit=2, project="n").items] == [5, 4]
    assert table.scan(limit=4, after=("u", 3)).count == 2
    with pytest.raises(ConditionFailed):
        table.put({"owner": "u", "n": 1, "kind": "new"}, "attribute_not_exists(owner)")
    fresh = table.put({"owner": "v", "n": 1, "kind": "new"}, "attribute_not_exists(owner)")
    assert fresh.get(owner="v", n=1)["kind"] == "new" and fresh.rows.count() == 7
    changed = fresh.update({"owner": "u", "n": 2}, "SET note = :x", "kind = :k", values={":x": "hi"}, condition_values={":k": "even"})
    assert changed.get(owner="u", n=2)["note"] == "hi" and changed.get(owner="u", n=3)["note"] is None
    assert changed.delete({"owner": "u", "n": 2}).get(owner="u", n=2) is None
    assert {r["n"] for r in table.batch_get([{"owner": "u", "n": 1}, {"owner": "u", "n": 99}]).collect()} == {1}
    wrote = table.batch_write([{"owner": "w", "n": 1, "kind": "z"}], [{"owner": "u", "n": 0}])
    assert wrote.rows.count() == 6
    with pytest.raises(ConditionFailed):
        table.transact([("delete", {"owner": "u", "n": 0}, {}), ("check", {"owner": "u", "n": 1}, {"condition": "kind = :k", "values": {":k": "even"}})])
    done = table.transact([("delete", {"owner": "u", "n": 0}, {}), ("update", {"owner": "u", "n": 9}, {"expression": "SET kind = :k", "values": {":k": "made"}})])
    assert done.get(owner="u", n=0) is None and done.get(owner="u", n=9)["kind"] == "made"


def test_object_repository(spark, tmp_path):
    repo = ObjectRepository(spark, str(tmp_path))
    first = repo.write({"a/1": b"0123456789", "a/2": b"x", "b": b"y"})
    repo.store.branch("side", first.id)
    repo.write({"b": b"ours"}, deletes=["a/2"])
    repo.write({"b": b"theirs", "c": b"new"}, branch="side")
    assert repo.read("a/1", start=2, end=5) == b"234" and repo.read("a/2") is None and repo.read("a/2", commit=first.id) == b"x"
    assert {r["entry"] for r in repo.list(delimiter="/").collect()} == {"a/", "b"}
    outcome, keys = repo.merge("main", "side")
    assert outcome == "conflicts" and [r["key"] for r in keys.collect()] == ["b"]
    outcome, _ = repo.merge("main", "side", "theirs")
    assert outcome == "applied" and repo.read("b") == b"theirs" and repo.read("c") == b"new" and repo.read("a/2") is None
    assert repo.log()[0].id == repo.store.head() and first.id in {v.id for v in repo.log()}
    assert {r["key"] for r in repo.diff(first.id, repo.store.head()).collect()} == {"a/2", "b", "c"}


@pytest.fixture
def database(spark, tmp_path):
    db = SqlDatabase(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE owners (id INT PRIMARY KEY, name STRING NOT NULL UNIQUE)")
    db.execute("CREATE TABLE things (id INT, owner INT, v STRING, PRIMARY KEY (id), FOREIGN KEY (owner) REFERENCES owners (id))")
    db.execute("INSERT INTO owners VALUES (1, 'ann'), (2, 'bob')")
    db.execute("INSERT INTO things VALUES (1, 1, 'a'), (2, NULL, NULL), (3, 2, 'b')")
    return db


def values(db, name="things"):
    return [tuple(r) for r in db.scan(name).collect()]


def test_sql_statements(database):
    db = database
    db.execute("CREATE INDEX by_v ON things (upper(v))")
    assert [r["id"] for r in db.scan_index("things", "by_v", ">", "A").collect()] == [3, 2], "null is above every value"
    assert [r["id"] for r in db.scan_index("things", "by_v", descending=True).collect()] == [2, 3, 1]
    db.execute("CREATE FUNCTION plus_one(n INT) RETURNS INT RETURN n + 1")
    assert db.execute("SELECT plus_one(count(*)::int) AS n FROM things").first()["n"] == 4 and db.function("plus_one")["returns"] == "INT"
    db.execute("UPDATE things SET v = concat(v, '!'), owner = 2 WHERE id = 1")
    db.execute("UPSERT INTO things (id, v) VALUES (2, 'new'), (4, 'four')")
    db.execute("DELETE FROM things WHERE id = 3")
    assert values(db) == [(1, 2, "a!"), (2, None, "new"), (4, None, "four")] and db.fetch("things", 4)["v"] == "four"
    assert [r["id"] for r in db.scan_index("things", "by_v", "=", "A!").collect()] == [1], "an index follows its table"
    for wrong in ("INSERT INTO things VALUES (1, 1, 'x')", "INSERT INTO things VALUES (9, 7, 'x')", "INSERT INTO owners VALUES (3, 'ann')", "INSERT INTO owners VALUES (3, NULL)"):
        with pytest.raises(ConstraintViolation):
            db.execute(wrong)
    assert [tuple(r) for r in db.table_meta().collect()] == [("owners", "id", 2, 2, 0), ("things", "id", 3, 3, 1)]
    db.execute("DROP INDEX things.by_v")
    db.execute("DROP FUNCTION plus_one")
    db.execute("DROP TABLE things")
    assert list(db.schemas()) == ["owners"] and db.function("plus_one") is None and db.schema("things") is None


def test_sql_rows_without_a_key_get_numbers(spark, tmp_path):
    db = SqlDatabase(spark, str(tmp_path))
    db.execute("CREATE TABLE notes (t STRING)")
    db.append("notes", spark.range(50).selectExpr("cast(id as string) t").repartition(4))
    db.execute("INSERT INTO notes VALUES ('last')")
    assert sorted(r["_row_id"] for r in db.table("notes").collect()) == list(range(1, 52)) and db.fetch("notes", 51)["t"] == "last"


def test_sql_transactions_and_branches(spark, database, tmp_path):
    db, other = database, SqlDatabase(spark, str(tmp_path / "db"))
    db.begin()
    db.execute("DELETE FROM things")
    assert values(db) == [] and len(values(other)) == 3
    db.rollback()
    assert len(values(db)) == 3
    other.begin()
    other.execute("UPDATE things SET v = 'late'")
    db.execute("UPDATE things SET v = 'early' WHERE id = 1")
    with pytest.raises(SerializationConflict):
        other.commit()
    start = db.at
    db.create_branch("side")
    db.execute("UPDATE things SET v = 'main' WHERE id = 2")
    side = SqlDatabase(spark, str(tmp_path / "db"), "side")
    side.execute("UPDATE things SET v = 'side' WHERE id = 3")
    side.execute("CREATE TABLE extra (id INT PRIMARY KEY)")
    assert db.merge("side")[0] == "merged" and [r[2] for r in values(db)] == ["early", "main", "side"] and "extra" in db.schemas()
    assert db.is_ancestor(start, db.at) and db.merge_base(db.at, side.at) == side.at and db.log(1)[0] == (db.at, "merge")
    found = db.diff(start, db.at)
    assert found["added"] == ["extra"] and {(r["id"], r["kind"]) for r in found["rows"]["things"].collect()} == {(2, "changed"), (3, "changed")}
    side.execute("UPDATE things SET v = 'x' WHERE id = 1")
    side.execute("DELETE FROM owners WHERE id = 2")
    db.execute("UPDATE things SET v = 'y' WHERE id = 1")
    before = db.at
    outcome, trouble = db.merge("side")
    assert outcome == "conflicts" and list(trouble) == ["rows things"] and db.head() == before
    db.execute("UPDATE things SET v = 'x' WHERE id = 1")
    outcome, trouble = db.merge("side")
    assert outcome == "conflicts" and list(trouble) == ["foreign key things.owner"]
    db.checkout(start)
    assert [r[2] for r in values(db)] == ["early", None, "b"]
    db.reset(start)
    assert db.head() == start and db.branches().keys() == {"main", "side"}


def test_cbor(spark):
    values = [None, True, 0, 23, 24, 255, 256, 70000, 1 << 40, -1, -500, 1.5, "é", b"\x00", [1, [2]], {"a": {"b": [None]}}, "x" * 300]
    for value in values:
        assert cbor.loads(cbor.dumps(value)) == value
    assert cbor.dumps([1, 2, 3]).hex() == "83010203" and cbor.dumps(-500).hex() == "3901f3"
    for bad in (b"", b"\x61", b"\x00\x00", b"\x9f"):
        with pytest.raises(ValueError):
            cbor.loads(bad)
    rows = spark.createDataFrame([('{"a": [1, "é", null]}',), (None,)], "j string")
    back = rows.select("j", cbor.decode_cbor_as_json(cbor.encode_json_as_cbor(F.col("j"))).alias("b")).collect()
    assert [r["b"] for r in back] == [r["j"] for r in rows.collect()]


def test_decimals(spark):
    from decimal import Decimal

    texts = ["-1e125", "-1.5", "-1", "-0.001", "0", "1e-130", "0.1", "1", "1.05", "9", "10", "12345678901234567890123456789012345678", "9e125"]
    encoded = [decimals.ordered_bytes(decimals.parse(t)) for t in texts]
    assert encoded == sorted(encoded) and len(set(encoded)) == len(texts)
    for bad in ("1e126", "1" * 39, "nan", "1e-131"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            decimals.parse(bad)
    rows = spark.createDataFrame([("0.1", "0.2"), ("1e20", "1"), (None, "1")], "a string, b string")
    got = rows.select(decimals.add(F.col("a"), F.col("b")).alias("s"), decimals.compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r["s"] and Decimal(r["s"]), r["c"]) for r in got] == [(Decimal("0.3"), -1), (Decimal(10) ** 20 + 1, 1), (None, None)]


def test_bulk_loads(spark):
    entries = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, 2, "c")], "o int, k long, v string")
    assert pairs(mutate.build(entries, "k", "o", 2)) == pairs(mutate.build_sorted(entries, "k", "o")) == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="aren't sorted"):
        mutate.build_sorted(entries.unionByName(spark.createDataFrame([(3, 1, "z")], entries.schema)), "k", "o").collect()


def test_visits_stop_early(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(9)], KV)
    assert scan.visit(rows, "k", lambda r: r["v"] if r["k"] == 4 else None, start=2) == (3, "4")
    assert scan.visit(rows, "k", lambda r: None, end=3, descending=True) == (3, None)


def test_product_quantizer_and_composite(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.orderBy("vec_id").first()["embedding"]
    exact = [r["vec_id"] for r in proximity.nearest(vectors, "vec_id", "embedding", query, 5).collect()]
    models = proximity.train_product_quantizer(vectors, "embedding", 2, 8)
    found = proximity.nearest_product(proximity.encode_product(vectors, "embedding", models), "vec_id", "embedding", models, query, 5, rerank=10)
    assert len({r["vec_id"] for r in found.collect()} & set(exact)) >= 3
    gone = vectors.where(F.col("vec_id") == exact[1]).select("vec_id")
    delta = vectors.where(F.col("vec_id") == exact[2])
    base = vectors.withColumn("embedding", F.when(F.col("vec_id") == exact[2], F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    got = [r["vec_id"] for r in proximity.nearest_composite(base, delta, gone, "vec_id", "embedding", query, 4).collect()]
    assert got == [exact[0], *exact[2:5]]
    texts = vectors.select("vec_id", F.col("vec_id").cast("string").alias("text"))
    top = proximity.nearest(vectors, "vec_id", "embedding", query, 2)
    assert proximity.context_of(top, texts, "vec_id", "text", "|").first()["context"] == f"{exact[0]}|{exact[1]}"
