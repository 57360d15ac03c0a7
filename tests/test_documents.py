"""Conditions, indexes, vectors, views, history, objects and integrity."""

import pytest

from loomstone.functions import conditions
from loomstone.operators import history, index, integrity, objects, proximity, views
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha", 5, ["x", "y"]), (2, None, 7, None), (3, "beta", None, ["x"])], "id int, name string, n int, tags array<string>")


def ids(items, text, **values):
    found = conditions.condition(text, {c: F.col(c) for c in items.columns}, values={f":{k}": v for k, v in values.items()})
    return sorted(r["id"] for r in items.where(found).collect())


def test_missing_attributes_make_leaves_false(items):
    assert ids(items, "name <> :a", a="alpha") == [3]
    assert ids(items, "NOT name = :a", a="alpha") == [2, 3]
    assert ids(items, "attribute_not_exists(name) OR n BETWEEN :l AND :h", l=1, h=5) == [1, 2]
    assert ids(items, "size(name) >= :s AND (begins_with(name, :p) OR contains(name, :q))", s=4, p="al", q="et") == [1, 3]
    assert ids(items, "n IN (:a, :b)", a=5, b=7) == [1, 2]
    assert ids(items, "tags[1] = :y", y="y") == [1]


def test_bad_expressions(items):
    fields = {c: F.col(c) for c in items.columns}
    for text, values in (("name =", {}), ("name = :x", {}), ("name = :x", {":x": 1, ":y": 2}), ("name ! :x", {":x": 1}), ("(name = :x", {":x": 1})):
        with pytest.raises(conditions.ExpressionError):
            conditions.condition(text, fields, values=values)
    with pytest.raises(conditions.ExpressionError):
        conditions.projection("tags, tags[0]", fields)
    with pytest.raises(conditions.ExpressionError):
        conditions.key_condition("n > :n", "id", "n", fields, {":n": 1})
    with pytest.raises(conditions.ExpressionError):
        conditions.update("SET id = :x", fields, {"id"}, values={":x": 1})


def test_updates_read_the_item_as_it_was(items):
    new = conditions.update("SET name = if_not_exists(name, :d), n = n + :one DELETE tags :t", {c: F.col(c) for c in items.columns}, {"id"}, values={":d": "none", ":one": 1, ":t": F.array(F.lit("x"))})
    got = items.select("id", *[c.alias(k) for k, c in new.items()]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "alpha", 6, ["y"]), (2, "none", 8, None), (3, "beta", None, None)]


def test_indexes(spark, items):
    tags = index.build(items, "id", F.col("tags"), "name", many=True)
    assert [tuple(r) for r in index.exact(tags, "x").collect()] == [("x", 1, "alpha"), ("x", 3, "beta")]
    assert [r["pk"] for r in index.page(tags, 5, ("x", 1)).collect()] == [3, 1]
    assert index.verify(tags.where("pk = 1"), tags).collect()[0]["problem"] == "missing"
    with pytest.raises(Exception, match="no row for index entry"):
        index.join_back(tags, items.where("id = 1"), "id").collect()
    with pytest.raises(RuntimeError):
        index.budgeted(tags, 2)
    moved = index.apply_diff(tags, tags.where("pk = 3"), tags.limit(0))
    assert {r["pk"] for r in moved.collect()} == {1}
    tokens = spark.createDataFrame([("Über-Alles, über 9!",)], "t string").select(index.normalized_tokens(F.col("t"))).first()[0]
    assert tokens == ["über", "alles", "9"]
    assert spark.range(1).select(index.canonical_path(F.lit("a//b/"))).first()[0] == "/a/b"


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])], "key int, vec array<float>")
    run = lambda metric, k=3: [(r["key"], round(r["distance"], 6)) for r in proximity.nearest(vectors, "key", "vec", [1.0, 0.0], k, metric).collect()]
    assert run("l2") == [(2, 0.0), (4, 0.0), (3, 1.0)]
    assert run("cosine") == [(2, 0.0), (3, 0.0), (4, 0.0)]
    assert run("inner_product", 1) == [(3, -2.0)]
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "key int, vec array<float>")
    with pytest.raises(Exception, match="no direction"):
        proximity.nearest(zero, "key", "vec", [1.0, 0.0], 1, "cosine").collect()
    with pytest.raises(Exception, match="not a finite vector"):
        proximity.checked(vectors, "vec", 3).collect()
    listed = spark.createDataFrame([(1,), (9,)], "key int")
    assert [r["key"] for r in proximity.nearest_eligible(vectors, listed, "key", "vec", [1.0, 0.0], 3).collect()] == [1]
    with pytest.raises(ValueError):
        proximity.nearest_eligible(vectors, listed, "key", "vec", [1.0, 0.0], 3, bound=True)
    codes = spark.range(1).select(proximity.quantize_sq8(F.array(F.lit(127.0), F.lit(0.5), F.lit(1.5), F.lit(-127.0))).alias("q")).first()["q"]
    assert codes["codes"] == [127, 0, 2, -127]
    assert proximity.choose_backend(10_000, 50, 10, ("graph",)) == "eligible_exact"
    assert proximity.choose_backend(10_000, 500, 10, ("graph",)) == "graph"


def test_quantized_and_cell_search_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.orderBy("vec_id").first()["embedding"]
    exact = {r["vec_id"] for r in proximity.nearest(vectors, "vec_id", "embedding", query, 10).collect()}
    rough = {r["vec_id"] for r in proximity.nearest_sq8(proximity.encode_sq8(vectors, "vec_id", "embedding"), vectors, "vec_id", "embedding", query, 10).collect()}
    assert len(exact & rough) >= 9
    model = proximity.train_cells(vectors, "embedding", 4)
    assigned = proximity.assign_cells(vectors, "embedding", model)
    assert {r["vec_id"] for r in proximity.nearest_in_cells(assigned, "vec_id", "embedding", model, query, 10, 4).collect()} == exact


def test_expiry(spark):
    now = 1_700_000_000
    rows = spark.createDataFrame([("a", str(now)), ("b", str(now + 1)), ("c", "-5"), ("d", "1.5"), ("e", None), ("f", str(now - views.FIVE_YEARS - 1)), ("g", "9" * 30)], "id string, ttl string")
    assert [r["id"] for r in views.ttl_candidates(rows, "ttl", now).collect()] == ["a"]


def test_history(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b"), ("e", "c"), ("e", "d")], "child string, parent string")
    commits = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 2), ("e", 3)], "id string, generation int")
    assert [tuple(r) for r in history.log(spark, edges, "e", 10).collect()] == [("e", 0), ("c", 1), ("d", 1), ("b", 2), ("a", 3)]
    assert history.is_ancestor(spark, edges, "a", "e") and not history.is_ancestor(spark, edges, "c", "d")
    assert history.merge_base(spark, commits, edges, "c", "d").first()["id"] == "b"


def test_objects(spark):
    listing = spark.createDataFrame([(k,) for k in ("a/1", "a/2", "b", "c/d/1")], "key string")
    assert sorted(map(tuple, objects.list_delimited(listing, "", "/", 10).collect())) == [("a/", "prefix", 2), ("b", "object", 1), ("c/", "prefix", 1)]
    assert sorted(map(tuple, objects.list_delimited(listing, "", "/", 1).collect())) == [("a/", "prefix", 1)]
    frame = lambda pairs: spark.createDataFrame(pairs, "key string, version_id string")
    merged, conflicts = objects.merge_objects(frame([("x", "1")]), frame([("x", "2")]), frame([("x", "3"), ("y", "1")]), "fail")
    assert sorted(map(tuple, merged.collect())) == [("x", "2"), ("y", "1")] and conflicts.count() == 1
    stored = spark.createDataFrame([("k", bytearray(b"0123456789"))], "key string, payload binary")
    assert bytes(objects.object_range(stored, "k", 2, 5).first()["payload"]) == b"234"


def test_integrity(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, v string")
    assert [tuple(r) for r in integrity.unique_violations(rows, ["v"]).collect()] == [("a", 2)]
    parents = spark.createDataFrame([("b",)], "p string")
    assert integrity.foreign_key_violations(rows, "v", parents, "p").count() == 2
    leaves = [r["cid"] for r in integrity.chunk_digests(rows, "id", ["id", "v"], 3).orderBy("bucket").collect()]
    root = integrity.tree(leaves)[-1][0]
    for i, leaf in enumerate(leaves):
        assert integrity.verify_proof(root, leaf, integrity.prove(leaves, i))
    assert not integrity.verify_proof(root, "0" * 64, integrity.prove(leaves, 0))
    envelope = integrity.sign(b"proof", b"key", 10, 20)
    assert integrity.verify_signature(envelope, b"key", 15) and not integrity.verify_signature(envelope, b"key", 25) and not integrity.verify_signature(envelope, b"other", 15)
