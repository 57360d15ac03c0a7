"""The versioned vector map, its planner and accelerators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import proximity
from loomstone.sources.vectors import SearchRequest, VectorMap


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    return [(int(i), (centers[i % 20] + rng.normal(scale=0.6, size=16)).astype(np.float32).tolist(), f"text {i}") for i in range(3000)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory, points):
    found = VectorMap(spark, str(tmp_path_factory.mktemp("vectors")), 16)
    found.build(spark.createDataFrame(points, found.schema))
    return found


def nearest_by_hand(points, query, k):
    table = np.array([p[1] for p in points], np.float64)
    far = ((table - np.array(query)) ** 2).sum(axis=1)
    return [points[i][0] for i in np.lexsort((np.arange(len(points)), far))[:k]]


def recall(vectors, points, backend, queries=40):
    found = 0
    for i in range(queries):
        query = tuple((np.array(points[i * 37 % 3000][1]) + 0.05).tolist())
        hits = vectors.search(SearchRequest(query, 10, backend=backend)).hits
        found += len({k for k, _ in hits} & set(nearest_by_hand(points, query, 10)))
    return found / (10 * queries)


def test_planner_runs_what_it_chooses(vectors, points):
    query = tuple(points[5][1])
    assert vectors.search(SearchRequest(query, 3)).backend == "native"
    listed = vectors.search(SearchRequest(query, 3, keys=(5, 7, 9, 99999)))
    assert listed.backend == "eligible_exact" and {k for k, _ in listed.hits} == {5, 7, 9}
    with pytest.raises(ValueError):
        vectors.search(SearchRequest(query, 3, keys=(5, 99999), bound=True))
    ranged = vectors.search(SearchRequest(query, 2, start=100, end=200))
    assert [k for k, _ in ranged.hits] == nearest_by_hand(points[100:200], query, 2)
    vectors.accelerate("sq8")
    assert vectors.search(SearchRequest(query, 3)).backend == "sq8" and vectors.search(SearchRequest(query, 3, exact=True)).backend == "native"
    vectors.accelerate("graph", shards=2)
    assert vectors.search(SearchRequest(query, 3)).backend == "graph"
    assert vectors.verify() == {"records": 3000, "bad_vectors": 0, "stale_accelerators": 0}
    assert vectors.search(SearchRequest(query, 3, backend="native"), seconds=1e-4).complete is False


def test_recall_of_accelerators(vectors, points):
    if "graph" not in vectors.accelerators(vectors.store.head()):
        vectors.accelerate("sq8")
        vectors.accelerate("graph", shards=2)
    assert recall(vectors, points, "graph") >= 0.95
    assert recall(vectors, points, "sq8", 10) >= 0.95


def test_changes_composites_and_proofs(spark, tmp_path, points):
    found = VectorMap(spark, str(tmp_path), 16)
    base = found.build_if_absent(spark.createDataFrame(points[:300], found.schema))
    assert found.build_if_absent(spark.createDataFrame([], found.schema)).id == base.id
    changes = spark.createDataFrame([(5, [9.0] * 16, "moved", "upsert"), (6, None, None, "delete"), (1000, [8.0] * 16, "new", "upsert")], "key long, vec array<float>, value string, op string")
    found.mutate(changes)
    assert found.get(6) is None and found.contains(1000) and [r["key"] for r in found.scan(4, 8).collect()] == [4, 5, 7]
    request = SearchRequest((9.0,) * 16, 4)
    direct = found.search(request)
    assert direct.hits[0][0] == 5 and found.search_composite(base.id, request) == direct.hits
    assert found.context(direct).startswith("moved\n\nnew\n\n")
    proof = found.prove(request)
    assert found.verify_proof(proof) and not found.verify_proof(proof | {"hits": proof["hits"][1:]})
    with pytest.raises(Exception, match="not a finite vector"):
        found.mutate(spark.createDataFrame([(1, [1.0], "short", "upsert")], "key long, vec array<float>, value string, op string"))


def test_cosine_maps_hold_unit_vectors(spark, tmp_path, points):
    found = VectorMap(spark, str(tmp_path), 16, "cosine")
    found.build(spark.createDataFrame(points[:200], found.schema))
    exact = found.search(SearchRequest(tuple(points[3][1]), 5))
    found.accelerate("graph")
    walked = found.search(SearchRequest(tuple(points[3][1]), 5))
    assert walked.backend == "graph" and [k for k, _ in walked.hits] == [k for k, _ in exact.hits]
    assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(walked.hits, exact.hits, strict=True))
    with pytest.raises(Exception, match="no direction"):
        found.mutate(spark.createDataFrame([(1, [0.0] * 16, "zero", "upsert")], "key long, vec array<float>, value string, op string"))
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([2.0, 0.0], [3.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in zero.select(proximity.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
