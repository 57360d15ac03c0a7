"""Searches for many queries dealt into pairs of blocks."""

import math

import pytest
from pyspark.sql import functions as F

from loomstone.operators import proximity

SCHEMA = "key long, vec array<float>"


@pytest.mark.parametrize("metric", proximity.METRICS)
def test_blocks_give_the_distances_of_every_pair(spark, monkeypatch, metric):
    for name, size in {"BLOCK_ROWS": 8, "BLOCK_NUMBERS": 64, "QUERIES_AT_ONCE": 3, "PAIRS_AT_ONCE": 5}.items():
        monkeypatch.setattr(proximity, name, size)
    points = [[math.sin(i * j + 1) * 10 ** (i % 5 - 2) for j in range(1, 5)] for i in range(60)]
    points += [[x * (1 + 2e-7) for x in points[3]], *[points[7]] * 20]
    vectors = spark.createDataFrame(list(enumerate(points)), SCHEMA)
    queries = vectors.where("key % 3 = 0").select(F.col("key").alias("query"), F.col("vec").alias("target"))
    result = proximity.nearest_for_each(vectors, queries, "key", "vec", 4, metric)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got, want = {}, {}
    for r in result.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["distance"], r["key"]))
    for r in vectors.crossJoin(queries).select("query", "key", proximity.distance(metric, F.col("vec"), F.col("target")).alias("d")).collect():
        want.setdefault(r["query"], []).append((r["d"], r["key"]))
    assert {q: sorted(rows) for q, rows in got.items()} == {q: [(n + 1, *row) for n, row in enumerate(sorted(rows)[:4])] for q, rows in want.items()}


def test_rows_without_a_distance_come_last(spark):
    vectors = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [2.0, None]), (4, [5.0, 5.0]), (5, [1.0, 2.0, 3.0]), (6, [float("nan"), 1.0])], SCHEMA)
    queries = spark.createDataFrame([(10, [1.0, 1.0]), (11, None)], "query long, target array<float>")
    rows = proximity.nearest_for_each(vectors, queries, "key", "vec", 5).orderBy("query", "rank").collect()
    assert [r["key"] for r in rows] == [2, 4, 6, 1, 3, 1, 2, 3, 4, 5]
    assert [r["distance"] for r in rows[:2]] == [1.0, 32.0] and all(r["distance"] is None for r in rows[3:])


def test_no_vectors_or_no_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0])], SCHEMA)
    queries = vectors.select(F.col("key").alias("query"), F.col("vec").alias("target"))
    assert proximity.nearest_for_each(vectors.limit(0), queries, "key", "vec", 5).count() == 0
    assert proximity.nearest_for_each(vectors, queries.limit(0), "key", "vec", 5).count() == 0


def test_a_vector_without_direction_is_an_error(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], SCHEMA)
    queries = vectors.where("key = 2").select(F.col("key").alias("query"), F.col("vec").alias("target"))
    with pytest.raises(Exception, match="no direction"):
        proximity.nearest_for_each(vectors, queries, "key", "vec", 1, "cosine").collect()
