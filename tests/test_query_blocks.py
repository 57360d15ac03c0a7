"""Searches for many queries at once, in bounded blocks."""

import numpy as np
from pyspark.sql import functions as F

from loomstone.operators import proximity


def test_every_twentieth_row_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(proximity, "QUERY_BLOCK", 16)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("target"))
    sizes = [r["n"] for r in proximity.query_blocks(queries).select(F.size("qs").alias("n")).collect()]
    assert sum(sizes) == queries.count() == 100 and max(sizes) <= 16
    found = {}
    for r in proximity.nearest_for_each(vectors, queries, "vec_id", "embedding", 5).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["vec_id"]
    rows = vectors.orderBy("vec_id").collect()
    keys, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    for at in np.flatnonzero(keys % 20 == 0):
        near = keys[np.lexsort((keys, ((points - points[at]) ** 2).sum(1)))[:5]]
        assert [found[keys[at]][n] for n in range(1, 6)] == near.tolist()
    assert len(found) == 100
