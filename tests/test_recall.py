"""Recall of the registered approximate searches, at exactly their settings, against brute force."""

import numpy as np
import pytest

from loomstone.operators import proximity
from loomstone.plans import catalog
from loomstone.staging import staged

SF = "/root/testdata/sf0.1"


def measure(vectors, search, step):
    """Mean share of the true ten nearest that ``search`` finds, over every step-th vector."""
    rows = vectors.orderBy("vec_id").collect()
    keys, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    shares = []
    for target in points[::step]:
        order = np.lexsort((keys, ((points - target) ** 2).sum(1)))[:10]
        shares.append(len({r["vec_id"] for r in search(target.tolist()).collect()} & set(keys[order].tolist())) / 10)
    return float(np.mean(shares))


def product_search(vectors):
    models = proximity.train_product_quantizer(vectors, "embedding", catalog.PARTS, catalog.CENTROIDS)
    encoded = staged(proximity.encode_product(vectors, "embedding", models), "recall")
    return lambda target: proximity.nearest_product(encoded, "vec_id", "embedding", models, target, 10, catalog.RERANK, catalog.RERANK_SHARE)


def cell_search(vectors):
    model = proximity.train_cells(vectors, "embedding", catalog.CELLS)
    assigned = staged(proximity.assign_cells(vectors, "embedding", model), "recall")
    return lambda target: proximity.nearest_in_cells(assigned, "vec_id", "embedding", model, target, 10, catalog.PROBES)


@pytest.mark.parametrize("build", [product_search, cell_search])
def test_registered_settings_find_nine_of_ten(spark, build):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    assert measure(vectors, build(vectors), 100) >= 0.9


def test_product_codes_are_the_nearest_centroids(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").limit(50)
    models = proximity.train_product_quantizer(vectors, "embedding", 4, 8)
    for r in proximity.encode_product(vectors, "embedding", models).collect():
        point = np.array(r["embedding"], float).reshape(4, -1)
        want = [int(((np.array(m.clusterCenters()) - x) ** 2).sum(1).argmin()) for m, x in zip(models, point, strict=True)]
        assert list(r["codes"]) == want
