"""Histories with more paths than commits, and none cut off by depth."""

from loomstone.operators import history


def test_many_merges_visit_each_commit_once(spark):
    rows = [e for n in range(24) for e in ((f"m{n}", f"a{n}"), (f"m{n}", f"b{n}"), (f"a{n}", f"m{n + 1}"), (f"b{n}", f"m{n + 1}"))]
    edges = spark.createDataFrame(rows, "child string, parent string")
    found = {r["id"]: r["depth"] for r in history.ancestors(spark, edges, "m0").collect()}
    assert len(found) == 24 * 3 + 1 and found["m24"] == 48 and found["a23"] == 47


def test_a_stated_depth_is_kept(spark):
    edges = spark.createDataFrame([(n, n - 1) for n in range(1, 9)], "child int, parent int")
    assert sorted(tuple(r) for r in history.ancestors(spark, edges, "8", 3).collect()) == [(5, 3), (6, 2), (7, 1), (8, 0)]
    assert history.ancestors(spark, edges, "8").count() == 9
