"""Indexes that a change of the source leaves as they were."""

from loomstone.sources.indexed import Definition, IndexedStore


def test_an_index_whose_entries_stay_is_not_written(spark, tmp_path):
    store = IndexedStore(spark, str(tmp_path / "tasks"), "k")
    store.register(Definition("status", "status", ("n",)))
    store.register(Definition("tags", "split(tags, ',')", ("m",), many=True))
    schema = "k long, status string, tags string, n long, m map<string,int>"
    kept = Definition("kept", "split(tags, ',')", many=True)
    store.register(kept)
    store.initialize(spark.createDataFrame([(i, "open", f"t{i % 3},all", i, {"a": i}) for i in range(40)], schema))
    store.apply(spark.createDataFrame([(i, "done" if i % 2 else "open", f"t{i % 3},all", i * (i % 4), {"a": -i}, "upsert") for i in range(20)], f"{schema}, op string"))
    assert store.verify_index("status").count() == store.verify_index("kept").count() == 0
    assert store.snapshot().exact("status", "done").count() == 10
    assert {r["pk"]: r["m"] for r in store.snapshot().exact("tags", "all").collect()} == {i: {"a": -i if i < 20 else i} for i in range(40)}
    assert len(store.index_store("kept").files.folders("data")) == 1, "equal entries were written again"
