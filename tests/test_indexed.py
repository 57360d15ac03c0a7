"""A table and its indexes under one head."""

import pytest

from loomstone.sources.indexed import BudgetExceeded, Definition, IndexedStore, StaleCursor
from loomstone.sources.store import StaleRef


@pytest.fixture
def store(spark, tmp_path):
    store = IndexedStore(spark, str(tmp_path / "tasks"), "k")
    store.register(Definition("status", "status", ("n",)))
    store.register(Definition("tags", "split(tags, ',')", many=True))
    store.initialize(spark.createDataFrame([(i, "open" if i % 2 else "done", f"t{i % 3},all", i * 10) for i in range(40)], "k long, status string, tags string, n long"))
    return store


def keys(rows):
    return [r["pk"] for r in rows]


def test_source_and_indexes_move_together(store):
    first = store.snapshot()
    assert keys(first.exact("status", "open").collect()) == list(range(1, 40, 2))
    store.put({"k": 1, "status": "done", "tags": "x", "n": 5})
    store.delete(3)
    now = store.snapshot()
    assert keys(now.exact("status", "open").collect()) == list(range(5, 40, 2))
    assert keys(first.exact("status", "open").collect())[:2] == [1, 3], "an old snapshot stays as it was"
    assert store.verify_all() == {"status": 0, "tags": 0}
    assert now.records(now.exact("tags", "x")).collect()[0]["n"] == 5
    with pytest.raises(StaleRef):
        store.put({"k": 9}, expected=first.heads["source"])
    assert store.snapshot_by_id(first.id).source.count() == 40
    assert store.snapshot_at(first.heads["source"]).id == first.id


def test_cursors_fit_one_query_of_one_snapshot(store):
    first = store.snapshot()
    store.delete(3)
    now = store.snapshot()
    got, cursor = now.page("status", 5, start="open")
    more, _ = now.page("status", 5, cursor, start="open")
    assert keys(got + more) == [1, *range(5, 23, 2)]
    for other, limits in ((first, {"start": "open"}), (now, {}), (now, {"start": "open", "descending": True})):
        with pytest.raises(StaleCursor):
            other.page("status", 5, cursor, **limits)
    back, cursor = now.page("status", 3, descending=True)
    assert keys(back) == [39, 37, 35] and keys(now.page("status", 2, cursor, descending=True)[0]) == [33, 31]
    assert len(now.budgeted(now.exact("status", "open"), 19)) == 19
    with pytest.raises(BudgetExceeded):
        now.budgeted(now.exact("status", "open"), 18)
    with pytest.raises(BudgetExceeded):
        now.budgeted(now.exact("status", "open"), 19, most_bytes=10)


def test_care_of_indexes(spark, store, tmp_path):
    first = store.snapshot()
    with pytest.raises(ValueError):
        store.register(Definition("status", "upper(status)"))
    store.replace(Definition("status", "upper(status)", generation=2))
    assert store.snapshot().exact("status", "OPEN").count() == 20
    store.pin("old", first)
    store.delete(3)
    assert first.heads["source"] not in store.collect()["source"]
    store.export_current(str(tmp_path / "bundle"))
    other = IndexedStore(spark, str(tmp_path / "other"), "k")
    other.import_current(str(tmp_path / "bundle"))
    assert other.snapshot().exact("status", "OPEN").count() == 19
    store.deactivate("tags")
    assert store.health() == {"status": "active"}
    store.release_pin("old")
    store.collect(apply=True)
    assert store.verify_all() == {"status": 0} and store.snapshot().source.count() == 39
    with pytest.raises(KeyError):
        store.source.version(first.heads["source"])
    store.repair_index("status")
    assert store.verify_all() == {"status": 0}
