"""Document tables kept as versions."""

import pytest

from loomstone.sources.documents import ConditionFailed, DocumentDatabase, select_mode
from loomstone.sources.store import StaleRef


@pytest.fixture
def db(spark, tmp_path):
    db = DocumentDatabase(spark, str(tmp_path / "db"))
    db.create_table("notes", "owner STRING, n BIGINT, kind STRING, tags ARRAY<STRING>, expires BIGINT", "owner", "n", {"by_kind": ("kind", "n")}, "expires")
    db.create_table("counts", "owner STRING, total BIGINT", "owner")
    db.batch_write({"notes": ([{"owner": "u", "n": i, "kind": "even" if i % 2 == 0 else None, "tags": ["a", str(i)], "expires": 1000 + i} for i in range(8)], [])})
    return db


def test_tables_and_items(db):
    assert db.list_tables(limit=1).rows == ["counts"] and db.list_tables(after="counts").rows == ["notes"]
    first = db.heads()["notes"]
    second = db.put_item("notes", {"owner": "v", "n": 1, "kind": "odd"}, "attribute_not_exists(owner)")
    with pytest.raises(ConditionFailed):
        db.put_item("notes", {"owner": "v", "n": 1}, "attribute_not_exists(owner)")
    with pytest.raises(StaleRef):
        db.put_item("notes", {"owner": "w", "n": 1}, expected=first)
    db.update_item("notes", {"owner": "u", "n": 2}, "SET tags[1] = :t, kind = :k", "contains(tags, :a)", values={":t": "two", ":k": "new"}, condition_values={":a": "a"})
    assert db.get_item("notes", {"owner": "u", "n": 2})["tags"] == ["a", "two"] and db.get_item("notes", {"owner": "u", "n": 2}, second)["tags"] == ["a", "2"]
    db.delete_item("notes", {"owner": "u", "n": 3})
    assert db.get_item("notes", {"owner": "u", "n": 3}) is None
    assert [r["n"] for r in db.index("notes", "by_kind").query("kind = :k", {":k": "even"}).items] == [0, 4, 6]
    counted = db.table("notes").query("owner = :o", {":o": "u"}, "n > :n", {":n": 4}, limit=5, select="COUNT")
    assert (counted.items, counted.count, counted.scanned_count) == ([], 1, 5)
    assert {r["n"] for r in db.batch_get({"notes": [{"owner": "u", "n": 0}, {"owner": "x", "n": 0}]})["notes"].collect()} == {0}
    db.restore("notes", first)
    assert db.get_item("notes", {"owner": "u", "n": 3})["n"] == 3
    db.delete_table("counts")
    with pytest.raises(KeyError):
        db.describe_table("counts")


def test_select_rules():
    assert select_mode(None, True) == "SPECIFIC_ATTRIBUTES" and select_mode(None, False, True) == "ALL_PROJECTED_ATTRIBUTES"
    for select, projected in (("COUNT", True), ("SPECIFIC_ATTRIBUTES", False), ("SOME", False), ("ALL_PROJECTED_ATTRIBUTES", False)):
        with pytest.raises(ValueError):
            select_mode(select, projected)


def test_transactions_over_tables(db):
    actions = [("notes", "delete", {"owner": "u", "n": 0}, {}), ("counts", "update", {"owner": "u"}, {"expression": "ADD total :k", "values": {":k": -1}}), ("notes", "check", {"owner": "u", "n": 1}, {"condition": "attribute_exists(owner)"})]
    heads = db.transact_write(actions, token="once")
    assert db.transact_write(actions, token="once") == heads == db.heads(), "a token makes it idempotent"
    got = db.transact_get([("counts", {"owner": "u"}), ("notes", {"owner": "u", "n": 0})])
    assert got[0]["total"] == -1 and got[1] is None
    with pytest.raises(ConditionFailed):
        db.transact_write([("counts", "put", {"owner": "x", "total": 1}, {}), ("notes", "check", {"owner": "u", "n": 0}, {"condition": "attribute_exists(owner)"})])
    assert db.heads() == heads
    with pytest.raises(ValueError):
        db.transact_write([("counts", "put", {"owner": "x"}, {}), ("counts", "delete", {"owner": "x"}, {})])


def test_expiry_archives_and_retention(db, tmp_path):
    seen = [{"owner": "u", "n": 0, "expires": 1000}, {"owner": "u", "n": 1, "expires": 5}]
    assert db.expired("notes", 1003).count() == 4 and db.expire("notes", 1003, seen) == 1
    assert db.expire("notes", 1003) == 3 and db.table("notes").rows.count() == 4
    db.export_table("notes", str(tmp_path / "archive"))
    assert db.plan_import("copy", str(tmp_path / "archive")) == {"rows": 4, "free": True}
    db.import_table("copy", str(tmp_path / "archive"))
    assert [r["n"] for r in db.table("copy").scan().items] == [4, 5, 6, 7]
    db.bulk_load("copy", db.table("copy").rows.where("n > 5"))
    assert db.table("copy").rows.count() == 2
    dropped = db.plan_retention("notes", 1)
    assert dropped and db.apply_retention("notes", 1) == len(dropped) and db.table("notes").rows.count() == 4


def test_feed_and_workers(db):
    page = db.commits(limit=2)
    assert [c["sequence"] for c in page.rows] == [1, 2] and db.commits(page.cursor).rows[0]["sequence"] == 3
    seen = []
    assert db.run_worker("copy", "one", lambda c: seen.append(c["sequence"])) == 3 and seen == [1, 2, 3]
    db.put_item("counts", {"owner": "z", "total": 1})
    with pytest.raises(StaleRef):
        db.acquire_lease("copy", "two", 60)
    old = db.acquire_lease("copy", "one", 60)
    db.release_lease("copy", old["token"])
    assert db.run_worker("copy", "two", lambda c: seen.append(c["sequence"])) == 1 and seen[-1] == 4
    with pytest.raises(StaleRef):
        db.update_lease("copy", old["token"], checkpoint=0)
