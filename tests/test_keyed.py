"""Scans, changes, differences and merges on small tables."""

import random

import pytest

from loomstone.functions import keys, values
from loomstone.operators import diff, merge, mutate, scan
from loomstone.operators.scan import get_many
from pyspark.sql import functions as F

KV = "k long, v string"


def frame(spark, pairs):
    return spark.createDataFrame(list(dict(pairs).items()), KV)


def as_dict(df):
    return {r["k"]: r["v"] for r in df.collect()}


# Golden key encodings.
GOLDEN = [("i64", -9223372036854775808, "0000000000000000"), ("i64", -42, "7fffffffffffffd6"), ("i64", -1, "7fffffffffffffff"), ("i64", 0, "8000000000000000"), ("i64", 42, "800000000000002a"), ("u64", 0, "0000000000000000"), ("u64", 9, "0000000000000009"), ("u64", 18446744073709551615, "ffffffffffffffff")]


@pytest.mark.parametrize(("kind", "value", "expected"), GOLDEN)
def test_golden_keys(spark, kind, value, expected):
    column = F.lit(str(value)).cast("decimal(20,0)")
    encoded = keys.i64_key(column) if kind == "i64" else keys.u64_key(column)
    assert spark.range(1).select(F.lower(F.hex(encoded))).first()[0] == expected


def test_prefix_end_and_wide_keys():
    assert keys.prefix_end(b"") is None and keys.prefix_end(b"\xff\xff") is None
    assert keys.prefix_end(b"abc") == b"abd" and keys.prefix_end(b"\x12\xff") == b"\x13"
    assert keys.wide_key(-1, signed=True).hex() == "7f" + "ff" * 15


def test_segments_round_trip(spark):
    parts = [b"tenant", b"\x00\x01\xff", b""]
    row = spark.createDataFrame([tuple(map(bytearray, parts))], "a binary, b binary, c binary")
    key = bytes(row.select(keys.segments(F.col("a"), F.col("b"), F.col("c"))).first()[0])
    assert key.hex() == "74656e616e74000000ff01ff00000000"
    assert keys.decode_segments(key) == parts
    for bad in (b"a", b"a\x00", b"a\x00\x01"):
        with pytest.raises(ValueError):
            keys.decode_segments(bad)


def test_values(spark):
    row = spark.createDataFrame([("x", 7)], "value string, t long")
    stamped = row.select(values.with_timestamp(F.col("value"), F.col("t")).alias("s"))
    assert stamped.select(values.timestamp_of(F.col("s")), values.bytes_of(F.col("s"))).first()[:] == (7, bytearray(b"x"))
    rows = spark.createDataFrame([("a", "s"), ("b", "l" * 50)], "key string, value string")
    refs, blobs = values.split_large(rows, 10)
    assert blobs.count() == 1 and sorted(map(tuple, values.join_large(refs, blobs).collect())) == sorted(map(tuple, rows.collect()))
    packed = row.select(values.envelope(F.col("value"), "user", 2).alias("e"))
    assert packed.select(values.require_schema(F.col("e"), "user", 2)).first()[0] == "x"
    with pytest.raises(Exception, match="isn't of schema"):
        packed.select(values.require_schema(F.col("e"), "user", 3)).collect()


def test_pages(spark):
    rows = frame(spark, [(i, str(i)) for i in range(10)])
    first = scan.page(rows, "k", 4)
    assert [r["k"] for r in first.rows] == [0, 1, 2, 3] and first.cursor == 3
    assert scan.page(rows, "k", 0, cursor=5) == scan.Page([], 5)
    last = scan.page(rows, "k", 5, cursor=4)
    assert last.cursor == 9 and scan.page(rows, "k", 5, cursor=9) == scan.Page([], None)
    back = scan.reverse_page(rows, "k", 5, before=5)
    assert [r["k"] for r in back.rows] == [4, 3, 2, 1, 0] and back.cursor is None
    assert scan.reverse_page(rows, "k", 3).cursor == 7


def test_order_statistics(spark):
    rows = frame(spark, [(i * 10, str(i)) for i in range(5)])
    assert scan.rank(rows, "k", 20).first()[0] == 2
    assert scan.select(rows, "k", 3).first()["k"] == 30 and scan.select(rows, "k", 9).first() is None
    assert scan.lower_bound(rows, "k", 20).first()["k"] == 20 and scan.upper_bound(rows, "k", 20).first()["k"] == 30
    window = scan.cursor_window(rows, "k", 25, 2).collect()
    assert [(r["k"], r["position"], r["found"]) for r in window] == [(30, 20, False), (40, 20, False)]
    probes = spark.createDataFrame([(0, 30), (1, 5), (2, 30)], "ordinal long, k long")
    assert [r["v"] for r in get_many(rows, "k", probes).collect()] == ["3", None, "3"]


def test_empty_value_differs_from_absence(spark):
    found = diff.diff_versions(frame(spark, [(1, ""), (2, "x")]), frame(spark, [(2, ""), (3, "")]), ["k"], "v")
    assert sorted(map(tuple, found.collect())) == [(1, "removed", "", None), (2, "changed", "x", ""), (3, "added", None, "")]


def test_random_histories(spark):
    rng = random.Random(4)
    for _ in range(3):
        make = lambda: {rng.randrange(60): rng.choice("abc") for _ in range(40)}
        old, new = make(), make()
        a, b = frame(spark, old.items()), frame(spark, new.items())
        change = diff.diff_versions(a, b, ["k"], "v")
        assert as_dict(mutate.apply_patch(a, change, "k", "v")) == new
        assert sorted(map(tuple, diff.pruned_diff(a, b, "k", "v", 7).collect())) == sorted(map(tuple, change.collect()))
        assert as_dict(merge.merge(a, b, a, "k", "v")) == new == as_dict(merge.merge(a, a, b, "k", "v"))
        assert diff.content_digest(b) == diff.content_digest(mutate.apply_patch(a, change, "k", "v"))


def test_patch_of_another_base_fails(spark):
    a, b = frame(spark, [(1, "a")]), frame(spark, [(1, "b")])
    with pytest.raises(Exception, match="another base"):
        mutate.apply_patch(frame(spark, [(1, "z")]), diff.diff_versions(a, b, ["k"], "v"), "k", "v").collect()


def test_diff_pages(spark):
    a, b = frame(spark, [(i, "a") for i in range(6)]), frame(spark, [(i, "b") for i in range(6)])
    one = diff.diff_page(a, b, "k", "v", 4)
    two = diff.diff_page(a, b, "k", "v", 4, one.cursor)
    assert [r["k"] for r in one.rows + two.rows] == list(range(6)) and one.cursor == 3 and two.cursor is None


def test_merge_rules(spark):
    base, left, right = frame(spark, [(1, "a"), (2, "a"), (3, "a")]), frame(spark, [(1, "l"), (2, "l"), (4, "l")]), frame(spark, [(1, "r"), (3, "r"), (4, "r")])
    run = lambda rule, **more: as_dict(merge.merge(base, left, right, "k", "v", rule, **more))
    assert run(merge.prefer_left) == {1: "l", 2: "l", 4: "l"}
    assert run(merge.prefer_right) == {1: "r", 3: "r", 4: "r"}
    assert run(merge.delete_wins, strict=False) == {}
    assert run(merge.update_wins, strict=False) == {2: "l", 3: "r"}
    with pytest.raises(Exception, match="unresolved conflict"):
        run(merge.unresolved)
    policy = merge.Policy([], merge.prefer_left).exact(1, merge.prefer_right).where(lambda k: k < 2, merge.delete_wins).exact(4, merge.prefer_right)
    assert run(policy, strict=False) == {2: "l", 4: "r"}
    assert as_dict(merge.merge_range(base, left, right, "k", "v", 4, 4)) == as_dict(left)
    assert as_dict(merge.merge_range(base, left, right, "k", "v", 1, 2, merge.prefer_right)) == {1: "r", 2: "l", 4: "l"}


def test_conflict_free_values(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", None), (2, "z", None)], "k int, v string, t long")
    assert sorted(map(tuple, merge.lww_register(rows, ["k"], "v", "t").collect())) == [(1, "b", 5), (2, "z", 0)]
    assert [r["v"] for r in merge.multi_value(rows, ["k"], "v").orderBy("k").collect()] == [["a", "b", "c"], ["z"]]


def test_batches(spark):
    base = frame(spark, [(1, "a"), (2, "b")])
    changes = spark.createDataFrame([(1, "x", "upsert", 1), (1, None, "delete", 2), (3, "c", "upsert", 1), (9, None, "delete", 1)], "k long, v string, op string, n int")
    assert as_dict(mutate.apply_batch(base, changes, "k", ordinal="n")) == {2: "b", 3: "c"}
    assert as_dict(mutate.delete_range(base, "k", 2, 1)) == {1: "a", 2: "b"}


def test_null_is_no_value(spark):
    """A null, the text NUL and an empty text differ, in digests and in differences, also by column."""
    sides = [frame(spark, [(1, v)]) for v in (None, "\x00", "")]
    assert len({diff.content_digest(s) for s in sides}) == 3
    for a in sides:
        for b in sides:
            assert diff.pruned_diff(a, b, "k", "v").count() == diff.diff_versions(a, b, ["k"], "v").count() == (a is not b)
    two = "k long, a string, b string"
    assert diff.content_digest(spark.createDataFrame([(1, "x", None)], two)) != diff.content_digest(spark.createDataFrame([(1, None, "x")], two))
    assert diff.content_digest(sides[2]) != diff.content_digest(sides[2].withColumnRenamed("v", "w"))


def test_composite_keys_are_decoded(spark):
    from loomstone.functions import keys

    parts = [(b"a\x00b", b""), (b"\x00\xff", b"\xff\x00\x00"), (b"plain", b"x")]
    rows = spark.createDataFrame(parts, "a binary, b binary")
    got = rows.select(keys.decoded_segments(keys.segments(rows["a"], rows["b"]))).collect()
    assert [tuple(map(bytes, r[0])) for r in got] == parts
    with pytest.raises(Exception, match="not a composite key"):
        spark.createDataFrame([(b"a\x00",)], "k binary").select(keys.decoded_segments(F.col("k"))).collect()


def test_tombstones(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string").withColumn("deleted", F.lit(None).cast(mutate.TOMBSTONE))
    gone = mutate.soft_delete(rows, rows.where("k < 3").select("k"), "k", mutate.tombstone(F.lit("ann"), F.col("k") * 10))
    later = mutate.soft_delete(gone, gone.where("k = 2").select("k"), "k", mutate.tombstone(F.lit("bob"), F.lit(5)))
    assert [(r["k"], r["deleted"] and r["deleted"]["actor"]) for r in later.orderBy("k").collect()] == [(1, "ann"), (2, "ann"), (3, None)]
    assert [r["k"] for r in mutate.compact_tombstones(later).collect()] == [3]
    assert sorted(r["k"] for r in mutate.compact_tombstones(later, before=20).collect()) == [2, 3]
    stone = later.select(mutate.tombstone_of(mutate.tombstone_bytes(F.col("deleted"))).alias("d"), "deleted").where("deleted is not null").first()
    assert stone["d"] == stone["deleted"] and rows.select(mutate.tombstone_of(F.col("v").cast("binary"))).first()[0] is None


def test_sorted_builds_and_appends_refuse_disorder(spark, monkeypatch):
    monkeypatch.setattr(mutate, "ORDINALS_PER_BLOCK", 3)
    monkeypatch.setattr(mutate, "BLOCKS_PER_GROUP", 2)
    rows = [(o * 4, k, str(o)) for o, k in enumerate([1, 2, 2, 3, 5, 8, 8, 9, 11, 12])]
    build = lambda rows: mutate.build_sorted(spark.createDataFrame(rows, "o long, k int, v string").repartition(3), "k", "o")
    assert as_dict(build(rows)) == {k: v for _, k, v in rows}
    for i in range(1, 10):
        with pytest.raises(Exception, match="aren't sorted"):
            build([(o, 0 if n == i else k, v) for n, (o, k, v) in enumerate(rows)]).collect()
    base = frame(spark, [(1, "a"), (5, "b")])
    assert as_dict(mutate.append(base, frame(spark, [(6, "c")]), "k")) == {1: "a", 5: "b", 6: "c"}
    with pytest.raises(Exception, match="behind all keys"):
        mutate.append(base, frame(spark, [(5, "c")]), "k").collect()
