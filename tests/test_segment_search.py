"""Which segment a change falls into."""

from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from loomstone.sources.store import VersionStore


@pytest.mark.parametrize("segments", [1, 2, 3, 8, 9, 17])
def test_keys_find_their_segment(spark, tmp_path, segments):
    store = VersionStore(spark, str(tmp_path / "store"), "k")
    version = store.write(spark.range(0, 200, 2).select(F.col("id").alias("k")), partitions=segments)
    lows = [int(s.low) for s in version.segments[1:]]
    assert len(lows) == segments - 1
    place = store._segment_of(version, "bigint")
    keys = spark.createDataFrame([(k,) for k in [None, *range(-2, 203)]], "k long")
    found = {r["k"]: r["n"] for r in keys.select("k", place.alias("n")).collect()}
    assert found == {k: 0 if k is None else bisect_right(lows, k) for k in found}
    assert "filter" not in str(place), "a row is compared with every segment"
