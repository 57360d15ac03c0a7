"""Inline values beside those kept as blobs."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import values


@pytest.fixture
def shuffled(spark):
    """Joins as of tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inline_values_stay_spread(spark, shuffled):
    text = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 100 == 1, F.repeat(F.lit("large "), 10)).otherwise(F.concat(F.lit("v"), F.col("id")))
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").alias("key"), text.alias("value"))
    found = values.join_large(*values.split_large(rows, 10))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 250, "values without a blob met in one task"


def test_a_missing_blob_leaves_a_null(spark):
    refs, blobs = values.split_large(spark.createDataFrame([(1, "short"), (2, "x" * 20)], "key long, value string"), 10)
    assert sorted(map(tuple, values.join_large(refs, blobs.limit(0)).collect())) == [(1, "short"), (2, None)]
