"""Tables written once in the shared folder and read back, to cut lineage.

A staged table survives the loss of any executor, because it lies in the folder
named by ``spark.checkpoint.dir`` and not on a worker's disk. Without that
setting a folder of our own serves a local session; a cluster must name one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomstone.sharedDir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="loomstone-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set("spark.loomstone.sharedDir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``release`` removes what was written there."""
    path = f"{shared_dir(spark)}/loomstone/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


class Staged:
    """A table written to the shared folder; ``df`` reads it, ``drop`` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def bytes(self) -> int:
        """Bytes of its files."""
        target, system = _located(self.spark, self.path)
        return int(system.getContentSummary(target).getLength())

    def drop(self) -> None:
        remove(self.spark, self.path)


def if_small(table: Staged, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, to be broadcast if its files hold at most so many bytes; else joined by a shuffle."""
    return F.broadcast(table.df) if table.bytes() <= most else table.df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    return Staged(df, name).df


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Spark's own file system layer."""
    target, system = _located(spark, path)
    system.delete(target, True)
    _left.discard(path)


def release(spark: SparkSession) -> None:
    """Remove all that this process has staged; results that were read are unaffected, plans not yet run are void."""
    for path in list(_left):
        remove(spark, path)
