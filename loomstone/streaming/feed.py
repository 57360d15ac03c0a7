"""Change feeds as streams: new versions of a store, and streaming last-write-wins."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstone.sources.files import Files
from loomstone.sources.store import VersionStore

MOVE_SCHEMA = "sequence long, ref string, old string, new string, at double"


def move_stream(store: VersionStore) -> DataFrame:
    """Logged moves of refs as they appear; the stream's checkpoint remembers which were seen."""
    return store.spark.readStream.schema(MOVE_SCHEMA).json(store.files.path("log"))


def follow(store: VersionStore, value: str, checkpoint: str, handle: Callable[[DataFrame, str], None], ref: str = "main", last_seen: str | None = None) -> StreamingQuery:
    """Call ``handle(changes, head)`` whenever the ref has moved; changes of several versions come as one.

    The version handled last is kept beside the checkpoint, so a restarted feed
    goes on behind it; ``last_seen`` counts only for a feed that is new.
    """
    places = Files(store.spark, checkpoint)

    def batch(_: DataFrame, __: int) -> None:
        kept = places.read("position.json")
        at = json.loads(kept)["version"] if kept else last_seen
        if (news := store.poll(at, value, ref)) is not None:
            handle(news[1], news[0])
            places.replace("position.json", json.dumps({"version": news[0]}))

    stream = move_stream(store).where(F.col("ref") == ref).writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def append_events(events: DataFrame, path: str) -> None:
    """Add events to a log; files hold runs in order."""
    events.repartitionByRange("run", "ts", "sequence").sortWithinPartitions("run", "ts", "sequence").write.mode("append").parquet(path)


def load_events(spark: SparkSession, path: str, run=None) -> DataFrame:
    """Events of a log in order of run, time and sequence number."""
    found = spark.read.parquet(path)
    return (found.where(F.col("run") == F.lit(run)) if run is not None else found).orderBy("run", "ts", "sequence")


def windowed_counts(events: DataFrame, time: str, kind: str, window: str, lateness: str) -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def latest_values(events: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Running last-write-wins of a stream: greatest (time, value) per key; use update or complete mode."""
    return events.groupBy(key).agg(F.max(F.struct(time, value)).alias("last")).select(key, F.col("last")[value].alias(value), F.col("last")[time].alias(time))
