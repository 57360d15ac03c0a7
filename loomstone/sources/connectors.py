"""Reading and writing keyed tables: Spark's file formats, databases, and key-value stores.

Databases go through JDBC, whose driver jar must be on the class path, or through
a Python DB-API module that the workers can import. Key-value stores go through
an ``Adapter``: a few functions that a task calls with a connection of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.workers import reachable

FORMATS = ("parquet", "orc", "json", "csv", "text")
BATCH_ROWS = 1000


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A table in one of Spark's file formats; give a schema for text formats, as none is inferred."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_sorted(rows: DataFrame, path: str, key: str, partitions: int, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Files of disjoint key ranges, sorted, so that range scans skip by file statistics."""
    rows.repartitionByRange(partitions, key).sortWithinPartitions(key).write.format(kind).mode(mode).save(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A bucketed table: joins of tables of equal buckets on the key need no shuffle."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def in_memory(rows: DataFrame) -> DataFrame:
    """A table that the cluster keeps, on disk where memory is short; ``unpersist`` frees it."""
    kept = rows.persist()
    kept.count()
    return kept


# databases


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **properties) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key (PostgreSQL, MySQL, SQLite, Spanner and others with a driver)."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties)


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", partitions: int | None = None, **properties) -> None:
    """Rows into a database table, each task over a connection of its own."""
    (rows.coalesce(partitions) if partitions else rows).write.jdbc(url, table, mode=mode, properties=properties)


def _name(name: str) -> str:
    if not name.replace("_", "").isalnum():
        raise ValueError(f"not a name: {name}")
    return name


def read_dbapi(spark: SparkSession, connect: Callable[[], Any], table: str, key: str, schema: str, bounds: list[int]) -> DataFrame:
    """A database table over DB-API: one task for each range between whole-numbered bounds, the ends being open.

    ``connect`` makes a connection in the worker, as ``lambda: sqlite3.connect(path)``.
    """
    columns = [c.strip().split()[0].strip("`") for c in schema.split(",")]
    chosen, kinds = ", ".join(map(_name, columns)), spark.createDataFrame([], schema).schema
    edges = [None, *sorted(bounds), None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for n in batch.column("id").to_pylist():
                limits = [(op, x) for op, x in ((">=", edges[n]), ("<", edges[n + 1])) if x is not None]
                where = " AND ".join(f"{_name(key)} {op} {int(x)}" for op, x in limits) or "1 = 1"
                connection = connect()
                try:
                    cursor = connection.cursor()
                    cursor.execute(f"SELECT {chosen} FROM {_name(table)} WHERE {where} ORDER BY {_name(key)}")
                    while rows := cursor.fetchmany(BATCH_ROWS):
                        arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                finally:
                    connection.close()

    return reachable(spark).range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(run, kinds)


def write_dbapi(rows: DataFrame, connect: Callable[[], Any], table: str, key: str, mark: str = "?", tasks: int = 1) -> int:
    """Upsert rows by key over DB-API; the number written. A task that is run again writes the same rows once more, to the same effect."""
    columns = [_name(c) for c in rows.columns]
    updates = ", ".join(f"{c} = excluded.{c}" for c in columns if c != key)
    statement = f"INSERT INTO {_name(table)} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({_name(key)}) DO " + (f"UPDATE SET {updates}" if updates else "NOTHING")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection, n = connect(), 0
        try:
            for batch in batches:
                connection.cursor().executemany(statement, [tuple(r.values()) for r in batch.to_pylist()])
                connection.commit()
                n += batch.num_rows
        finally:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    reachable(rows.sparkSession)
    return rows.coalesce(tasks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


# key-value stores


@dataclass(frozen=True)
class Adapter:
    """How to use a key-value store: keys and values are bytes, a missing value is None."""

    connect: Callable[[], Any]
    get_many: Callable[[Any, list[bytes]], list[bytes | None]]
    put_many: Callable[[Any, list[tuple[bytes, bytes | None]]], None]
    scan: Callable[[Any, bytes | None, bytes | None], Iterator[tuple[bytes, bytes]]]
    close: Callable[[Any], None] = lambda connection: None


def put_pairs(rows: DataFrame, adapter: Adapter, tasks: int = 1) -> int:
    """Write (key, value) pairs; a null value deletes its key. The number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection, n = adapter.connect(), 0
        for batch in batches:
            adapter.put_many(connection, list(zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True)))
            n += batch.num_rows
        adapter.close(connection)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    pairs = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    reachable(rows.sparkSession)
    return pairs.coalesce(tasks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def get_pairs(keys: DataFrame, adapter: Adapter) -> DataFrame:
    """(ordinal, key, value) for probes (ordinal, key): in batches, repeats kept, null where a key is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = adapter.connect()
        for batch in batches:
            found = adapter.get_many(connection, batch.column("key").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["ordinal", "key", "value"])
        adapter.close(connection)

    probes = keys.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("key").cast("binary").alias("key"))
    reachable(keys.sparkSession)
    return probes.mapInArrow(run, "ordinal long, key binary, value binary").orderBy("ordinal")


def scan_pairs(spark: SparkSession, adapter: Adapter, bounds: list[bytes] = ()) -> DataFrame:
    """All pairs, one task for each key range between the bounds."""
    edges = [None, *sorted(bounds), None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = adapter.connect()
        for batch in batches:
            for n in batch.column("id").to_pylist():
                rows = []
                for pair in adapter.scan(connection, edges[n], edges[n + 1]):
                    rows.append(pair)
                    if len(rows) == BATCH_ROWS:
                        yield _pairs(rows)
                        rows = []
                if rows:
                    yield _pairs(rows)
        adapter.close(connection)

    return reachable(spark).range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(run, "key binary, value binary")


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], names=["key", "value"])


def sqlite_adapter(path: str, table: str = "pairs") -> Adapter:
    """A SQLite file that all workers reach, as a key-value store."""
    import sqlite3

    _name(table)

    def connect():
        connection = sqlite3.connect(path, timeout=60)
        connection.execute(f"CREATE TABLE IF NOT EXISTS {table} (key BLOB PRIMARY KEY, value BLOB NOT NULL) WITHOUT ROWID")
        return connection

    def get_many(connection, keys):
        found = {}
        for at in range(0, len(keys), 500):
            part = keys[at : at + 500]
            found |= dict(connection.execute(f"SELECT key, value FROM {table} WHERE key IN ({', '.join('?' * len(part))})", part))
        return [found.get(k) for k in keys]

    def put_many(connection, pairs):
        with connection:
            connection.executemany(f"INSERT INTO {table} VALUES (?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value", [p for p in pairs if p[1] is not None])
            connection.executemany(f"DELETE FROM {table} WHERE key = ?", [(k,) for k, v in pairs if v is None])

    def scan(connection, start, end):
        limits = [(op, x) for op, x in ((">=", start), ("<", end)) if x is not None]
        where = " AND ".join(f"key {op} ?" for op, _ in limits) or "1"
        yield from connection.execute(f"SELECT key, value FROM {table} WHERE {where} ORDER BY key", [x for _, x in limits])

    return Adapter(connect, get_many, put_many, scan, lambda connection: connection.close())


def redis_adapter(url: str, prefix: bytes = b"") -> Adapter:
    """A Redis server; needs the ``redis`` module on the workers. Scans walk all keys of the prefix."""

    def connect():
        import redis

        return redis.Redis.from_url(url)

    def put_many(connection, pairs):
        pipe = connection.pipeline(transaction=True)
        for k, v in pairs:
            pipe.delete(prefix + k) if v is None else pipe.set(prefix + k, v)
        pipe.execute()

    def scan(connection, start, end):
        keys = sorted(k[len(prefix) :] for k in connection.scan_iter(match=prefix + b"*"))
        inside = [k for k in keys if (start is None or k >= start) and (end is None or k < end)]
        for at in range(0, len(inside), BATCH_ROWS):
            part = inside[at : at + BATCH_ROWS]
            yield from ((k, v) for k, v in zip(part, connection.mget([prefix + k for k in part]), strict=True) if v is not None)

    return Adapter(connect, lambda connection, keys: connection.mget([prefix + k for k in keys]) if keys else [], put_many, scan, lambda connection: connection.close())


def dynamodb_adapter(table: str, **options) -> Adapter:
    """A DynamoDB table of binary ``key`` and ``value``; needs ``boto3`` on the workers."""

    def connect():
        import boto3

        return boto3.resource("dynamodb", **options).Table(table)

    def get_many(connection, keys):
        return [bytes(item["value"].value) if (item := connection.get_item(Key={"key": k}).get("Item")) else None for k in keys]

    def put_many(connection, pairs):
        with connection.batch_writer(overwrite_by_pkeys=["key"]) as writer:
            for k, v in pairs:
                writer.delete_item(Key={"key": k}) if v is None else writer.put_item(Item={"key": k, "value": v})

    def scan(connection, start, end):
        found, rest = [], {}
        while rest is not None:
            page = connection.scan(**rest)
            found += [(bytes(i["key"].value), bytes(i["value"].value)) for i in page["Items"]]
            rest = {"ExclusiveStartKey": page["LastEvaluatedKey"]} if "LastEvaluatedKey" in page else None
        yield from sorted(p for p in found if (start is None or p[0] >= start) and (end is None or p[0] < end))

    return Adapter(connect, get_many, put_many, scan)


def cosmos_adapter(url: str, credential: str, database: str, container: str) -> Adapter:
    """A Cosmos DB container whose items have the key in hexadecimal as ``id``; needs ``azure-cosmos`` on the workers."""

    def connect():
        from azure.cosmos import CosmosClient

        return CosmosClient(url, credential).get_database_client(database).get_container_client(container)

    def get(connection, key):
        found = list(connection.query_items("SELECT c['value'] FROM c WHERE c.id = @id", parameters=[{"name": "@id", "value": key.hex()}], partition_key=key.hex()))
        return bytes.fromhex(found[0]["value"]) if found else None

    def put_many(connection, pairs):
        for k, v in pairs:
            if v is not None:
                connection.upsert_item({"id": k.hex(), "value": v.hex()})
            elif get(connection, k) is not None:
                connection.delete_item(k.hex(), partition_key=k.hex())

    def scan(connection, start, end):
        limits = [(op, name, x) for op, name, x in ((">=", "@a", start), ("<", "@b", end)) if x is not None]
        where = " AND ".join(f"c.id {op} {name}" for op, name, _ in limits) or "true"
        bound = [{"name": name, "value": x.hex()} for _, name, x in limits]
        for item in connection.query_items(f"SELECT c.id, c['value'] FROM c WHERE {where} ORDER BY c.id", parameters=bound, enable_cross_partition_query=True):
            yield bytes.fromhex(item["id"]), bytes.fromhex(item["value"])

    return Adapter(connect, lambda connection, keys: [get(connection, k) for k in keys], put_many, scan)
