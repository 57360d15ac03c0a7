"""Value encodings: JSON, versioned envelopes, timestamped values and large values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_BYTES = 4096


def encode_json(value: Column) -> Column:
    """A struct, map or array as JSON bytes."""
    return F.to_json(value).cast("binary")


def decode_json(value: Column, schema: str) -> Column:
    """JSON bytes as a typed value; null where it doesn't parse."""
    return F.from_json(value.cast("string"), schema)


def envelope(payload: Column, schema: str, version: int, encoding: str = "json") -> Column:
    """A payload with the name and version of its schema."""
    return F.struct(F.lit(schema).alias("schema"), F.lit(version).cast("long").alias("version"), F.lit(encoding).alias("encoding"), payload.alias("payload"))


def require_schema(enveloped: Column, schema: str, version: int) -> Column:
    """The payload; raises if the envelope names another schema or version."""
    fits = (enveloped["schema"] == schema) & (enveloped["version"] == version)
    return F.when(fits, enveloped["payload"]).otherwise(F.raise_error(F.lit(f"value isn't of schema {schema} version {version}")))


def matches_schema(enveloped: Column, schema: str, version: int) -> Column:
    """Whether an envelope names a schema and version."""
    return (enveloped["schema"] == schema) & (enveloped["version"] == version)


def envelope_bytes(enveloped: Column) -> Column:
    """An envelope as bytes: JSON with the payload in base 64."""
    text = F.struct(enveloped["schema"].alias("schema"), enveloped["version"].alias("version"), enveloped["encoding"].alias("encoding"), F.base64(enveloped["payload"].cast("binary")).alias("payload"))
    return F.to_json(text).cast("binary")


def envelope_of(value: Column) -> Column:
    """The envelope in bytes; null where they aren't one."""
    found = F.from_json(value.cast("string"), "schema string, version long, encoding string, payload string")
    fields = [found[f].alias(f) for f in ("schema", "version", "encoding")]
    return F.when(found["schema"].isNotNull(), F.struct(*fields, F.unbase64(found["payload"]).alias("payload")))


def migrate(rows: DataFrame, column: str, steps: dict[int, Column], schema: str, newest: int) -> DataFrame:
    """Payloads of enveloped values brought up to a version, one step for each older version on the way.

    ``steps[n]`` makes the payload of version n + 1 from the column ``payload`` of version n.
    """
    out = rows.withColumn("version", F.col(column)["version"]).withColumn("payload", F.col(column)["payload"])
    for version in sorted(v for v in steps if v < newest):
        due = F.col("version") == version
        out = out.withColumns({"payload": F.when(due, steps[version]).otherwise(F.col("payload")), "version": F.when(due, version + 1).otherwise(F.col("version"))})
    done = F.when(F.col("version") == newest, F.col("payload")).otherwise(F.raise_error(F.lit(f"no way to version {newest}")).cast(dict(out.dtypes)["payload"]))
    return out.withColumn(column, envelope(done, schema, newest)).drop("version", "payload")


def with_timestamp(value: Column, micros: Column) -> Column:
    """Bytes of a value followed by its timestamp, 8 bytes big endian."""
    return F.concat(value.cast("binary"), F.unhex(F.lpad(F.hex(micros.cast("long")), 16, "0")))


def timestamp_of(value: Column) -> Column:
    """The timestamp behind a value; 0 where it is too short to have one."""
    tail = F.hex(F.substring(value, F.octet_length(value) - 7, F.lit(8)))
    return F.when(F.octet_length(value) >= 8, F.conv(tail, 16, 10).cast("decimal(20,0)").cast("long")).otherwise(F.lit(0).cast("long"))


def bytes_of(value: Column) -> Column:
    """The value without its timestamp."""
    return F.substring(value, F.lit(1), F.greatest(F.octet_length(value) - 8, F.lit(0)))


def split_large(rows: DataFrame, threshold: int = INLINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(references, blobs): values longer than the threshold leave a digest and a length behind."""
    large, digest = F.octet_length("value") > threshold, F.sha2(F.col("value").cast("binary"), 256)
    inline = F.when(~large, F.col("value"))
    refs = rows.select("key", inline.alias("inline"), F.when(large, digest).alias("cid"), F.octet_length("value").cast("long").alias("n_bytes"))
    blobs = rows.where(large).select(digest.alias("cid"), F.col("value").alias("payload")).dropDuplicates(["cid"])
    return refs, blobs


def reclaimable_blobs(blobs: DataFrame, *kept: DataFrame) -> DataFrame:
    """Digests of blobs that no kept version's references name."""
    live = kept[0].select("cid")
    for refs in kept[1:]:
        live = live.unionByName(refs.select("cid"))
    return blobs.select("cid").join(live.dropna().distinct(), "cid", "left_anti")


def join_large(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Keys with their values, wherever those are kept; only references to blobs are joined, inline values stay where they lie."""
    inline = refs.where(F.col("cid").isNull()).select("key", F.col("inline").alias("value"))
    large = refs.where(F.col("cid").isNotNull()).join(blobs, "cid", "left").select("key", F.coalesce("inline", "payload").alias("value"))
    return inline.unionByName(large)
