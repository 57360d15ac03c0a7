"""CBOR (RFC 8949) values: integers, floats, text, bytes, lists, maps, booleans and null, in Arrow batches."""

from __future__ import annotations

import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.workers import reachable


def _head(major: int, n: int) -> bytes:
    for code, size, limit in ((24, "B", 1 << 8), (25, "H", 1 << 16), (26, "I", 1 << 32), (27, "Q", 1 << 64)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < limit:
            return bytes([major << 5 | code]) + struct.pack(f">{size}", n)
    raise ValueError("integer too large")


def dumps(value: Any) -> bytes:
    """Encode a value; maps keep their order."""
    if value is None or value is True or value is False:
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes | bytearray):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(dumps, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    raise TypeError(f"can't encode {type(value)}")


def loads(data: bytes) -> Any:
    """Decode one value; bytes behind it are an error."""
    value, at = _read(bytes(data), 0)
    if at != len(data):
        raise ValueError("bytes behind the value")
    return value


def _read(data: bytes, at: int) -> tuple[Any, int]:
    if at >= len(data):
        raise ValueError("the value is cut off")
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if low == 27:
            return struct.unpack_from(">d", data, at)[0], at + 8
        if low == 26:
            return struct.unpack_from(">f", data, at)[0], at + 4
        if low in (20, 21, 22):
            return {20: False, 21: True, 22: None}[low], at
        raise ValueError(f"unknown simple value {low}")
    n = low
    if low >= 24:
        if low > 27:
            raise ValueError("indefinite lengths aren't read")
        size = 1 << (low - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major in (2, 3):
        if at + n > len(data):
            raise ValueError("the value is cut off")
        raw = data[at : at + n]
        return (raw if major == 2 else raw.decode()), at + n
    if major == 6:
        return _read(data, at)
    items = []
    for _ in range(n * (2 if major == 5 else 1)):
        item, at = _read(data, at)
        items.append(item)
    return (items if major == 4 else dict(zip(items[::2], items[1::2], strict=True))), at


def encode_json_as_cbor(value: Column) -> Column:
    """JSON text as CBOR bytes."""
    reachable()
    import json

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dumps(json.loads(t)))

    return run(value)


def decode_cbor_as_json(value: Column) -> Column:
    """CBOR bytes as JSON text, for ``from_json``; byte strings aren't JSON and are an error."""
    reachable()
    import json

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None else json.dumps(loads(b), ensure_ascii=False))

    return run(value)
