"""Order-preserving key encodings; binary columns compare as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def prefix_end(prefix: bytes) -> bytes | None:
    """Smallest key above every key with this prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def prefix_range(prefix: bytes) -> tuple[bytes, bytes | None]:
    """Half-open bounds of the keys with this prefix."""
    return prefix, prefix_end(prefix)


def u64_key(value: Column) -> Column:
    """Unsigned 64-bit big-endian bytes of a non-negative integer, up to 2**64 - 1 as a decimal."""
    number = value.cast("decimal(20,0)")
    high = F.floor(number / F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
    low = (number - high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
    return F.unhex(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))


def i64_key(value: Column) -> Column:
    """Signed 64-bit integers: sign bit flipped, big endian."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(SIGN))), 16, "0"))


def timestamp_millis_key(value: Column) -> Column:
    """Milliseconds since the epoch as an unsigned key."""
    return u64_key(F.unix_millis(value.cast("timestamp")))


def wide_key(value: int, signed: bool = False) -> bytes:
    """128-bit key of a literal; signed values get the sign bit flipped."""
    return (value + (1 << 127) if signed else value).to_bytes(16, "big")


def segment(value: Column) -> Column:
    """One part of a composite key: each zero byte is followed by FF, two zero bytes end it."""
    escaped = F.regexp_replace(F.hex(value.cast("binary")), "(..)", "$1 ")
    return F.unhex(F.concat(F.replace(F.replace(escaped, F.lit("00 "), F.lit("00FF")), F.lit(" "), F.lit("")), F.lit("0000")))


def segments(*values: Column) -> Column:
    """Composite key of several parts."""
    return F.concat(*[segment(v) for v in values])


def decode_segments(key: bytes) -> list[bytes]:
    """The parts of a composite key; a cut or unknown escape is an error."""
    parts, part, at = [], bytearray(), 0
    while at < len(key):
        if key[at]:
            part.append(key[at])
            at += 1
            continue
        mark = key[at + 1] if at + 1 < len(key) else None
        if mark == 0xFF:
            part.append(0)
        elif mark == 0:
            parts.append(bytes(part))
            part = bytearray()
        else:
            raise ValueError(f"bad escape at byte {at}")
        at += 2
    if part:
        raise ValueError("the last segment doesn't end")
    return parts


def decoded_segments(key: Column) -> Column:
    """The parts of a composite key as an array of binaries; a cut or unknown escape is an error."""
    digits = F.hex(key)
    # Zero bytes stand as pairs: 0000 ends a part, 00FF is a zero byte; all other bytes stand for themselves.
    parts = F.regexp_extract_all(digits, F.lit("((?:(?!00)..|00FF)*)0000"), F.lit(1))
    whole = F.octet_length(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("0000"))), "")) == F.octet_length(digits)
    plain = F.transform(parts, lambda p: F.unhex(F.replace(F.replace(F.regexp_replace(p, "(..)", "$1 "), F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit(""))))
    return F.when(whole, plain).otherwise(F.raise_error(F.lit("not a composite key")).cast("array<binary>"))


def debug_key(key: Column) -> Column:
    """A key for people: text where all bytes are printable ASCII, else hexadecimal."""
    text = F.decode(key, "ISO-8859-1")
    return F.when(text.rlike("^[ -~]*$"), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(key))))


def is_boundary(key: Column, value: Column, mean: int, seed: int = 0) -> Column:
    """Whether a content-defined chunk ends behind a row: a hash of the row falls under a threshold, once in ``mean`` rows."""
    return F.pmod(F.xxhash64(F.lit(seed), key, value), F.lit(mean)) == 0


def printable(key: Column) -> Column:
    """Upper-case hexadecimal form of a key."""
    return F.hex(key)
