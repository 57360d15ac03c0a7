"""Exact decimals of 38 digits with exponents from -130 to 125, as text in Arrow batches.

Where one scale fits a column, DECIMAL(38, s) is faster and should be used; these
functions are for numbers of any scale.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal, Inexact, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.workers import reachable

DIGITS, LEAST, MOST = 38, -130, 125
EXACT = Context(prec=DIGITS, traps=[Inexact, InvalidOperation])


def parse(text: str) -> Decimal:
    """A number within the limits; more digits or another size are an error."""
    number = EXACT.create_decimal(text)
    if not number.is_finite() or number and not LEAST <= number.adjusted() <= MOST:
        raise ValueError(f"number out of range: {text}")
    return number.normalize(EXACT) if number else Decimal(0)


def to_text(number: Decimal) -> str:
    """Canonical form: no exponent where it is short, no trailing zeros."""
    return format(number, "f") if -20 <= number.adjusted() <= 40 else str(number)


def ordered_bytes(number: Decimal) -> bytes:
    """Bytes that sort as the numbers do."""
    if not number:
        return b"\x80"
    sign, digits, _ = number.as_tuple()
    body = bytes([number.adjusted() - LEAST]) + bytes(d + 1 for d in digits)
    return b"\xc0" + body + b"\x00" if not sign else b"\x40" + bytes(255 - b for b in body) + b"\xff"


def _binary(function: Callable[[Decimal, Decimal], object], kind: str) -> Callable[[Column, Column], Column]:
    def apply(a: Column, b: Column) -> Column:
        reachable()

        @F.pandas_udf(kind)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else function(parse(p), parse(q)) for p, q in zip(x, y, strict=True)])

        return run(a, b)

    return apply


add = _binary(lambda x, y: to_text(parse(str(EXACT.add(x, y)))), "string")
subtract = _binary(lambda x, y: to_text(parse(str(EXACT.subtract(x, y)))), "string")
compare = _binary(lambda x, y: (x > y) - (x < y), "int")


def sort_key(value: Column) -> Column:
    """Sort key of a number in text form."""
    reachable()

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ordered_bytes(parse(t)))

    return run(value)
