"""The document expression language, parsed on the driver into Spark columns.

Conditions have two values: a leaf over a missing attribute is false, also for
<>, so NOT of it is true. ``fields`` maps attribute names to columns of one type
each, or is a DataFrame whose columns are the attributes; the latter knows the
types, which the functions of collections need. An array is a list unless its
attribute is named as a set. #name and :value bindings are replaced before
columns are built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(<>|<=|>=|[=<>(),+\-]|\[\d+\]|\.|[:#]?[A-Za-z_][A-Za-z0-9_]*|\d+)")
COMPARISONS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class ExpressionError(ValueError):
    """The expression doesn't parse or doesn't fit its bindings."""


def tokens(text: str) -> list[str]:
    """The tokens of an expression."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = TOKEN.match(text, at)
        if not match:
            raise ExpressionError(f"unexpected text at {at}: {text[at : at + 12]!r}")
        found.append(match[1])
        at = match.end()
    return found


# Codes of attribute types; of arrays a list, of declared sets one by the type of its elements.
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
SIZED_BY_BYTES = ("S", "B")


def type_code(kind: T.DataType | None, is_set: bool = False) -> str:
    """S, N, B, BOOL, NULL, L, M, SS, NS or BS."""
    if kind is None or isinstance(kind, T.NullType):
        return "NULL"
    if isinstance(kind, NUMERIC):
        return "N"
    if isinstance(kind, T.ArrayType):
        return type_code(kind.elementType) + "S" if is_set else "L"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "M"
    return "BOOL" if isinstance(kind, T.BooleanType) else "B" if isinstance(kind, T.BinaryType) else "S"


def value_type(value: Any) -> T.DataType | None:
    """The type of a bound value; None for a column, whose type isn't known here."""
    if isinstance(value, Column):
        return None
    if isinstance(value, (set, frozenset, list, tuple)):
        first = next(iter(value), None)
        return T.ArrayType(value_type(first) or T.StringType())
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType(), type(None): T.NullType()}
    return kinds.get(type(value), T.StringType() if not hasattr(value, "as_tuple") else T.DecimalType(38, 18))


def literal(value: Any) -> Column:
    """A bound value as a column; lists and sets become arrays, sets sorted."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (set, frozenset)):
        value = sorted(value)
    return F.array(*map(literal, value)) if isinstance(value, (list, tuple)) else F.lit(value)


@dataclass
class Bindings:
    """Columns of attributes, #names and :values; records which bindings were used."""

    fields: dict[str, Column] | DataFrame
    names: dict[str, str] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)
    sets: frozenset[str] = frozenset()
    types: dict[str, T.DataType] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.fields, DataFrame):
            self.types = {f.name: f.dataType for f in self.fields.schema.fields}
            self.fields = {c: F.col(f"`{c}`") for c in self.fields.columns}

    def check_used(self) -> None:
        if unused := {*self.names, *self.values} - self.used:
            raise ExpressionError(f"unused bindings: {', '.join(sorted(unused))}")


class Parser:
    """Recursive descent over OR, AND, NOT, leaves and operands."""

    def __init__(self, text: str, bindings: Bindings):
        self.items, self.at, self.bindings = tokens(text), 0, bindings
        self.kind: T.DataType | None = None
        self.in_set = False

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected and token.upper() != expected:
            raise ExpressionError(f"expected {expected or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def word(self, name: str) -> bool:
        if self.peek().upper() == name:
            self.at += 1
            return True
        return False

    def end(self) -> None:
        if self.peek():
            raise ExpressionError(f"unexpected {self.peek()}")

    def either(self) -> Column:
        left = self.both()
        while self.word("OR"):
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.negated()
        while self.word("AND"):
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        if self.word("NOT"):
            return ~self.negated()
        if self.peek() == "(":
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        return self.leaf()

    def leaf(self) -> Column:
        name = self.peek().lower()
        if name in ("attribute_exists", "attribute_not_exists", "begins_with", "contains", "attribute_type"):
            self.take()
            self.take("(")
            first = self.operand()
            if name.startswith("attribute_") and name != "attribute_type":
                self.take(")")
                return first.isNotNull() if name == "attribute_exists" else first.isNull()
            kind, in_set = self.kind, self.in_set
            self.take(",")
            second = self.operand()
            self.take(")")
            if name == "attribute_type":
                # The tag is a constant of the column, so only presence is left to each row.
                return first.isNotNull() & (F.lit(type_code(kind, in_set)) == second) if kind is not None else F.lit(False)
            if name == "contains" and isinstance(kind, T.ArrayType):
                return _known(F.array_contains(first, second.cast(kind.elementType)))
            return _known(F.startswith(first, second) if name == "begins_with" else F.contains(first, second))
        left = self.operand()
        if self.word("BETWEEN"):
            low = self.operand()
            self.take("AND")
            return _known(left.between(low, self.operand()))
        if self.word("IN"):
            self.take("(")
            choices = [self.operand()]
            while self.word(","):
                choices.append(self.operand())
            self.take(")")
            return _known(left.isin(*choices))
        operator = self.take()
        if operator not in COMPARISONS:
            raise ExpressionError(f"unknown comparison {operator}")
        return _known(COMPARISONS[operator](left, self.operand()))

    def operand(self) -> Column:
        """An attribute path, a bound value or a size; ``kind`` and ``in_set`` tell its type."""
        if self.peek().lower() == "size" and self.items[self.at + 1 : self.at + 2] == ["("]:
            self.take()
            self.take("(")
            inner = self.operand()
            self.take(")")
            code, self.kind = type_code(self.kind) if self.kind is not None else "S", T.LongType()
            if code in SIZED_BY_BYTES:
                return F.octet_length(inner)
            if code == "L":
                return F.when(inner.isNotNull(), F.size(inner))
            if code == "M":
                return F.when(inner.isNotNull(), F.size(F.json_object_keys(F.to_json(inner))))
            return F.lit(None).cast("int")
        token = self.peek()
        if token.startswith(":"):
            self.take()
            if token not in self.bindings.values:
                raise ExpressionError(f"no value for {token}")
            self.bindings.used.add(token)
            value = self.bindings.values[token]
            self.kind, self.in_set = value_type(value), isinstance(value, (set, frozenset))
            return literal(value)
        return self.path()[1]

    def path(self) -> tuple[list[str], Column]:
        """An attribute path and its column; parts are names and [n]. A path that the type doesn't have is missing."""
        parts = [self._name()]
        column, kind = self.bindings.fields.get(parts[0], F.lit(None)), self.bindings.types.get(parts[0])
        known = kind is not None
        while self.peek() == "." or self.peek().startswith("["):
            token = self.take()
            part = token if token != "." else self._name()
            parts.append(part)
            column, kind = step(column, kind, part) if known else (F.get(column, F.lit(int(part[1:-1]))) if part.startswith("[") else column[part], None)
        self.kind, self.in_set = kind, parts[-1] in self.bindings.sets and len(parts) == 1
        return parts, column

    def _name(self) -> str:
        token = self.take()
        if token.startswith("#"):
            if token not in self.bindings.names:
                raise ExpressionError(f"no name for {token}")
            self.bindings.used.add(token)
            return self.bindings.names[token]
        if not re.fullmatch(r"[A-Za-z_]\w*", token):
            raise ExpressionError(f"not a name: {token}")
        return token


def step(column: Column, kind: T.DataType | None, part: str) -> tuple[Column, T.DataType | None]:
    """One part further along a path of known type; a part that can't be there is null."""
    if part.startswith("["):
        return (F.get(column, F.lit(int(part[1:-1]))), kind.elementType) if isinstance(kind, T.ArrayType) else (F.lit(None), T.NullType())
    if isinstance(kind, T.MapType):
        return column[part], kind.valueType
    if isinstance(kind, T.StructType) and part in kind.names:
        return column[part], kind[part].dataType
    return F.lit(None), T.NullType()


def _known(leaf: Column) -> Column:
    return F.coalesce(leaf, F.lit(False))


def condition(text: str, fields: dict[str, Column] | DataFrame, names: dict[str, str] | None = None, values: dict[str, Any] | None = None, sets: frozenset[str] = frozenset()) -> Column:
    """A filter or condition expression as a boolean column that is never null."""
    bindings = Bindings(fields, names or {}, values or {}, sets=sets)
    parser = Parser(text, bindings)
    built = parser.either()
    parser.end()
    bindings.check_used()
    return built


def key_condition(text: str, partition: str, sort: str | None, fields: dict[str, Column] | DataFrame, values: dict[str, Any], names: dict[str, str] | None = None) -> Column:
    """partition = value, and optionally one comparison of the sort attribute."""
    bindings = Bindings(fields, names or {}, values)
    found = _key_condition(text, partition, sort, bindings)
    bindings.check_used()
    return found


def _key_condition(text: str, partition: str, sort: str | None, bindings: Bindings) -> Column:
    parser, found = Parser(text, bindings), {}
    while True:
        start = parser.at
        column = parser.leaf()
        token = parser.items[start]
        name = parser.items[start + 2] if token.lower() == "begins_with" else token
        name = bindings.names.get(name, name)
        if name in found or name not in (partition, sort) or name == partition and parser.items[start + 1] != "=" or "<>" in parser.items[start : parser.at]:
            raise ExpressionError(f"not a key condition: {text}")
        found[name] = column
        if not parser.word("AND"):
            break
    parser.end()
    if partition not in found:
        raise ExpressionError("the partition key needs =")
    return found[partition] & found[sort] if sort in found else found[partition]


@dataclass
class ReadExpressions:
    """The expressions of one read: which items, which of them are shown, and what of them."""

    key: Column | None
    filter: Column | None
    shown: list[Column] | None


def read_expressions(
    fields: dict[str, Column] | DataFrame, partition: str, sort: str | None, key: str | None = None, filter_: str | None = None,
    project: str | None = None, names: dict[str, str] | None = None, values: dict[str, Any] | None = None, sets: frozenset[str] = frozenset(),
) -> ReadExpressions:
    """Key condition, filter and projection over the same bindings, all of which must be used; a filter may not name a key attribute."""
    bindings = Bindings(fields, names or {}, values or {}, sets=sets)
    by_key = _key_condition(key, partition, sort, bindings) if key else None
    found = None
    if filter_:
        parser = Parser(filter_, bindings)
        found = parser.either()
        parser.end()
        named = {bindings.names.get(t, t) for k, t in enumerate(parser.items) if parser.items[k - 1 : k] != ["."]}
        if key and named & {partition, sort}:
            raise ExpressionError("a filter can't name a key attribute")
    shown = _projection(project, bindings) if project else None
    bindings.check_used()
    return ReadExpressions(by_key, found, shown)


def projection(text: str, fields: dict[str, Column] | DataFrame, names: dict[str, str] | None = None) -> list[Column]:
    """Columns of a comma-separated list of paths; overlapping paths are an error."""
    bindings = Bindings(fields, names or {})
    found = _projection(text, bindings)
    bindings.check_used()
    return found


def _projection(text: str, bindings: Bindings) -> list[Column]:
    parser = Parser(text, bindings)
    paths = [parser.path()]
    while parser.word(","):
        paths.append(parser.path())
    parser.end()
    for i, (a, _) in enumerate(paths):
        for b, _ in paths[i + 1 :]:
            if a[: len(b)] == b or b[: len(a)] == a:
                raise ExpressionError(f"paths overlap: {'.'.join(a)} and {'.'.join(b)}")
    return [column.alias(parts[-1] if len(parts) == 1 else "_".join(p.strip("[]") for p in parts)) for parts, column in paths]


def update(text: str, fields: dict[str, Column] | DataFrame, keys: set[str], names: dict[str, str] | None = None, values: dict[str, Any] | None = None) -> dict[str, Column]:
    """New columns by attribute for SET, REMOVE, ADD and DELETE.

    Paths may go into structs, maps and lists where ``fields`` is a DataFrame.
    Operands read the attributes as they were. Two actions on overlapping paths,
    or any on a key, are errors; so is a part that a struct doesn't have. SET behind
    the end of a list appends; REMOVE takes list elements out by their old places.
    """
    bindings = Bindings(fields, names or {}, values or {})
    parser = Parser(text, bindings)
    edits: list[tuple[list[str], str, Column | None]] = []

    def value() -> Column:
        name = parser.peek().lower()
        if name in ("if_not_exists", "list_append"):
            parser.take()
            parser.take("(")
            first = value()
            parser.take(",")
            second = value()
            parser.take(")")
            return F.coalesce(first, second) if name == "if_not_exists" else F.concat(first, second)
        return parser.operand()

    def assigned() -> Column:
        left = value()
        while parser.peek() in ("+", "-"):
            sign = parser.take()
            left = left + value() if sign == "+" else left - value()
        return left

    def clause(kind: str) -> None:
        parts, old = parser.path()
        is_array = isinstance(parser.kind, T.ArrayType)
        overlapping = any(a[: len(parts)] == parts or parts[: len(a)] == a for a, _, _ in edits)
        if overlapping or parts[0] in keys or len(parts) > 1 and parts[0] not in bindings.types:
            raise ExpressionError(f"can't update {'.'.join(parts)}")
        if kind == "SET":
            parser.take("=")
            edits.append((parts, "set", assigned()))
        elif kind == "REMOVE":
            edits.append((parts, "remove", None))
        else:
            operand = parser.operand()
            added = set_union(old, operand) if is_array or isinstance(parser.kind, T.ArrayType) else F.coalesce(old, F.lit(0)) + operand
            edits.append((parts, "set", added if kind == "ADD" else set_difference(old, operand)))

    while kind := parser.peek().upper():
        if kind not in ("SET", "REMOVE", "ADD", "DELETE"):
            raise ExpressionError(f"unknown clause {kind}")
        parser.take()
        clause(kind)
        while parser.word(","):
            clause(kind)
    bindings.check_used()
    changed = {}
    for top in dict.fromkeys(parts[0] for parts, _, _ in edits):
        mine = [(parts[1:], action, column) for parts, action, column in edits if parts[0] == top]
        changed[top] = _edited(bindings.fields.get(top, F.lit(None)), bindings.types.get(top), mine)
    return changed


def _edited(column: Column, kind: T.DataType | None, edits: list[tuple[list[str], str, Column | None]]) -> Column:
    """A value after edits of paths inside it."""
    if not edits[0][0]:
        return edits[0][2] if edits[0][1] == "set" else F.lit(None)
    inner = {}
    for parts, action, new in edits:
        inner.setdefault(parts[0], []).append((parts[1:], action, new))
    if isinstance(kind, T.ArrayType):
        return _edited_list(column, kind, {int(p[1:-1]): e for p, e in inner.items()})
    if isinstance(kind, T.MapType):
        changed = {name: _edited(column[name], kind.valueType, e).cast(kind.valueType) for name, e in inner.items()}
        kept = F.map_filter(column, lambda k, _: ~k.isin(*inner))
        new = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in changed.items()]), lambda x: x["value"].isNotNull())
        return F.map_concat(F.coalesce(kept, F.create_map().cast(kind)), F.map_from_entries(new).cast(kind))
    if not isinstance(kind, T.StructType) or set(inner) - set(kind.names):
        raise ExpressionError(f"no part {', '.join(inner)} here")
    parts = [(_edited(column[f.name], f.dataType, inner[f.name]).cast(f.dataType) if f.name in inner else column[f.name]).alias(f.name) for f in kind.fields]
    return F.struct(*parts)


def _edited_list(column: Column, kind: T.ArrayType, edits: dict[int, list]) -> Column:
    gone = [i for i, e in edits.items() if e[0] == ([], "remove", None)]
    changed = {i: _edited(F.get(column, F.lit(i)), kind.elementType, e).cast(kind.elementType) for i, e in edits.items() if i not in gone}

    def place(x: Column, i: Column) -> Column:
        for at, new in changed.items():
            x = F.when(i == at, new).otherwise(x)
        return F.struct(i.alias("i"), x.alias("x"))

    kept = F.filter(F.transform(column, place), lambda p: ~p["i"].isin(gone) if gone else F.lit(True))
    behind = [F.when(F.size(column) <= at, new) for at, new in sorted(changed.items())]
    loose = T.ArrayType(kind.elementType, True)
    tail = F.filter(F.array(*behind), lambda x: x.isNotNull()) if behind else F.array()
    return F.concat(F.transform(kept, lambda p: p["x"]), tail.cast(loose))


def set_union(a: Column, b: Column) -> Column:
    """Sorted distinct union of two sets, either of which may be missing."""
    return F.when(a.isNull(), F.array_sort(F.array_distinct(b))).otherwise(F.array_sort(F.array_union(a, F.coalesce(b, a))))


def set_difference(a: Column, b: Column) -> Column:
    """Sorted difference; a set without elements is a missing attribute."""
    left = F.array_sort(F.array_except(a, b))
    return F.when(F.size(left) > 0, left)
