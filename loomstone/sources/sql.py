"""A SQL database over versioned tables: definitions, rows, indexes and functions of one commit.

    tables/<name>/      versions of a table's rows
    commits/<id>.json   every table's version and definition, functions, parents, message
    refs/<branch>.json  commit of a branch

Spark plans and runs the queries; a commit's tables are its temporary views.
Statements change a transaction's own state; its commit writes the changed tables
and moves the branch if nobody else has.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
import sys
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from loomstone.operators.diff import diff_versions
from loomstone.operators.integrity import foreign_key_violations, type_violations, unique_violations
from loomstone.operators.merge import align, is_conflict
from loomstone.sources.files import Files
from loomstone.sources.store import StaleRef, VersionStore
from loomstone.staging import Staged

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
ROW_ID = "_row_id"
EMPTY = {"tables": {}, "functions": {}, "parents": [], "generation": 0, "message": "", "at": 0.0}


class SerializationConflict(RuntimeError):
    """The branch moved since the transaction began."""


class ConstraintViolation(ValueError):
    """Rows that a definition forbids."""


def _checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a name: {name}")
    return name


class SqlDatabase:
    """Tables, indexes and functions on branches."""

    def __init__(self, spark: SparkSession, root: str, branch: str = "main"):
        self.spark, self.files, self.branch = spark, Files(spark, root), branch
        self.at = self.head(branch)
        self.state = self._load(self.at)
        self.rows: dict[str, DataFrame] = {}
        self.open = False

    # commits and branches

    def head(self, branch: str | None = None) -> str | None:
        found = self.files.read(f"refs/{branch or self.branch}.json")
        return json.loads(found)["commit"] if found else None

    def _load(self, commit: str | None) -> dict:
        if commit is None:
            return copy.deepcopy(EMPTY)
        found = self.files.read(f"commits/{commit}.json")
        if found is None:
            raise KeyError(f"no commit {commit}")
        return json.loads(found)

    get_commit = _load

    def resolve(self, name: str) -> str:
        """A commit by branch or by its id."""
        found = self.head(name)
        if found is None:
            self._load(name)
        return found or name

    def begin(self) -> None:
        """Start a transaction; there is one at a time."""
        if self.open:
            raise RuntimeError("a transaction is open")
        self.refresh()
        self.open = True

    def rollback(self) -> None:
        self.state, self.rows, self.open = self._load(self.at), {}, False

    def commit(self, message: str = "") -> str:
        """Write changed tables and their indexes and move the branch; on a conflict nothing moves."""
        return self._commit(message, [self.at] if self.at else [])

    def _commit(self, message: str, parents: list[str]) -> str:
        for name, rows in self.rows.items():
            if name in self.state["tables"]:
                table = self.state["tables"][name]
                version = self._store(name, table).write(rows, tuple(filter(None, [table["version"]])))
                table["version"] = version.id
                for index, spec in table["indexes"].items():
                    spec["path"] = self._write_index(name, index, spec["expression"])
        self.state |= {"parents": parents, "message": message, "at": time.time(), "generation": max((self._load(p)["generation"] for p in parents), default=0) + 1}
        body = json.dumps(self.state, sort_keys=True)
        commit = hashlib.sha256(body.encode()).hexdigest()
        self.files.create(f"commits/{commit}.json", body)
        with self.files.locked(f"locks/{self.branch}.lock"):
            if self.head() != self.at:
                raise SerializationConflict(f"{self.branch} is at {self.head()}, not {self.at}")
            self.files.replace(f"refs/{self.branch}.json", json.dumps({"commit": commit}))
        self.at, self.rows, self.open = commit, {}, False
        return commit

    def refresh(self) -> None:
        """Go to the branch's head."""
        self.at = self.head()
        self.state, self.rows = self._load(self.at), {}

    def create_branch(self, name: str, at: str | None = None) -> None:
        if not self.files.create(f"refs/{_checked(name)}.json", json.dumps({"commit": self.resolve(at) if at else self.at})):
            raise StaleRef(f"branch {name} is there")

    def branches(self) -> dict[str, str]:
        return {n.removesuffix(".json"): self.head(n.removesuffix(".json")) for n in self.files.names("refs", ".json")}

    def checkout_branch(self, name: str) -> None:
        self.branch, self.open = name, False
        self.refresh()

    def checkout(self, commit: str) -> None:
        """Look at an old commit; changes from here conflict unless the branch is reset to it."""
        self.at = self.resolve(commit)
        self.state, self.rows = self._load(self.at), {}

    def reset(self, commit: str) -> None:
        """Move the branch to a commit, whatever it holds now."""
        self.files.replace(f"refs/{self.branch}.json", json.dumps({"commit": self.resolve(commit)}))
        self.refresh()

    def ancestors(self, commit: str) -> dict[str, int]:
        """Distance of every ancestor, breadth first in the order of parents."""
        found, level, depth = {}, [commit], 0
        while level:
            found |= {c: depth for c in level if c not in found}
            level = [p for p in dict.fromkeys(p for c in level for p in self._load(c)["parents"]) if p not in found]
            depth += 1
        return found

    def log(self, limit: int = 100, start: str | None = None) -> list[tuple[str, str]]:
        """(commit, message) breadth first from the current commit."""
        at = start or self.at
        return [(c, self._load(c)["message"]) for c in list(self.ancestors(at))[:limit]] if at else []

    def is_ancestor(self, ancestor: str, descendant: str) -> bool:
        return ancestor in self.ancestors(descendant)

    def merge_base(self, a: str, b: str) -> str | None:
        x, y = self.ancestors(a), self.ancestors(b)
        return min(set(x) & set(y), key=lambda c: (-self._load(c)["generation"], x[c] + y[c], c), default=None)

    # definitions

    def schema(self, name: str) -> StructType | None:
        """The columns of a table; None if there is none."""
        table = self.state["tables"].get(name)
        return StructType.fromJson(json.loads(table["schema"])) if table else None

    def schemas(self) -> dict[str, StructType]:
        return {name: self.schema(name) for name in sorted(self.state["tables"])}

    def table_meta(self) -> DataFrame:
        """(table, key, n_columns, n_rows, n_indexes) of every table of the commit."""
        rows = []
        for name, t in sorted(self.state["tables"].items()):
            n = self._store(name, t).version(t["version"]).n_rows if t["version"] else 0
            rows.append((name, t["key"], len(json.loads(t["schema"])["fields"]), n, len(t["indexes"])))
        return self.spark.createDataFrame(rows, "table string, key string, n_columns int, n_rows long, n_indexes int")

    def create_table(self, name: str, columns: str, key: str | None = None, unique: tuple = (), references: tuple = (), required: tuple = ()) -> None:
        """A table of columns like ``id INT, name STRING``; without a key, rows get numbers. ``references`` has (column, table, column)."""
        if _checked(name) in self.state["tables"]:
            raise ValueError(f"table {name} is there")
        schema = _parse_datatype_string(columns)
        if key is None:
            schema = StructType([*_parse_datatype_string(f"{ROW_ID} BIGINT").fields, *schema.fields])
        self.state["tables"][name] = {
            "schema": schema.json(), "key": key or ROW_ID, "version": None, "sequence": 0, "indexes": {},
            "unique": [list(u) for u in unique], "references": [list(r) for r in references], "required": list({*required, key or ROW_ID}),
        }
        self.rows[name] = self.spark.createDataFrame([], schema)
        self._autocommit(f"create table {name}")

    def drop_table(self, name: str) -> None:
        del self.state["tables"][name]
        self.rows.pop(name, None)
        self._autocommit(f"drop table {name}")

    def create_index(self, table: str, name: str, expression: str) -> None:
        """A covering index: all rows in the order of an expression, stored with each commit that changes the table."""
        indexes = self.state["tables"][table]["indexes"]
        if _checked(name) in indexes:
            raise ValueError(f"index {name} is there")
        indexes[name] = {"expression": expression, "path": None}
        indexes[name]["path"] = self._write_index(table, name, expression)
        self._autocommit(f"create index {name}")

    def drop_index(self, table: str, name: str) -> None:
        del self.state["tables"][table]["indexes"][name]
        self._autocommit(f"drop index {name}")

    def _write_index(self, table: str, name: str, expression: str) -> str:
        rows = self.table(table).withColumn("_term", F.expr(expression))
        path = self.files.path(f"indexes/{table}-{name}-{time.time_ns()}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        key = self.state["tables"][table]["key"]
        rows.repartitionByRange(n, F.col("_term").asc_nulls_last(), key).sortWithinPartitions(F.col("_term").asc_nulls_last(), key).write.parquet(path)
        return path

    def create_function(self, name: str, arguments: str, returns: str, body: str) -> None:
        """A scalar SQL function; arguments like ``n INT``."""
        self.state["functions"][_checked(name)] = {"arguments": arguments, "returns": returns, "body": body}
        self._declare(name)
        self._autocommit(f"create function {name}")

    def drop_function(self, name: str) -> None:
        del self.state["functions"][name]
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {_checked(name)}")
        self._autocommit(f"drop function {name}")

    def function(self, name: str) -> dict | None:
        return self.state["functions"].get(name)

    def _declare(self, name: str) -> None:
        f = self.state["functions"][name]
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}({f['arguments']}) RETURNS {f['returns']} RETURN {f['body']}")

    # rows

    def _store(self, name: str, table: dict) -> VersionStore:
        return VersionStore(self.spark, self.files.path(f"tables/{name}"), table["key"])

    def table(self, name: str) -> DataFrame:
        """The rows of a table as the transaction sees them."""
        if name in self.rows:
            return self.rows[name]
        table = self.state["tables"][name]
        return self._store(name, table).snapshot(table["version"]) if table["version"] else self.spark.createDataFrame([], self.schema(name))

    def scan(self, name: str) -> DataFrame:
        """All rows in key order."""
        return self.table(name).orderBy(self.state["tables"][name]["key"])

    def fetch(self, name: str, key: Any):
        """The row of a key, or None."""
        return self.table(name).where(F.col(self.state["tables"][name]["key"]) == F.lit(key)).first()

    def scan_index(self, table: str, name: str, operator: str | None = None, value: Any = None, descending: bool = False) -> DataFrame:
        """Rows in the order of an index, null last and above every value, so > and >= match it."""
        spec = self.state["tables"][table]["indexes"][name]
        rows = self.table(table).withColumn("_term", F.expr(spec["expression"])) if table in self.rows else self.spark.read.parquet(spec["path"])
        if operator is not None:
            rows = rows.where(index_condition(F.col("_term"), operator, value))
        order = F.col("_term").desc_nulls_first() if descending else F.col("_term").asc_nulls_last()
        return rows.orderBy(order, self.state["tables"][table]["key"]).drop("_term")

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(name).fields])

    def _change(self, name: str, rows: DataFrame, message: str) -> None:
        broken = {k: v for k, v in self._violations({name: rows}).items()}
        if broken:
            raise ConstraintViolation(", ".join(sorted(broken)))
        self.rows[name] = rows
        self._autocommit(message)

    def append(self, name: str, rows: DataFrame) -> None:
        """Insert rows under generated numbers, which go on from the table's sequence without gaps."""
        table = self.state["tables"][name]
        own = Staged(rows.withColumn(ROW_ID, F.monotonically_increasing_id()), "append")
        part, place = F.shiftright(ROW_ID, 33), F.col(ROW_ID).bitwiseAND(F.lit((1 << 33) - 1))
        sizes = own.df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        first, before = table["sequence"], F.lit(0).cast("long")
        for r in sizes:
            before = F.when(part == r["part"], F.lit(first).cast("long")).otherwise(before)
            first += r["n"]
        numbered = own.df.withColumn(ROW_ID, before + place + 1)
        table["sequence"] = first
        self._change(name, self.table(name).unionByName(self._typed(name, numbered)), f"append to {name}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Insert new keys; one that is there is an error."""
        key = self.state["tables"][name]["key"]
        new = self._typed(name, rows)
        if new.join(self.table(name), key, "left_semi").limit(1).count():
            raise ConstraintViolation(f"{name}: a key exists")
        self._change(name, self.table(name).unionByName(new), f"insert into {name}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert rows, in place of those of their keys."""
        key, new = self.state["tables"][name]["key"], self._typed(name, rows)
        self._change(name, self.table(name).join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new), f"upsert into {name}")

    def update(self, name: str, assignments: dict[str, str], predicate: str = "true") -> None:
        """Set columns to SQL expressions where a predicate is true."""
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        out = [F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in assignments else F.col(f.name) for f in self.schema(name).fields]
        self._change(name, self.table(name).select(*out), f"update {name}")

    def delete(self, name: str, predicate: str) -> None:
        """Delete the rows for which a predicate is true."""
        self._change(name, self.table(name).where(f"NOT coalesce({predicate}, false)"), f"delete from {name}")

    def delete_keys(self, name: str, keys: list) -> None:
        self._change(name, self.table(name).where(~F.col(self.state["tables"][name]["key"]).isin(*keys)), f"delete from {name}")

    def _autocommit(self, message: str) -> None:
        if not self.open:
            self.commit(message)

    # queries

    def views(self) -> None:
        """Temporary views of all tables and functions, as the transaction sees them."""
        for name in self.state["tables"]:
            self.table(name).createOrReplaceTempView(name)
        for name in self.state["functions"]:
            self._declare(name)

    def query(self, sql: str) -> DataFrame:
        self.views()
        return self.spark.sql(sql)

    def execute(self, statement: str) -> DataFrame | None:
        """One SQL statement: a definition, a change of rows, a transaction step, or a query, which gives its rows."""
        text = statement.strip().rstrip(";")
        for pattern, run in STATEMENTS:
            if match := re.fullmatch(pattern, text, re.IGNORECASE | re.DOTALL):
                return run(self, *match.groups())
        return self.query(text)

    # comparison and merge

    def diff(self, old: str, new: str) -> dict[str, Any]:
        """Between two commits: tables added and removed, columns changed, functions changed, and rows per table."""
        a, b = self._load(self.resolve(old)), self._load(self.resolve(new))
        both = sorted(a["tables"].keys() & b["tables"].keys())
        found: dict[str, Any] = {
            "added": sorted(b["tables"].keys() - a["tables"].keys()),
            "removed": sorted(a["tables"].keys() - b["tables"].keys()),
            "schemas": {n: schema_diff(a["tables"][n]["schema"], b["tables"][n]["schema"]) for n in both if a["tables"][n]["schema"] != b["tables"][n]["schema"]},
            "functions": sorted(n for n in a["functions"].keys() | b["functions"].keys() if a["functions"].get(n) != b["functions"].get(n)),
            "rows": {},
        }
        for name in both:
            x, y = a["tables"][name], b["tables"][name]
            if x["version"] != y["version"] and x["schema"] == y["schema"]:
                store = self._store(name, x)
                packed = [r.select(x["key"], F.struct("*").alias("row")) for r in store.differing(x["version"], y["version"])]
                found["rows"][name] = diff_versions(*packed, [x["key"]], "row")
        return found

    def merge(self, other: str, message: str = "merge") -> tuple[str, Any]:
        """('merged', commit), or ('conflicts', by table and rule) with the branch unmoved.

        Rows are merged by key; a table, definition or function that both sides
        changed differently is a conflict, and so is a row that breaks a rule afterwards.
        """
        theirs = self.resolve(other)
        base = self.merge_base(self.at, theirs)
        if base == theirs:
            return "merged", self.at
        sides = [self._load(c) for c in (base, self.at, theirs)]
        trouble: dict[str, Any] = {}
        merged = copy.deepcopy(sides[1])
        for part in ("functions", "tables"):
            for name in {n for s in sides for n in s[part]}:
                was, ours, new = (s[part].get(name) for s in sides)
                plain = [_definition(x) for x in (was, ours, new)]
                if plain[2] != plain[0] and plain[1] != plain[0] and plain[1] != plain[2]:
                    trouble[f"{part} {name}"] = plain
                elif plain[2] != plain[0]:
                    merged[part].pop(name, None) if new is None else merged[part].__setitem__(name, copy.deepcopy(new))
        rows = {}
        for name, table in merged["tables"].items():
            was, ours, new = (s["tables"].get(name) for s in sides)
            if was and ours and new and new["version"] != was["version"] and f"tables {name}" not in trouble:
                key, store = table["key"], self._store(name, table)
                packed = [store.snapshot(t["version"]).select(key, F.struct("*").alias("row")) for t in (was, ours, new)]
                aligned = align(*packed, key, "row")
                if (clash := aligned.where(is_conflict())).limit(1).count():
                    trouble[f"rows {name}"] = clash
                chosen = F.when(F.col("right").eqNullSafe(F.col("base")), F.col("left")).otherwise(F.col("right"))
                rows[name] = aligned.select(chosen.alias("row")).where("row IS NOT NULL").select("row.*")
                table["sequence"] = max(ours["sequence"], new["sequence"])
        kept = self.state, self.rows
        self.state, self.rows = merged, rows
        trouble |= self._violations({n: self.table(n) for n in merged["tables"]}) if not trouble else {}
        if trouble:
            self.state, self.rows = kept
            return "conflicts", trouble
        return "merged", self._commit(message, [self.at, theirs])

    def _violations(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Rows that break a table's rules, by rule: key, UNIQUE, NOT NULL, FOREIGN KEY (null satisfies it)."""
        found = {}
        for name, own in rows.items():
            table = self.state["tables"][name]
            found[f"key {name}"] = unique_violations(own, [table["key"]])
            found |= {f"unique {name}({', '.join(u)})": unique_violations(own, u) for u in table["unique"]}
            found[f"not null {name}"] = type_violations(own, table["required"])
            for column, parent, parent_column in table["references"]:
                parents = rows.get(parent, None) if parent in rows else self.table(parent)
                found[f"foreign key {name}.{column}"] = foreign_key_violations(own, column, parents, parent_column)
        return {rule: broken for rule, broken in found.items() if broken.limit(1).count()}


def _definition(item: dict | None) -> dict | None:
    return {k: v for k, v in item.items() if k not in ("version", "sequence", "indexes")} if item else None


def index_condition(term, operator: str, value: Any):
    """A comparison in the order of an index, where null is above every value."""
    target = F.lit(value)
    found = {"=": term == target, "<": term < target, "<=": term <= target, ">": term > target, ">=": term >= target}.get(operator)
    if found is None:
        raise ValueError(f"unknown comparison {operator}")
    return found | term.isNull() if operator in (">", ">=") else found


def schema_diff(old: str, new: str) -> list[tuple[str, str | None, str | None]]:
    """Columns whose type differs between two schemas: (column, old type, new type)."""
    types = [{f["name"]: json.dumps(f["type"]).strip('"') for f in json.loads(s)["fields"]} for s in (old, new)]
    return [(c, types[0].get(c), types[1].get(c)) for c in sorted({*types[0], *types[1]}) if types[0].get(c) != types[1].get(c)]


def _create_table(db: SqlDatabase, name: str, body: str) -> None:
    columns, key, unique, references, required = [], None, [], [], []
    for part in re.split(r",(?![^(]*\))", body):
        part = part.strip()
        if m := re.fullmatch(r"PRIMARY KEY\s*\(\s*(\w+)\s*\)", part, re.IGNORECASE):
            key = m[1]
        elif m := re.fullmatch(r"UNIQUE\s*\(([^)]*)\)", part, re.IGNORECASE):
            unique.append(re.split(r"\s*,\s*", m[1].strip()))
        elif m := re.fullmatch(r"FOREIGN KEY\s*\(\s*(\w+)\s*\)\s*REFERENCES\s+(\w+)\s*\(\s*(\w+)\s*\)", part, re.IGNORECASE):
            references.append((m[1], m[2], m[3]))
        else:
            column, rest = part.split(None, 1)
            key = column if re.search(r"PRIMARY KEY", rest, re.IGNORECASE) else key
            unique += [[column]] if re.search(r"\bUNIQUE\b", rest, re.IGNORECASE) else []
            required += [column] if re.search(r"NOT NULL", rest, re.IGNORECASE) else []
            columns.append(f"{column} {re.sub(r'PRIMARY KEY|UNIQUE|NOT NULL', '', rest, flags=re.IGNORECASE).strip()}")
    db.create_table(name, ", ".join(columns), key, tuple(unique), tuple(references), tuple(required))


def _insert(db: SqlDatabase, how: str, name: str, columns: str | None, source: str) -> None:
    db.views()
    table = db.state["tables"][name]
    names = re.split(r"\s*,\s*", columns.strip()) if columns else [f.name for f in db.schema(name).fields if f.name != ROW_ID]
    rows = db.spark.sql(f"SELECT * FROM {source}" if source.upper().startswith("VALUES") else source).toDF(*names)
    if table["key"] == ROW_ID:
        db.append(name, rows)
    else:
        (db.insert if how.upper() == "INSERT" else db.upsert)(name, rows)


def _update(db: SqlDatabase, name: str, assignments: str, predicate: str | None) -> None:
    pairs = dict(re.split(r"\s*=\s*", a.strip(), maxsplit=1) for a in re.split(r",(?![^(]*\))", assignments))
    db.update(name, pairs, predicate or "true")


STATEMENTS = (
    (r"BEGIN(?:\s+TRANSACTION)?", SqlDatabase.begin),
    (r"COMMIT", lambda db: db.commit("commit") and None),
    (r"ROLLBACK", SqlDatabase.rollback),
    (r"CREATE TABLE\s+(\w+)\s*\((.*)\)", _create_table),
    (r"DROP TABLE\s+(\w+)", SqlDatabase.drop_table),
    (r"CREATE INDEX\s+(\w+)\s+ON\s+(\w+)\s*\((.*)\)", lambda db, name, table, expression: db.create_index(table, name, expression)),
    (r"DROP INDEX\s+(\w+)\s*\.\s*(\w+)", SqlDatabase.drop_index),
    (r"CREATE FUNCTION\s+(\w+)\s*\(([^)]*)\)\s*RETURNS\s+(\w+)\s+RETURN\s+(.*)", SqlDatabase.create_function),
    (r"DROP FUNCTION\s+(\w+)", SqlDatabase.drop_function),
    (r"(INSERT|UPSERT)\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*((?:VALUES|SELECT)\b.*)", _insert),
    (r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", _update),
    (r"DELETE FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", lambda db, name, predicate: db.delete(name, predicate or "true")),
)


def main(arguments: list[str]) -> None:
    """``python -m loomstone.sources.sql ROOT STATEMENT...``, or a file name behind ``-f``: run statements and show what queries give."""
    spark = SparkSession.builder.getOrCreate()
    root, *rest = arguments
    if rest[:1] == ["-f"]:
        with open(rest[1]) as source:
            rest = [s for s in source.read().split(";") if s.strip()]
    db = SqlDatabase(spark, root)
    for statement in rest:
        found = db.execute(statement)
        if found is not None:
            found.show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
