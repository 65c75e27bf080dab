"""A Spark data source of SQLite tables: ``spark.read.format("sqlite3").option("table", name).load(path)``.

Rows are read in ranges of rowid, one partition each, on the executors, which must see the file.
Comparisons of one column with a value are answered by the database. As a stream a table that only
grows is followed by rowid: the checkpoint keeps the last one, from which a later run goes on.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from tallyspark.plans.session import ship_code

KINDS = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.where.append((f"{_name(f.attribute[0])} {OPERATORS[type(f)]} ?", f.value))
            elif isinstance(f, (IsNull, IsNotNull)) and len(f.attribute) == 1:
                self.where.append((f"{_name(f.attribute[0])} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", None))
            else:
                yield f

    def partitions(self):
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        tests = ["rowid BETWEEN ? AND ?", *[t for t, _ in self.where]]
        values = [part.low, part.high, *[v for t, v in self.where if "?" in t]]
        with _opened(self.path) as db:
            yield from db.execute(f"SELECT {', '.join(map(_name, self.columns))} FROM {_name(self.table)} WHERE {' AND '.join(tests)}", values)


class _StreamReader(DataSourceStreamReader):
    """Rows after an offset (the last rowid read) up to the last one there is."""

    def __init__(self, path: str, table: str, columns: list[str], parts: int, after: int):
        self.rows, self.after = _Reader(path, table, columns, parts), after

    def initialOffset(self):
        return {"rowid": self.after}

    def latestOffset(self):
        with _opened(self.rows.path) as db:
            last = db.execute(f"SELECT max(rowid) FROM {_name(self.rows.table)}").fetchone()[0]
        return {"rowid": self.after if last is None else max(last, self.after)}

    def partitions(self, start: dict, end: dict):
        low, high = start["rowid"] + 1, end["rowid"]
        step = max(1, -(-(high - low + 1) // self.rows.parts))
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, part: _Range) -> Iterator[tuple]:
        return self.rows.read(part)


class SQLiteTable(DataSource):
    @classmethod
    def name(cls):
        return "sqlite3"

    def schema(self):
        with _opened(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        kind = lambda t: next((v for k, v in KINDS.items() if k in t.upper()), "string")
        return ", ".join(f"`{r[1]}` {kind(r[2])}" for r in rows)

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema.names, int(self.options.get("partitions", "4")))

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("partitions", "4")), int(self.options.get("after", "0")))


def follow(spark: SparkSession, path: str, table: str, after: int = 0, partitions: int = 4) -> DataFrame:
    """The table as a stream of the rows after ``after`` (a rowid); a run that has a checkpoint goes on from there."""
    ship_code(spark)
    spark.dataSource.register(SQLiteTable)
    return spark.readStream.format("sqlite3").option("table", table).option("partitions", str(partitions)).option("after", str(after)).load(path)


def read(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    ship_code(spark)
    spark.dataSource.register(SQLiteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite3").option("table", table).option("partitions", str(partitions)).load(path)
