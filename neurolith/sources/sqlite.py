"""Tables of SQLite files as DataFrames, read by ranges of row numbers.

``spark.read.format("sqlite").option("table", "jobs").option("path", "/shared/meta.db").load()``. The file must be at the same path on
all workers. A table without row numbers (WITHOUT ROWID) and a view are one partition.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that a partition holds at most, if row numbers are dense.
ROWS_PER_PARTITION = 500_000
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Spark's and Arrow's type by the affinity that a declared type has.
AFFINITIES = (("INT", "bigint", pa.int64()), ("CHAR", "string", pa.string()), ("CLOB", "string", pa.string()), ("TEXT", "string", pa.string()), ("BLOB", "binary", pa.binary()), ("REAL", "double", pa.float64()), ("FLOA", "double", pa.float64()), ("DOUB", "double", pa.float64()))


def affinity(declared: str) -> tuple[str, pa.DataType]:
    """Types of a column by SQLite's rules on its declaration; what has none is text."""
    for part, kind, arrow in AFFINITIES:
        if part in declared.upper():
            return kind, arrow
    return "string", pa.string()


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(path: str, table: str) -> list[tuple[str, str, pa.DataType]]:
    """(name, Spark type, Arrow type) of a table's columns; raises for a table that is not there."""
    if not NAME.fullmatch(table):
        raise ValueError(f"not a table name: {table!r}")
    with connect(path) as c:
        found = [(r[1], *affinity(r[2] or "")) for r in c.execute(f"PRAGMA table_info({table})")]
    if not found:
        raise ValueError(f"no table {table!r} in {path}")
    return found


@dataclass
class _Range(InputPartition):
    first: int | None
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int):
        self.path, self.table, self.rows = path, table, rows
        self.columns = columns_of(path, table)

    def partitions(self) -> list[InputPartition]:
        try:
            with connect(self.path) as c:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        except sqlite3.OperationalError:  # no row numbers
            return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        return [_Range(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ", ".join('"' + n.replace('"', '""') + '"' for n, _, _ in self.columns)
        within = "" if partition.first is None else f" WHERE rowid BETWEEN {partition.first} AND {partition.last}"
        kinds = [k for _, _, k in self.columns]
        with connect(self.path) as c:
            cursor = c.execute(f"SELECT {names} FROM {self.table}{within}")
            while rows := cursor.fetchmany(10_000):
                values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([as_kind(v, k) for v in column], k) for column, k in zip(values, kinds, strict=True)], names=[n for n, _, _ in self.columns])


def as_kind(v, kind: pa.DataType):
    """A value in its column's type; SQLite columns may hold values of any. What cannot be turned is null."""
    try:
        if v is None or kind == pa.binary():
            return v.encode() if isinstance(v, str) else v
        return int(v) if kind == pa.int64() else float(v) if kind == pa.float64() else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """Name: sqlite. Options: path, table, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {kind}" for n, kind, _ in columns_of(self.options["path"], self.options["table"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("rows_per_partition", ROWS_PER_PARTITION)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
