"""SRC-22: tables of SQLite files as a Spark data source, read in parts by ranges of rowid, with filters pushed down.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").options(path="/shared/cache.db", table="cache_entries", parts=16).load()

The file must lie where all executors can open it; it is opened read-only. With the option pushdown=true, which needs
spark.sql.python.filterPushdown.enabled, comparisons, IN, and tests for null reach SQLite (text compares by bytes on both sides). Types come from the
declared ones: INTEGER is long, REAL double, BLOB binary, all others string. Values of other types than declared are cast by SQLite.
A table without rowid, or without rows, is one part.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _kind(declared: str) -> str:
    declared = declared.upper()
    return "bigint" if "INT" in declared else "double" if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in declared else "string"


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=30)


@dataclass
class Range(InputPartition):
    """Rows of rowid from ``low`` to ``high``, both included; all rows where there are no rowids."""

    low: int | None
    high: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts
        self.where: list[str] = []
        self.values: list = []

    def partitions(self) -> list[Range]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]
        if low is None:
            return [Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        casts = {"bigint": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
        what = ", ".join(f"CAST({_name(c)} AS {casts[k]})" for c, k in self.columns)
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {what} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that SQLite applies; Spark applies the others."""
        known = {c for c, _ in self.columns}
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) != 1 or column[0] not in known or any(not isinstance(v, (int, float, str, bytes)) for v in self._operands(f)):
                yield f
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{_name(column[0])} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif isinstance(f, In):
                self.where.append(f"{_name(column[0])} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif type(f) in _SIGNS:
                self.where.append(f"{_name(column[0])} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            else:
                yield f

    @staticmethod
    def _operands(f: Filter):
        return f.value if isinstance(f, In) else [f.value] if hasattr(f, "value") else []


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as db:
            found = [(c, _kind(t)) for _, c, t, *_ in db.execute(f"PRAGMA table_info({_name(self.options['table'])})")]
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return found

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in self._columns())

    def reader(self, schema) -> Reader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return kind(self.options["path"], self.options["table"], self._columns(), int(self.options.get("parts", 8)))
