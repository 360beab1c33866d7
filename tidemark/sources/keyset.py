"""Tables of a database as a Spark data source, ``spark.read.format("keyset")`` and ``readStream``, paged by keyset.

A batch read splits the table into ranges, one task each; a task asks for one page after another, each beginning after the last
key of the one before, so it holds ``page`` rows whatever its range has.  No page is found by an offset.

* ``order=id`` (a full load) ranges and pages by the primary key alone.  Ranges are of equal width between its smallest and
  largest value, the outer ones open; a key that is no whole number is one range.
* ``order=time`` (an incremental load) does so by (time, id).  Rows without a time are in no range of times, and are not read.

Comparisons of columns with values reach the database's WHERE, and Spark checks them again; so do ranges' ends.
The columns are those of the schema that the reader gives: no others are asked for, and private ones are refused.

A stream's offset is the key of the newest row, (time, id), and a batch is what lies between two offsets, in ranges.  With ``overlap``
(seconds) each batch reads that much before its start again, so that rows which came late are seen; those it has seen before
repeat, for a sink that upserts by id.  Late rows wait for the next newer row.  The first batch begins at ``start``, or with the first row.

Options: ``connect`` ("module:function", importable on the executors, which gives a DB-API connection for the options named ``arg.*``),
``table``, ``time``, ``id``, ``order``, ``partitions`` (8), ``page`` (20,000), ``start``, ``overlap`` (0).  Times are timestamps without
a zone; a database without such a type holds them as ISO texts ('2024-01-15 09:00:00'), with ``times=text``.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import importlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .etl import PRIVATE

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: How a driver marks a parameter, by its ``paramstyle``.
MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s"}

Clause = tuple[str, tuple]


@dataclass
class Range(InputPartition):
    """Where clauses of one task, all of which hold."""

    clauses: tuple[Clause, ...]


class Database:
    """The options, and the statements that they make."""

    def __init__(self, schema: T.StructType, options: dict):
        private = sorted(set(schema.names) & set(PRIVATE))
        if private:
            raise ValueError(f"private columns stay where they are: {', '.join(private)}")
        if any(isinstance(f.dataType, T.TimestampType) for f in schema):
            raise ValueError("times are timestamps without a zone (timestamp_ntz)")
        get = {k.lower(): v for k, v in options.items()}.get
        self.schema, self.table, self.time, self.id = schema, get("table"), get("time"), get("id", "id")
        for name in (*schema.names, self.id, *([self.time] if self.time else []), *str(self.table).split(".")):
            if not re.fullmatch(r"\w+", name):
                raise ValueError(f"not a name: {name!r}")
        self.order = get("order", "id")
        if self.order not in ("id", "time") or (self.order == "time" and not self.time):
            raise ValueError("order is 'id', or 'time' with the column in the option time")
        self.key = (self.id,) if self.order == "id" else (self.time, self.id)
        self.partitions, self.page, self.overlap = int(get("partitions", 8)), int(get("page", 20_000)), float(get("overlap", 0))
        self.start, self.texts, self.factory = get("start"), get("times") == "text", get("connect")
        self.args = {k[4:]: v for k, v in options.items() if k.lower().startswith("arg.")}

    def value(self, v: object) -> object:
        """A value as the database takes it."""
        return v.isoformat(" ") if self.texts and isinstance(v, dt.datetime) else v

    def compared(self, column: str, sign: str, value: object) -> Clause:
        return f'"{column}" {sign} ?', (self.value(value),)

    def after(self, key: Sequence) -> Clause:
        """Rows beyond a key: on a pair spelt so that an index on it serves."""
        if len(key) == 1:
            return self.compared(self.key[0], ">", key[0])
        a, b = self.key
        return f'"{a}" >= ? and ("{a}" > ? or "{b}" > ?)', (self.value(key[0]), self.value(key[0]), key[1])

    def upto(self, key: Sequence) -> Clause:
        a, b = self.key
        return f'"{a}" <= ? and ("{a}" < ? or "{b}" <= ?)', (self.value(key[0]), self.value(key[0]), key[1])

    def connection(self):
        module, function = self.factory.split(":")
        return getattr(importlib.import_module(module), function)(**self.args)

    def rows(self, connection, what: str, clauses: Sequence[Clause], tail: str = "") -> list[tuple]:
        mark = MARKS[getattr(importlib.import_module(self.factory.split(":")[0]), "paramstyle", "qmark")]
        where = " and ".join(f"({text})" for text, _ in clauses) or "1 = 1"
        cursor = connection.cursor()
        cursor.execute(f"select {what} from {self.table} where {where} {tail}".replace("?", mark), tuple(v for _, values in clauses for v in values))
        return cursor.fetchall()

    def first(self, what: str, clauses: Sequence[Clause], tail: str = "") -> tuple | None:
        with contextlib.closing(self.connection()) as connection:
            return next(iter(self.rows(connection, what, clauses, tail)), None)

    def moment(self, v: object) -> object:
        return dt.datetime.fromisoformat(v) if isinstance(v, str) else v

    def ranges(self, clauses: Sequence[Clause] = ()) -> list[Range]:
        """Ranges of the first column of the key, of equal width."""
        first, clauses = self.key[0], tuple(clauses)
        low, high = self.first(f'min("{first}"), max("{first}")', clauses)
        if self.order == "time":
            low, high = self.moment(low), self.moment(high)
        if low is None or low == high or not isinstance(low, (int, dt.datetime)):
            cuts = []
        elif isinstance(low, int):
            cuts = sorted({low + (high - low) * i // self.partitions for i in range(1, self.partitions)} - {low})
        else:
            cuts = sorted({(low + (high - low) * i / self.partitions).replace(microsecond=0) for i in range(1, self.partitions)} - {low})
        ends = [None, *cuts, None]
        found = []
        for a, b in zip(ends, ends[1:], strict=False):
            own = [] if a is None else [self.compared(first, ">=", a)]
            own += [] if b is None else [self.compared(first, "<", b)]
            found.append(Range((*clauses, *own)))
        return found

    def pages(self, clauses: tuple[Clause, ...]) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        asked = [*names, *(k for k in self.key if k not in names)]
        at, order = [asked.index(k) for k in self.key], ", ".join(f'"{k}"' for k in self.key)
        what = ", ".join(f'"{c}"' for c in asked)
        arrow = to_arrow_schema(self.schema)
        moments = [isinstance(f.dataType, T.TimestampNTZType) for f in self.schema]
        # A row without a key would end the paging: none is read.
        clauses, last = (*clauses, *((f'"{k}" is not null', ()) for k in self.key)), None
        with contextlib.closing(self.connection()) as connection:
            while True:
                rows = self.rows(connection, what, clauses if last is None else (*clauses, self.after(last)), f"order by {order} limit {self.page}")
                if rows:
                    columns = list(zip(*rows, strict=True))[: len(names)]
                    values = [[self.moment(v) for v in c] if moment else c for c, moment in zip(columns, moments, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)
                    last = [self.moment(rows[-1][i]) if self.key[n] == self.time else rows[-1][i] for n, i in enumerate(at)]
                if len(rows) < self.page:
                    return


class KeysetReader(DataSourceReader):
    def __init__(self, database: Database):
        self.database, self.clauses = database, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1:
                name = f.attribute[0]
                if type(f) in COMPARED and self.taken(f.value):
                    self.clauses.append(self.database.compared(name, COMPARED[type(f)], f.value))
                elif isinstance(f, In) and f.value and all(self.taken(v) for v in f.value):
                    self.clauses.append((f'"{name}" in ({", ".join("?" * len(f.value))})', tuple(self.database.value(v) for v in f.value)))
                elif isinstance(f, (IsNull, IsNotNull)):
                    self.clauses.append((f'"{name}" is {"not " if isinstance(f, IsNotNull) else ""}null', ()))
            yield f

    @staticmethod
    def taken(v: object) -> bool:
        """Values that a database compares as Spark does: no texts, whose order depends on a collation."""
        return isinstance(v, (int, float, dt.datetime)) and not isinstance(v, bool) and v == v and getattr(v, "tzinfo", None) is None

    def partitions(self) -> list[Range]:
        return self.database.ranges(self.clauses)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.database.pages(partition.clauses)


class KeysetStream(DataSourceStreamReader):
    """Offsets are {"time": ISO text or null, "id": value or null}, the key of the last row that a batch includes."""

    def __init__(self, database: Database):
        self.database = database

    def initialOffset(self) -> dict:
        return {"time": self.database.start, "id": None}

    def latestOffset(self) -> dict:
        d = self.database
        newest = d.first(f'"{d.time}", "{d.id}"', [(f'"{d.time}" is not null and "{d.id}" is not null', ())], f'order by "{d.time}" desc, "{d.id}" desc limit 1')
        return {"time": d.moment(newest[0]).isoformat(), "id": newest[1]} if newest else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        d = self.database
        if end["time"] is None or end["id"] is None or start == end:
            return []
        clauses = [d.upto((d.moment(end["time"]), end["id"]))]
        if start["time"] is not None:
            begin = d.moment(start["time"])
            if start["id"] is None or d.overlap:
                clauses.append(d.compared(d.time, ">=", begin - dt.timedelta(seconds=d.overlap)))
            else:
                clauses.append(d.after((begin, start["id"])))
        return d.ranges(clauses)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.database.pages(partition.clauses)


class Keyset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> T.StructType:
        raise ValueError("give the reader a schema: its columns are those that are read")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return KeysetReader(Database(schema, self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return KeysetStream(Database(schema, {**self.options, "order": "time"}))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Keyset)
