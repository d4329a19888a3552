"""Sources of our own by Spark's Python Data Source API: database tables in parallel parts, logs of JSON segments.

Both read paths that the driver and all executors see, as JDBC reads one server. ``register(spark)`` names them
``dbtable`` and ``segmentlog``.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a batch, and bytes of a segment's slice that one task reads.
ROWS, SLICE = 4096, 32 << 20
# The Spark type of a declared column type.
TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class KeyRange(InputPartition):
    """Rows of ``low`` <= key < ``high``; None leaves a side open. ``nulls`` adds the rows without a key."""

    low: object
    high: object
    nulls: bool = False


class DatabaseTable(DataSource):
    """A table of a SQLite file: options ``path``, ``table``, ``key`` (the column to divide by) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "dbtable"

    def schema(self) -> str:
        with _connect(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        return ", ".join(f"`{c[1]}` {TYPES.get(c[2].upper().split('(')[0].strip(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(dict(self.options), schema)


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        """Ranges of about as many rows each, their bounds found in the table itself; equal keys stay together."""
        key, parts = self.options.get("key"), int(self.options.get("partitions", "8"))
        if not key:
            return [KeyRange(None, None, True)]
        k, table = _quoted(key), _quoted(self.options["table"])
        with _connect(self.options["path"]) as con:
            (n,) = con.execute(f"SELECT count({k}) FROM {table}").fetchone()
            bounds = []
            for i in range(1, parts):
                row = con.execute(f"SELECT {k} FROM {table} WHERE {k} IS NOT NULL ORDER BY {k} LIMIT 1 OFFSET ?", (i * n // parts,)).fetchone()
                if row and (not bounds or row[0] != bounds[-1]):
                    bounds.append(row[0])
        edges = [None, *bounds, None]
        return [KeyRange(a, b, i == 0) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tests, values = [], []
        if key := self.options.get("key"):
            for op, bound in ((">=", partition.low), ("<", partition.high)):
                if bound is not None:
                    tests.append(f"{_quoted(key)} {op} ?")
                    values.append(bound)
        where = " AND ".join(tests) or "1"
        if key:
            where = f"({where}) AND {_quoted(key)} IS NOT NULL" + (f" OR {_quoted(key)} IS NULL" if partition.nulls else "")
        names, schema = ", ".join(map(_quoted, self.schema.fieldNames())), to_arrow_schema(self.schema)
        with _connect(self.options["path"]) as con:
            rows = con.execute(f"SELECT {names} FROM {_quoted(self.options['table'])} WHERE {where}", values)
            while part := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


@dataclass
class Slice(InputPartition):
    """The lines that begin in bytes ``start`` to ``end`` of a segment."""

    segment: str
    start: int
    end: int


class SegmentLog(DataSource):
    """Lines of the files of a folder, in the order of their names, which only grow: option ``path``.

    New lines go to the end of the last file, then to new files. A line without its line end is still being written.
    """

    @classmethod
    def name(cls) -> str:
        return "segmentlog"

    def schema(self) -> str:
        return "segment string, position bigint, value string"

    def streamReader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], self.options.get("startingoffset", "earliest"))


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.start = path, start

    def segments(self) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if not n.startswith((".", "_")))

    def complete(self, segment: str) -> int:
        """The byte after the last whole line."""
        with open(os.path.join(self.path, segment), "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end > 0:
                lo = max(0, end - 65536)
                f.seek(lo)
                at = f.read(end - lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                end = lo
        return 0

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "latest" else {"segment": "", "byte": 0}

    def latestOffset(self) -> dict:
        names = self.segments()
        return {"segment": names[-1], "byte": self.complete(names[-1])} if names else {"segment": "", "byte": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name in self.segments():
            if start["segment"] <= name <= end["segment"]:
                a = start["byte"] if name == start["segment"] else 0
                b = end["byte"] if name == end["segment"] else self.complete(name)
                out += [Slice(name, lo, min(lo + SLICE, b)) for lo in range(a, b, SLICE)]
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        with open(os.path.join(self.path, part.segment), "rb") as f:
            at = part.start
            if at:  # a line that begins before the slice belongs to the slice before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end and (line := f.readline()):
                if line.strip():
                    yield part.segment, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    for source in (DatabaseTable, SegmentLog):
        spark.dataSource.register(source)


def read_database(spark: SparkSession, path: str, table: str, key: str | None = None, partitions: int = 8) -> DataFrame:
    """All rows of a table, in one part, or in parts of about as many rows by ``key``."""
    register(spark)
    reader = spark.read.format("dbtable").options(path=path, table=table, partitions=str(partitions))
    return (reader.option("key", key) if key else reader).load()


def read_segments(spark: SparkSession, path: str, schema: str, start: str = "earliest") -> DataFrame:
    """A stream of the JSON lines of a segment log from its beginning or (``latest``) its present end."""
    register(spark)
    lines = spark.readStream.format("segmentlog").options(path=path, startingOffset=start).load()
    return lines.select("segment", "position", F.from_json("value", schema).alias("e")).select("segment", "position", "e.*")
