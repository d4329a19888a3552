"""Shared helpers: tables in the cluster's shared folder, global ranks, byte hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A job's shuffle files go when it ends, and a batch of long texts or word lists is no larger in a Python worker than this.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_DATABASES: dict[str, str] = {}
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_OPEN: list[Intermediates] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only in local mode, where one machine does all, may it be unset: then it is a new temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _database(spark: SparkSession) -> str:
    """The database of this process's intermediate tables, a folder in the shared folder."""
    base = shared_dir(spark)
    name = _DATABASES.setdefault(base, f"duskline_{uuid.uuid4().hex}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{base}/{name}'")
    return name


def database_dir(spark: SparkSession) -> str:
    """The folder of that database, for further files that ``release`` is to delete with it."""
    return f"{shared_dir(spark)}/{_database(spark)}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage with a table that survives lost executors. The table stays until it is discarded, the
    ``Intermediates`` block around it ends, or ``release`` drops all.
    """
    spark = df.sparkSession
    table = f"{_database(spark)}.{re.sub(r'[^a-z0-9]', '_', name.lower())}_{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.format("parquet").saveAsTable(table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.table(table)
    _STORED[out] = table
    if _OPEN:
        _OPEN[-1].tables[table] = spark
    return out


def discard(*frames: DataFrame) -> None:
    """Drop the tables of frames that ``materialize`` returned and nothing needs any more."""
    for df in frames:
        table = _STORED.pop(df, None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


class Intermediates:
    """A ``with`` block at whose end the tables written inside are dropped, except for those of kept frames."""

    def __init__(self):
        self.tables: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def keep(self, *frames: DataFrame) -> None:
        self.kept.update(_STORED[df] for df in frames)

    def __enter__(self) -> Intermediates:
        _OPEN.append(self)
        return self

    def __exit__(self, *failure) -> None:
        _OPEN.remove(self)
        for table, spark in self.tables.items():
            if table not in self.kept or failure[0]:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            elif _OPEN:
                _OPEN[-1].tables[table] = spark


def release(spark: SparkSession) -> None:
    """Drop all intermediate tables of this process; results that are not written yet can't be read afterwards."""
    name = _DATABASES.pop(shared_dir(spark), None)
    if name:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without columns of these names: they get new names, and the dict leads back to the old ones.

    For operators that need the names for themselves: ``out.withColumnsRenamed(back)`` ends their work.
    """
    new = {c: f"{c}_{uuid.uuid4().hex}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(new), {v: k for k, v in new.items()}


def global_rank(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """Add the 0-based position of each row in the global sort by ``order``.

    A range shuffle spreads the sort over all tasks whatever the keys' skew (the
    order's last columns should make rows nearly distinct). Only one count per
    partition reaches the driver. ``df`` is read twice (bounds, then the sort),
    so pass a narrow stored table.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    stored = materialize(parts.withColumn("_at", F.monotonically_increasing_id()), name)
    counts = stored.groupBy(F.shiftright("_at", 33).alias("_part")).count().orderBy("_part").collect()
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    return (
        stored.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_at")
    )


# --- memory of Python workers -----------------------------------------------------------------


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and would hold its peak."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(run):
    """The generator ``run`` of a task, which gives freed memory back at its end."""

    def lean_run(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return lean_run


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: it decides by itself
    _LIBC = None


# --- byte-level helpers for numpy code inside tasks -------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and grown in each worker, shared by all calls."""
    known = _POWERS.get(int(base))
    if known is None or len(known) <= n:
        p = np.full(max(n, 1 << 16) * 5 // 4 + 1, base, dtype=np.uint64)
        p[0] = 1
        known = _POWERS[int(base)] = np.cumprod(p, dtype=np.uint64)
    return known[: n + 1]


class RollingHash:
    """Hashes of any substring of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(BASE_INV, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(BASE, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def utf8_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches_of_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch holding about ``limit`` bytes of ``column`` each (one row at least)."""
    _, offsets = utf8_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    give_back()
