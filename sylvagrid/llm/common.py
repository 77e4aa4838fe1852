"""Helpers shared by the text operators: reading, scratch space, byte hashing inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

CHUNK = 1 << 18  # bytes of text hashed at once in a task: its arrays are about a hundred times as large
U = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: compressed, and safe from lost executors."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark removes the shuffle files of finished steps only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS = "500"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold few rows: rows with whole texts are large."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection, so it adds no collisions."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class RollingHash:
    """Hashes of any substring of a byte buffer in constant time, modulo 2**64.

    Prefix sums of byte values times powers of an odd base; a substring's difference is
    moved back to the power 0 with the base's inverse.
    """

    def __init__(self, limit: int = CHUNK) -> None:
        values = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)
        self.values = values * U(2) + U(1)
        self.grow(limit)

    def grow(self, limit: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.limit = limit
        self.up = np.cumprod(np.full(limit, base, np.uint64))
        self.down = np.cumprod(np.full(limit, pow(base, -1, 2**64), np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.limit:
            self.grow(len(data) + (len(data) >> 2))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.up[:len(data)])])

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``size`` bytes together, with the place of the first."""
    first, kept, n = 0, [], 0
    for i, t in enumerate(texts):
        if kept and n + len(t) > size:
            yield first, kept
            first, kept, n = i, [], 0
        kept.append(t)
        n += len(t) + 1
    if kept:
        yield first, kept


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours (doubling: log2 passes)."""
    f, s = (np.minimum if least else np.maximum), 1
    if len(x) < width:
        return x[:0]
    while s * 2 <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[:s - width], x[width - s:]) if width > s else x


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    step = np.ones(total, np.int64)
    at = np.cumsum(length)[:-1]
    step[0] = start[0]
    step[at] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(step)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges (sorted by start) as maximal disjoint ranges; touching ones join."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.nonzero(first)[0]
    return start[at], reach[np.concatenate([at[1:] - 1, [len(end) - 1]])]


def _c_library():
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


C_LIBRARY = _c_library()


def trim() -> None:
    """Hand freed memory back to the system: a worker that waits between stages holds little then."""
    pa.default_memory_pool().release_unused()
    if hasattr(C_LIBRARY, "malloc_trim"):
        C_LIBRARY.malloc_trim(0)


def trimmed(f: Callable) -> Callable:
    """A function of (key, table) or (key, left, right) that hands back what it freed."""
    if f.__code__.co_argcount == 3:
        def run(key, left, right):
            out = f(key, left, right)
            trim()
            return out
    else:
        def run(key, table):
            out = f(key, table)
            trim()
            return out
    return run


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of ``column`` (texts, or lists of 8-byte numbers), so that a task's Python objects stay few."""
    for batch in batches:
        lists = pa.types.is_list(batch[column].type)
        n = pa.compute.list_value_length(batch[column]) if lists else pa.compute.binary_length(batch[column])
        n = pa.compute.fill_null(n, 0).to_numpy().astype(np.int64) * (8 if lists else 1)
        part = np.concatenate([[0], np.cumsum(n)[:-1]]) // size if len(n) else n
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield batch.slice(a, b - a)
    trim()


def texts_of(column: pa.Array) -> list[bytes]:
    """A binary column as bytes; null becomes empty."""
    return [t or b"" for t in column.to_pylist()]
