"""Shared helpers: hashes of words and runs of units, and Arrow schemas."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringweave.sources.staging import new_path, removed, shared_dir, staged

__all__ = ["NULL_ID", "Tables", "WordHashes", "arrow_schema", "bound", "documents", "fold_of", "gram_hashes", "merged_runs", "mixed", "sampled", "shared_dir", "slices", "sliding_min", "staged", "tidy"]

#: Order of a row whose id is null: after every other row.
NULL_ID = (1 << 63) - 1


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column: str, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


class Tables:
    """Staged tables of one operator by label, so that those that nothing reads any more can be removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        made = staged(df, label, path)
        self.paths.setdefault(label, []).append(path)
        return made

    def drop(self, *labels: str) -> None:
        for label in labels:
            removed(self.spark, *self.paths.pop(label, ()))

    def drop_all_but(self, label: str, last: int = 1) -> None:
        """Removes the earlier tables of a label."""
        paths = self.paths.get(label, [])
        removed(self.spark, *paths[:-last])
        self.paths[label] = paths[-last:]


def _released() -> None:
    """Hands memory that a task has freed back to the system: workers live on, and others run beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a system without this function
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with the memory of its task released at its end."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _released()

    return inner


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: what is made of a batch of texts as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bound(most: int) -> int:
    """Six standard deviations above the number of rows expected in a sample."""
    return most + 6 * math.isqrt(most) + 6


def sampled(rows: DataFrame, n: int, most: int, make: Callable[[DataFrame], DataFrame], seed: int = 7) -> DataFrame:
    """make(about `most` of n rows): each row is drawn for itself, so equal rows are drawn like others.

    make gives a row for each row. Their number is bounded: it is cut six standard deviations above `most`,
    after they are made in many tasks. What is drawn depends on how the table is dealt to partitions.
    """
    return make(rows) if n <= most else make(rows.where(F.rand(seed) < most / n)).limit(bound(most))


class WordHashes(dict):
    """word -> 64-bit hash, kept between calls and emptied when it has grown past its limit."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, words), np.uint64, len(words))


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(unit: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` consecutive units; entry i is that of the run that starts at i."""
    n = len(unit) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, unit, 1
    while True:
        if length & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mixed(out * M1 + part)
            done += size
        size *= 2
        if size > length:
            return out
        power = mixed(power[: len(power) - size // 2] * M3 + power[size // 2 :])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open runs as maximal runs in order; runs that touch are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    at = np.flatnonzero(first)
    return starts[at], reach[np.concatenate((at[1:], [len(starts)])) - 1]
