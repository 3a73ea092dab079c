"""Line sources and the sinks on the driver."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions import parsed


def lines(df: DataFrame, column: str = "value", kind: str = "string") -> DataFrame:
    """Trimmed lines that aren't blank, as values of a type; works on batches and streams alike."""
    line = F.trim(F.col(column))
    return df.where(F.length(line) > 0).select(parsed(line, kind).alias("value"))


def read_lines(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    return lines(spark.read.text(path), "value", kind)


def seed_line(spark: SparkSession, words: Iterable[str], kind: str = "string") -> DataFrame:
    """The words joined by spaces, as the one item."""
    return lines(spark.createDataFrame([(" ".join(words),)], "value string"), "value", kind)


def source_of(spark: SparkSession, *, seed: Iterable[str] = (), queued: Iterable[Any] | None = None, stream: TextIO | None = None) -> list[Any]:
    """The items by precedence: the seed line, what was queued, then a stream's lines. Nothing given is no items."""
    seed = " ".join(seed).strip()
    if seed:
        return [seed]
    if queued is not None:
        return list(queued)
    return [t for line in stream or () if (t := line.strip())]


def handle(df: DataFrame, callback: Callable[..., Any]) -> None:
    """Calls back on the driver once for each row, one partition at a time."""
    for row in df.toLocalIterator():
        callback(row)


def printed(df: DataFrame, out: TextIO | None = None) -> None:
    """A row a line, as text."""
    handle(df, lambda row: print(*row, file=out or sys.stdout))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
