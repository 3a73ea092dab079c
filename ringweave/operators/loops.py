"""Loops, from the cheapest form on: a fold over a sequence, a loop within each row, supersteps."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.sources.staging import new_path, removed

_MANIFEST = re.compile(r"manifest-(\d+)\.json")
_held: set[str] = set()


def fold(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A loop over a bounded sequence, within the row."""
    return F.aggregate(values, zero, step)


def row_loop(df: DataFrame, keys: Sequence[str], value: str, condition: str, step: str, *, most: int = 10_000) -> DataFrame:
    """value = step while condition holds, each row for itself and within its row: no shuffle, no bound on rows.

    condition and step are SQL over `value` and `first`, the first value. The result has the keys, `first`
    and the last `value`. A condition that is null ends the loop. Most rows need few steps: 8 are tried on
    all rows, and eight times as many on what is then unfinished, and so on. A row that needs more than
    `most` steps fails the query.
    """
    kind = df.schema[value].dataType.simpleString()
    out = df.select(*keys, F.col(value).alias("first"), F.col(value).alias("value"))
    size, done = 8, 0
    while done < most:
        size = min(size, most - done)
        folded = f"aggregate(sequence(1, {size}), value, (value, i) -> CASE WHEN {condition} THEN CAST({step} AS {kind}) ELSE value END)"
        out = out.withColumn("value", F.expr(f"CASE WHEN {condition} THEN {folded} ELSE value END"))
        done, size = done + size, size * 8
    return out.withColumn("value", F.expr(f"CASE WHEN {condition} THEN CAST(raise_error('the loop of a row needs more than {most} steps') AS {kind}) ELSE value END"))


@dataclass
class Checkpoint:
    """Where a loop's state is kept, so that a later run goes on from the last step.

    A numbered manifest names the last complete step. It is written after the step's tables and then gets
    its name at once; the highest number counts, and the one before is deleted only afterwards, so there is
    a whole manifest at any time. The fingerprint must be that of the same loop. A finished loop leaves a
    marker, and a second run then only reads the result.
    """

    folder: str
    fingerprint: str
    stop_after: int | None = None
    _spark: SparkSession | None = field(default=None, repr=False)

    class Stopped(RuntimeError):
        """Raised by stop_after, the hook for tests of resumption."""

    class Mismatch(RuntimeError):
        """The folder belongs to another loop."""

    class Finished(RuntimeError):
        """The folder belongs to a run whose results were delivered."""

    class Busy(RuntimeError):
        """Another run of this process uses the folder."""

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, jvm, name: str):
        return jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def parent_exists(self, spark: SparkSession) -> None:
        jvm, fs = self._fs(spark)
        parent = jvm.org.apache.hadoop.fs.Path(self.folder).getParent()
        if parent is not None and not fs.exists(parent):
            raise FileNotFoundError(f"the folder of the checkpoint is missing: {parent}")

    def _manifests(self, jvm, fs) -> list[tuple[int, Any]]:
        """Number and status of each manifest, in order."""
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = fs.listStatus(at) if fs.exists(at) else []
        named = [(m, f) for f in found if (m := _MANIFEST.fullmatch(f.getPath().getName()))]
        return sorted(((int(m[1]), f) for m, f in named), key=lambda x: x[0])

    def stored(self, spark: SparkSession) -> dict | None:
        """The last manifest, whichever plan it is of."""
        jvm, fs = self._fs(spark)
        found = self._manifests(jvm, fs)
        if not found:
            return None
        stream = fs.open(found[-1][1].getPath())
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, spark: SparkSession) -> dict | None:
        found = self.stored(spark)
        if found is not None and found["fingerprint"] != self.fingerprint:
            raise self.Mismatch(f"{self.folder} holds another loop's state")
        return found

    def write(self, spark: SparkSession, state: dict) -> None:
        """A new manifest under the next number; the one before it stays until the new one has its name."""
        jvm, fs = self._fs(spark)
        fs.mkdirs(self._path(jvm, "."))
        past = self._manifests(jvm, fs)
        new = self._path(jvm, f".writing-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state | {"fingerprint": self.fingerprint}).encode()))
        out.close()
        if not fs.rename(new, self._path(jvm, f"manifest-{past[-1][0] + 1 if past else 0:09d}.json")):
            raise OSError(f"another run writes to {self.folder}")
        for _, old in past:
            fs.delete(old.getPath(), False)

    @contextmanager
    def held(self) -> Iterator[None]:
        """Guards the folder against a second run of this process while one uses it."""
        if self.folder in _held:
            raise self.Busy(f"another run of this process uses {self.folder}")
        _held.add(self.folder)
        try:
            yield
        finally:
            _held.discard(self.folder)

    def info(self, spark: SparkSession) -> str:
        """What the folder holds, for people: the state, the step, and the bytes of each kind of table."""
        state = self.stored(spark)
        if state is None:
            return f"{self.folder}: no checkpoint"
        jvm, fs = self._fs(spark)
        sizes: dict[str, list[int]] = {}
        for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.folder)):
            if f.isDirectory():
                kind = f.getPath().getName().split("-")[0]
                sizes.setdefault(kind, []).append(fs.getContentSummary(f.getPath()).getLength())
        parts = [f"{kind}: {len(n)} tables, {sum(n)} bytes" for kind, n in sorted(sizes.items())]
        return "; ".join([f"{self.folder}: {'finished' if state['done'] else 'stopped'} after step {state['step']}", *parts])

    def modified(self, spark: SparkSession) -> int:
        """Milliseconds since 1970 of the last step; -1 if there is none."""
        found = self._manifests(*self._fs(spark))
        return found[-1][1].getModificationTime() if found else -1


def supersteps(start: DataFrame, pending: DataFrame, body: Callable[[DataFrame], DataFrame], keys: Sequence[str], add: Callable[[DataFrame], DataFrame], *, combine: dict[str, Callable[[Column, Column], Column]], again: Callable[[DataFrame], DataFrame] | None, done: Callable[[DataFrame], tuple[Column, DataFrame]], checkpoint: Checkpoint | None = None, most: int = 10_000) -> DataFrame:
    """The loop of rings with fan-out and fan-in.

    start: a row per ring with its keys and store. pending: items by ring. body(items): what leaves the
    body, with the keys. add(outputs): the outputs of each ring aggregated, to be combined with the store
    column by column. again(outputs): items that adding recurs, or None if it never does. A ring to which
    adding gave new items goes on; for others done(stores) gives the condition to go on and the items that
    are then recurred. Finished rings' stores are the result.

    All rings step together; each step writes stores and items to the shared folder, so plans stay short
    and a lost executor costs a step at most. Items of a step are removed once the next one is written.
    """
    spark = start.sparkSession
    saved = checkpoint.read(spark) if checkpoint else None
    folder = checkpoint.folder if checkpoint else new_path(spark, "loop")
    keep = lambda df, name, i: _saved(df, folder, name, i)
    ended, step, made_at = [], 0, None
    stores, items = start, pending
    if saved:
        ended, step, made_at = saved["ended"], saved["step"], saved["made"]
        if saved["done"]:
            return _finished(spark, ended)
        stores, items = _going_on(spark.read.parquet(saved["stores"]), spark.read.parquet(saved["made"]), again, done)
    for i in range(step, most):
        before = made_at
        made, made_at = keep(body(items), "made", i)
        sums = add(made)
        named = {c: f"_new_{c}" for c in sums.columns if c not in keys}
        joined = stores.join(sums.withColumnsRenamed(named), list(keys), "left")
        stores = joined.select(*keys, *[F.coalesce(combine[c](F.col(c), F.col(f"_new_{c}")), F.col(c)).alias(c) if c in named else F.col(c) for c in stores.columns if c not in keys])
        if again is None:
            flagged = stores.withColumn("_busy", F.lit(False))
        else:
            busy = again(made).select(*keys).distinct().withColumn("_busy", F.lit(True))
            flagged = stores.join(busy, list(keys), "left").withColumn("_busy", F.coalesce("_busy", F.lit(False)))
        condition, _ = done(stores)
        flagged, at = keep(flagged.withColumn("_again", ~F.col("_busy") & condition), "stores", i)
        ended.append(at)
        left = flagged.where("_busy or _again").limit(1).count() > 0
        if checkpoint:
            checkpoint.write(spark, {"step": i + 1, "stores": at, "made": made_at, "ended": ended, "done": not left})
            if left and checkpoint.stop_after is not None and i + 1 - step >= checkpoint.stop_after:
                raise Checkpoint.Stopped(f"after step {i + 1}")
        if before:
            removed(spark, before)
        if not left:
            removed(spark, made_at)
            return _finished(spark, ended)
        stores, items = _going_on(flagged, made, again, done)
    raise RuntimeError(f"the loop needs more than {most} steps")


def _going_on(flagged: DataFrame, made: DataFrame, again, done) -> tuple[DataFrame, DataFrame]:
    """The stores of the rings that go on, and the items that are recurred."""
    items = done(flagged.where("_again").drop("_busy", "_again"))[1]
    if again is not None:
        items = items.unionByName(again(made))
    return flagged.where("_busy or _again").drop("_busy", "_again"), items


def _finished(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The stores of the rings that each step ended."""
    return spark.read.parquet(*paths).where("not (_busy or _again)").drop("_busy", "_again")


def _saved(df: DataFrame, folder: str, name: str, i: int) -> tuple[DataFrame, str]:
    path = f"{folder}/{name}-{i}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
