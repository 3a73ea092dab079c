"""Plans of Python callables on DataFrames.

A plan is a list of segments, each a module. Rows carry one pickled item. What descends from one row
is run in the task that holds the row (rings and frames of nested modules need no shuffle), so any
number of rings run side by side. A segment's own reducer is the ring over all rows: tasks fold what
their rows emit into partial stores, which one task merges; what it recurs goes out to all tasks again,
with the store and the items written to the shared folder between steps.
"""

from __future__ import annotations

import hashlib
import logging
import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from types import CodeType, FunctionType
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.operators.loops import Checkpoint
from ringweave.sources.staging import removed, shared_dir, staged

from .nodes import Frame, Module, flow, run_item

log = logging.getLogger(__name__)
ITEM = "item binary"
#: Kinds: i an item for a frame, o an output of the body, b a ring that began, s a store, r recurred, e emitted, z nothing.
KINDS = "kind string, item binary"
_NOTHING = bytearray(pickle.dumps(None))
_BATCH = 1024


@dataclass
class Segment:
    """A module; with always, its reducer runs over no rows as well (and then emits its first store)."""

    module: Module
    always: bool = False


def items_of(spark: SparkSession, work: Iterable[Any] | DataFrame, partitions: int | None = None) -> DataFrame:
    """A table of pickled items. A DataFrame's rows become dictionaries, or plain values if it has one column."""
    if isinstance(work, DataFrame):
        return work.mapInArrow(lambda batches: _batches(_of_rows(batches)), ITEM)
    rows = [(bytearray(cloudpickle.dumps(w)),) for w in work]
    # more slices than cores, so that items of unlike length keep all cores busy
    n = partitions or max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, n), ITEM)


def _batch(items: list[bytes], kinds: list[str] | None = None) -> pa.RecordBatch:
    columns = [pa.array(items, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["item"]) if kinds is None else pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *columns], ["kind", "item"])


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
    """A table's rows as items: dictionaries, or the plain values, but for nulls, if it has one column."""
    for batch in batches:
        names, columns = batch.schema.names, [c.to_pylist() for c in batch.columns]
        if len(names) == 1:
            yield from (x for x in columns[0] if x is not None)
        else:
            yield from (dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True))


def _dumps(item: Any) -> bytes:
    """An item pickled in a task; plain pickling is several times faster, and fails for what is defined in place."""
    try:
        return pickle.dumps(item, 5)
    except Exception:
        return cloudpickle.dumps(item)


def _batches(items: Iterable[Any]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    for item in items:
        held.append(_dumps(item))
        if len(held) >= _BATCH:
            yield _batch(held)
            held = []
    yield _batch(held)


def _kinds(items: Iterable[tuple[str, Any]]) -> Iterator[pa.RecordBatch]:
    kinds: list[str] = []
    held: list[bytes] = []
    for kind, item in items:
        kinds.append(kind)
        held.append(_dumps(item))
        if len(held) >= _BATCH:
            yield _batch(held, kinds)
            kinds, held = [], []
    yield _batch(held, kinds)


def _of_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Any]]:
    for batch in batches:
        for kind, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield kind, pickle.loads(item)


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
    for batch in batches:
        for item in batch.column(0).to_pylist():
            yield pickle.loads(item)


def planned(segments: list[Segment], source: DataFrame, table: bool = False) -> DataFrame:
    """The rows that the last segment emits. table: source is a table whose rows are the items, not one of items."""
    if not segments:
        return items_of(source.sparkSession, source) if table else source
    rows, load = source, _of_rows if table else _loaded
    for segment in segments:
        rows = _reduced(segment, rows, load=load) if segment.module.reducer is not None else _flowed(segment.module, rows, load)
        load = _loaded
    return rows


def _flowed(module: Module, rows: DataFrame, load: Callable = _loaded) -> DataFrame:
    code = cloudpickle.dumps(module)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(code)
        yield from _batches(out for item in load(batches) for out in run_item(own, item))

    return rows.mapInArrow(run, ITEM)


def signature(part: Any, within: tuple = ()) -> Any:
    """What a plan is made of: names, code and settings, the same for each run of the same program."""
    if isinstance(part, (str, bytes, int, float, complex, bool, type(None))):
        return repr(part)
    if id(part) in within:
        return "..."
    within = (*within, id(part))
    if isinstance(part, (list, tuple)):
        return [signature(x, within) for x in part]
    if isinstance(part, (set, frozenset)):
        return sorted(str(signature(x, within)) for x in part)
    if isinstance(part, dict):
        return sorted((str(k), str(signature(v, within))) for k, v in part.items())
    if isinstance(part, CodeType):
        return [part.co_name, part.co_code.hex(), list(part.co_names), signature(part.co_consts, within)]
    if isinstance(part, FunctionType):
        return [part.__qualname__, signature(part.__code__, within), signature(part.__defaults__, within), signature(part.__kwdefaults__, within)]
    if isinstance(part, type):
        return [part.__qualname__, [(k, str(signature(v, within))) for k, v in sorted(vars(part).items()) if isinstance(v, FunctionType)]]
    return [signature(type(part), within), signature(getattr(part, "__dict__", None), within)]


def checkpoint_of(spark: SparkSession, folder: str, segments: list[Segment], inits: Iterable[Callable] = (), stop_after: int | None = None) -> Checkpoint:
    """The checkpoint of a plan in `folder`, whose parent must exist."""
    made = str([[signature(s.module), s.always] for s in segments] + [signature(list(inits))])
    found = Checkpoint(folder.rstrip("/"), hashlib.sha256(made.encode()).hexdigest(), stop_after)
    found.parent_exists(spark)
    return found


def resumed(segments: list[Segment], source: Callable[[], DataFrame], spark: SparkSession, checkpoint: Checkpoint) -> DataFrame:
    """Like planned(); the source, each step of a ring and the result are kept in the checkpoint's folder.

    A later run takes what is there and goes on after the last step; source() is called only by the first.
    """
    state = checkpoint.read(spark) or {"step": 0, "source": None, "rings": {}, "result": None, "done": False}
    if state["done"]:
        raise Checkpoint.Finished(f"{checkpoint.folder} holds a finished run, whose results were delivered")
    begun = state["step"]

    def kept(name: str, df: DataFrame) -> str:
        path = f"{checkpoint.folder}/{name}-{uuid.uuid4().hex}"
        staged(df, name, path)
        return path

    def note(**found: Any) -> None:
        state.update(found, step=state["step"] + 1)
        checkpoint.write(spark, state)
        if checkpoint.stop_after is not None and state["step"] - begun >= checkpoint.stop_after:
            raise Checkpoint.Stopped(f"after step {state['step']}")

    read = lambda path, kind=ITEM: spark.read.schema(kind).parquet(path)
    if not state["result"]:
        if not state["source"]:
            note(source=kept("source", source()))
        rows = read(state["source"])
        for i, segment in enumerate(segments):
            if segment.module.reducer is None:
                rows = _flowed(segment.module, rows)
                continue
            paths = state["rings"].setdefault(str(i), [])

            def keep(step: DataFrame, paths: list[str] = paths) -> DataFrame:
                paths.append(kept("ring", step))
                note()
                return read(paths[-1], KINDS)

            rows = _reduced(segment, rows, [read(p, KINDS) for p in paths], keep)
        note(result=kept("result", rows))
    return read(state["result"])


def delivered(spark: SparkSession, checkpoint: Checkpoint) -> None:
    """Marks the run as finished."""
    checkpoint.write(spark, checkpoint.read(spark) | {"done": True})


def _reduced(segment: Segment, rows: DataFrame, past: Iterable[DataFrame] = (), keep: Callable[[DataFrame], DataFrame] | None = None, load: Callable = _loaded) -> DataFrame:
    """A ring over all rows, in steps until nothing recurs; past: the steps that an earlier run has made."""
    spark, module = rows.sparkSession, segment.module
    code, mergeable, framed = cloudpickle.dumps(module), module.reducer.mergeable, isinstance(module.reducer, Frame)
    tasks = spark.sparkContext.defaultParallelism

    def fold(begun: bool) -> Callable:
        """What a task's rows come to: one partial store, or each output where stores can't be merged."""

        def out(given: Iterator[Any]) -> Iterator[tuple[str, Any]]:
            own = pickle.loads(code)
            store, reducer, any_ = None, own.reducer, False
            for one in given:
                item, target = (one, None) if begun else one
                any_ = True
                if not mergeable:
                    yield from (("o", x) for x in flow(own, item, own.entry_of(target)))
                    continue
                if store is None:
                    store, _ = reducer.open(None)
                stack = [(item, target)]
                while stack:
                    work, to = stack.pop()
                    for x in flow(own, work, own.entry_of(to)):
                        stack.extend(reversed(reducer.add(store, x)))
            if any_:
                yield ("s", store) if mergeable else ("b", None)

        return lambda batches: _kinds(out((load if begun else _loaded)(batches)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One of several partial stores, and what merging recurs."""
        reducer, store, again = pickle.loads(code).reducer, None, []
        for _, part in _of_kinds(batches):
            if store is None:
                store = part
            else:
                again += reducer.join(store, part) or []
        yield from _kinds([] if store is None else [("s", store), *(("r", x) for x in again)])

    def close(kept: bytes | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Takes all into the ring's store; what it emits, what it recurs, and the store."""
            own = pickle.loads(code)
            reducer, store, again = own.reducer, None if kept is None else pickle.loads(kept), []
            for kind, part in _of_kinds(batches):
                if kind == "z":
                    continue
                if kind == "i" and store is None:
                    store, more = reducer.open(part)
                    again += more
                    continue
                if store is None:
                    store, _ = reducer.open(None)
                if kind == "s":
                    again += reducer.join(store, part) or []
                elif kind in "oi":
                    again += reducer.add(store, part)
                elif kind == "r":
                    again.append(part)
            if store is None and segment.always and not framed:
                store, _ = reducer.open(None)
            if store is None:
                yield from _kinds([])
                return
            out, again = ([], again) if again else reducer.done(store)
            yield from _kinds([*(("e", x) for x in out), *(("r", x) for x in again), ("s", store)])

        return run

    kept: bytes | None = None
    emitted: list[DataFrame] = []
    pending, first, left = rows, True, list(past)
    while True:
        if left:
            step = left.pop(0)
        else:
            if first and framed:
                items = pending if load is _loaded else items_of(spark, pending)
                made = items.select(F.lit("i").alias("kind"), "item")
            else:
                made = pending.mapInArrow(fold(first), KINDS)
                if mergeable and tasks > 64:
                    made = made.repartition(math.isqrt(tasks)).mapInArrow(merge, KINDS)
            # a shuffle keeps the body parallel, the numbers keep the order of the rows, one row more keeps an empty ring
            made = made.unionByName(spark.range(1).select(F.lit("z").alias("kind"), F.lit(_NOTHING).alias("item"))).withColumn("at", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("at").drop("at")
            made = made.mapInArrow(close(kept), KINDS)
            step = keep(made) if keep else staged(made, "ring")
        log.info("%s: step %d of the ring over all rows is done", module.path, len(emitted) + 1)
        emitted.append(_of_kind(step, "e"))
        recurred = _of_kind(step, "r")
        if not recurred.limit(1).count():
            break
        kept = bytes(_of_kind(step, "s").first().item)
        pending, first = recurred.repartition(tasks), False
    found = emitted[0]
    for more in emitted[1:]:
        found = found.unionByName(more)
    return found


def _of_kind(step: DataFrame, kind: str) -> DataFrame:
    return step.where(F.col("kind") == kind).select("item")


def values(rows: DataFrame) -> list[Any]:
    """All items as a list on the driver, in order; all partitions are made at once."""
    return [pickle.loads(bytes(row.item)) for row in rows.collect()]


def each(rows: DataFrame) -> Iterator[Any]:
    """Items on the driver in order, one partition at a time; all are made at once and staged before."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/ringweave-results-{uuid.uuid4().hex}"
    try:
        for row in staged(rows.withColumn("at", F.monotonically_increasing_id()), "results", path).orderBy("at").toLocalIterator():
            yield pickle.loads(bytes(row.item))
    finally:
        removed(spark, path)


@contextmanager
def interruptible(spark: SparkSession) -> Iterator[None]:
    """Cancels the jobs started within it if the driver is interrupted or fails."""
    context = spark.sparkContext
    if context.getLocalProperty("spark.jobGroup.id"):  # the caller has a group of its own
        tag = f"ringweave-{uuid.uuid4().hex}"
        context.addJobTag(tag)
        stop, over = lambda: context.cancelJobsWithTag(tag), lambda: context.removeJobTag(tag)
    else:
        group = f"ringweave-{uuid.uuid4().hex}"
        context.setJobGroup(group, "ringweave", interruptOnCancel=True)
        stop = lambda: context.cancelJobGroup(group)
        over = lambda: [context.setLocalProperty(f"spark.{name}", None) for name in ("jobGroup.id", "job.description", "job.interruptOnCancel")]
    try:
        yield
    except BaseException:
        stop()
        raise
    finally:
        over()


def typed(rows: DataFrame, ddl: str) -> DataFrame:
    """Items as columns of a declared schema: dictionaries by name, Args by place, others as the one column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = _parse_datatype_string(ddl)
    kind = kind if isinstance(kind, StructType) else StructType([StructField("value", kind)])
    arrow, names = to_arrow_schema(kind), kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.loads(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([x if isinstance(x, dict) else dict(zip(names, x.args, strict=False)) | x.kwargs if hasattr(x, "kwargs") else {names[0]: x} for x in found], arrow)

    return rows.mapInArrow(run, kind)


