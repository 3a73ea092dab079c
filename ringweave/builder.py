"""The decorator API: `with Work([...]) as w: @w.job ... @w.reduce ... @w.result`."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators.loops import Checkpoint
from .plans.compile import Segment, checkpoint_of, delivered, each, interruptible, items_of, planned, resumed, typed, values
from .plans.nodes import Frame, FunctionFrame, FunctionJob, FunctionReducer, Job, Module, Object, PlanError, Reducer, applied, outputs
from .sources.staging import scratch


def active() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _arity(fn: Callable, what: str, least: int, exact: bool = False) -> None:
    try:
        parameters = inspect.signature(fn).parameters.values()
    except (TypeError, ValueError):  # a builtin without a signature
        return
    places = [p for p in parameters if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    if any(p.kind == p.VAR_POSITIONAL for p in parameters):
        return
    needed = sum(p.default is p.empty for p in places)
    if (exact and not needed <= least <= len(places)) or len(places) < least:
        raise PlanError(f"{what} takes a function of {'exactly' if exact else 'at least'} {least} parameters, not {len(places)}")


class Work:
    """A pipeline under construction. Python functions run in tasks; nothing runs until run() or the block's end.

    checkpoint: a folder, in an existing one that all machines share. A run that failed goes on there after
    the last finished step of a ring, without calling init again or reading `initial`. Once its results are
    delivered a further run is an error (Checkpoint.Finished); a run that fails while they are delivered
    delivers all of them again. stop_after: the run ends with Checkpoint.Stopped after so many steps.
    """

    def __init__(self, initial: Iterable[Any] | DataFrame = (), useMultiprocessing: bool = True, *, spark: SparkSession | None = None, checkpoint: str | None = None, stop_after: int | None = None):  # noqa: N803
        self.initial = initial if isinstance(initial, DataFrame) else list(initial)
        self.spark, self.checkpoint, self.stop_after = spark, checkpoint, stop_after
        self.segments: list[Segment] = []
        self.scopes: list[tuple[list, FunctionFrame | None]] = [([], None)]
        self.inits: list[Callable] = []
        self.sink: tuple[str, Callable] | None = None

    def __enter__(self) -> Work:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self._execute(discard=True)

    # --- building

    def _open(self) -> list:
        if self.sink is not None:
            raise PlanError(f"nothing may follow {self.sink[0]}")
        return self.scopes[-1][0]

    def _decorated(self, fn: Callable | None, use: Callable[[Callable], None]) -> Callable:
        def take(given: Callable) -> Callable:
            self._open()
            use(given)
            return given

        return take if fn is None else take(fn)

    def init(self, fn: Callable | None = None) -> Callable:
        """Runs once on the driver; what it returns is added to the work."""

        def use(given: Callable) -> None:
            _arity(given, "init", 0, exact=True)
            self.inits.append(given)

        return self._decorated(fn, use)

    def job(self, fn: Callable | type | None = None, *, useMultiprocessing: bool = True, **config: Any) -> Callable:  # noqa: N803
        """One item in; what is returned is emitted (None: nothing, Multiple: several)."""

        def use(given: Callable) -> None:
            if isinstance(given, type) and issubclass(given, Job):
                self._open().append(given(config))
            else:
                _arity(given, "job", 1)
                self._open().append(FunctionJob(given, **config))

        return self._decorated(fn, use)

    def reduce(self, fn: Callable | type | None = None, *, store: Callable[[], Any] = Object, emit: Callable[[Any], Any] | None = None, merge: Callable[[Any, Any], Any] | None = None, useMultiprocessing: bool = True) -> Callable:  # noqa: N803
        """fn(store, works, others) folds all that comes; what it returns recurs; emit(store) is emitted at the end.

        Stores are folded in all tasks and merged if fn reads `others` or merge(store, other) is given;
        otherwise one task folds all that leaves the jobs.
        """

        def use(given: Callable) -> None:
            if len(self.scopes) > 1:
                raise PlanError("reduce inside an open frame: end the frame first")
            if isinstance(given, type) and issubclass(given, Reducer):
                reducer = given()
            else:
                _arity(given, "reduce", 3, exact=True)
                reducer = FunctionReducer(given, store, emit, merge)
            self.segments.append(Segment(Module(self._open(), reducer), always=True))
            self.scopes = [([], None)]

        return self._decorated(fn, use)

    def frame(self, fn: Callable | type | None = None, *, store: Callable[[], Any] = Object, emit: Callable[[Any], Any] | None = None, useMultiprocessing: bool = True) -> Callable:  # noqa: N803
        """Head of a loop: fn(store, first); what it returns goes through the body, None ends the loop."""

        def use(given: Callable) -> None:
            self._open()
            if isinstance(given, type) and issubclass(given, Frame):
                self.scopes.append(([], given()))
            else:
                _arity(given, "frame", 2)
                self.scopes.append(([], FunctionFrame(given, store, emit)))

        return self._decorated(fn, use)

    def frameEnd(self, fn: Callable | None = None) -> Callable:  # noqa: N802
        """End of a loop: fn(store, next) for each item that leaves the body; what it returns goes through it again."""

        def use(given: Callable) -> None:
            if len(self.scopes) == 1:
                raise PlanError("frameEnd without a frame")
            _arity(given, "frameEnd", 2)
            jobs, frame = self.scopes.pop()
            frame.next = given
            self._open().append(Module(jobs, frame, path="frame"))

        return self._decorated(fn, use)

    def include(self, sub: Callable[[Work], Any]) -> Work:
        """Adds a reusable piece: a function that takes the builder."""
        self._open()
        sub(self)
        return self

    def result(self, fn: Callable | None = None) -> Callable:
        """Called on the driver once for each result."""

        def use(given: Callable) -> None:
            _arity(given, "result", 1)
            self.sink = ("result", given)

        return self._decorated(fn, use)

    def finish(self, fn: Callable | None = None) -> Callable:
        """Called on the driver with the list of all results; its return value is what run() returns."""

        def use(given: Callable) -> None:
            _arity(given, "finish", 1, exact=True)
            self.sink = ("finish", given)

        return self._decorated(fn, use)

    # --- running

    def rows(self) -> DataFrame:
        """The results as a table of pickled items, not yet computed."""
        if len(self.scopes) > 1:
            raise PlanError("a frame has no frameEnd")
        spark = self.spark or active()
        segments = self._segments()
        if self.checkpoint is None and isinstance(self.initial, DataFrame) and not self.inits:
            return planned(segments, self.initial, table=True)
        if self.checkpoint is None:
            return planned(segments, self._source(spark))
        return resumed(segments, lambda: self._source(spark), spark, self._state(spark))

    def _segments(self) -> list[Segment]:
        return [*self.segments, *([Segment(Module(self.scopes[0][0]))] if self.scopes[0][0] else [])]

    def _state(self, spark: SparkSession) -> Checkpoint:
        return checkpoint_of(spark, self.checkpoint, self._segments(), self.inits, self.stop_after)

    def _source(self, spark: SparkSession) -> DataFrame:
        added = [w for fn in self.inits for w in outputs(fn()) for w in (w if isinstance(w, list) else [w])]
        source = items_of(spark, self.initial if isinstance(self.initial, DataFrame) else [*self.initial, *added])
        if isinstance(self.initial, DataFrame) and added:
            source = source.unionByName(items_of(spark, added))
        return source

    def frame_of(self, ddl: str) -> DataFrame:
        """The results as columns of a declared schema."""
        return typed(self.rows(), ddl)

    def _execute(self, discard: bool = False) -> list | Any | None:
        spark = self.spark or active()
        with interruptible(spark), scratch(spark):
            if self.checkpoint is None:
                return self._delivered(self.rows(), discard)
            state = self._state(spark)
            with state.held():
                found = self._delivered(self.rows(), discard)
                delivered(spark, state)
                return found

    def _delivered(self, rows: DataFrame, discard: bool) -> list | Any | None:
        if self.sink is None:
            if discard:
                rows.write.format("noop").mode("overwrite").save()
                return None
            return values(rows)
        kind, fn = self.sink
        if kind == "result":
            for item in each(rows):
                applied(fn, item)
            return None
        found = list(outputs(fn(values(rows))))
        if len(found) > 1:
            raise PlanError("finish gave several results")
        return found[0] if found else None

    def run(self) -> Any:
        """Runs the pipeline: the list of results if no sink was declared, finish's value if it was."""
        return self._execute()


def map(func: Callable, *sequences: Iterable[Any], spark: SparkSession | None = None, **kwargs: Any) -> list:  # noqa: A001
    """func over the sequences, in parallel and in order, as far as the shortest goes; None results are kept."""
    spark = spark or active()
    work = [(i, args) for i, args in enumerate(zip(*sequences, strict=False))]
    if not work:
        return []
    job = FunctionJob(lambda given: (given[0], func(*given[1], **kwargs)))
    with interruptible(spark):
        return [v for _, v in sorted(values(planned([Segment(Module([job]))], items_of(spark, work))), key=lambda x: x[0])]
