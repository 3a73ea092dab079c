"""Plan nodes: jobs, modules, reducers and frames, and how one item runs through them.

A module is a sequence or a named graph of jobs and modules. A module with a reducer opens one ring for
each item that enters it: everything that descends from the item is added to the ring's store, and when
nothing is left to do the reducer emits to the parent or recurs. A frame is a reducer whose first item
goes to the store.

`run_item` runs all of an item's descendants here and now. It is what a task does with each row; rings
over all rows (the root reducer) are planned by ringweave.plans.compile.
"""

from __future__ import annotations

import dis
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import pairwise
from typing import Any


class PlanError(ValueError):
    """A plan that can't be run, or a use of the API that its rules forbid."""


class Object:
    """A bag of attributes; the store unless another is asked for."""

    def __init__(self, **fields: Any):
        self.__dict__.update(fields)

    def __repr__(self) -> str:
        return f"Object({', '.join(f'{k}={v!r}' for k, v in sorted(self.__dict__.items()))})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Object) and self.__dict__ == other.__dict__

    __hash__ = None


class Args:
    """Positional and keyword values that are fanned out to the parameters of what they are passed to."""

    def __init__(self, *args: Any, **kwargs: Any):
        self.args, self.kwargs = args, kwargs

    def call(self, fn: Callable, *before: Any) -> Any:
        return fn(*before, *self.args, **self.kwargs)

    def __repr__(self) -> str:
        return f"Args({', '.join([*map(repr, self.args), *(f'{k}={v!r}' for k, v in self.kwargs.items())])})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Args) and (self.args, self.kwargs) == (other.args, other.kwargs)

    __hash__ = None


class Multiple:
    """Several outputs in place of one; None among them is no output."""

    def __init__(self, values: Iterable[Any]):
        self.values = values


def outputs(value: Any) -> Iterator[Any]:
    """What a returned value emits: nothing for None, each value of Multiple, else the value."""
    if isinstance(value, Multiple):
        for v in value.values:
            yield from outputs(v)
    elif value is not None:
        yield value


def applied(fn: Callable, work: Any, *before: Any) -> Any:
    return work.call(fn, *before) if isinstance(work, Args) else fn(*before, work)


def _named(kinds: type | tuple[type, ...]) -> str:
    return " or ".join(k.__name__ for k in (kinds if isinstance(kinds, tuple) else (kinds,)))


class Job:
    """One item in, any number of items out. Override handleWork and emit, or postSetup for preparation.

    takes, gives: types of its items, if declared. In a sequence a job that can't take what the one before
    gives is an error when the plan is made; an item of another type is an error when it comes.
    """

    config: Mapping[str, Any] = {}
    global_config: Mapping[str, Any] = {}
    to: Any = None
    takes: type | tuple[type, ...] | None = None
    gives: type | None = None

    def __init__(self, config: Mapping[str, Any] | None = None, global_config: Mapping[str, Any] | None = None):
        self.config, self.global_config = config or {}, global_config or {}
        self._out: list[tuple[Any, str | None]] = []

    def postSetup(self) -> None:  # noqa: N802
        """Called once where the job runs, before its first item."""

    def handleWork(self, work: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleWork")

    def emit(self, work: Any, target: str | None = None) -> None:
        if self.gives is not None and not isinstance(work, self.gives):
            raise PlanError(f"{type(self).__name__} gives {_named(self.gives)}, not {type(work).__name__}")
        self._out.append((work, target))

    def process(self, work: Any) -> list[tuple[Any, str | None]]:
        if self.takes is not None and not isinstance(work, self.takes):
            raise PlanError(f"{type(self).__name__} takes {_named(self.takes)}, not {type(work).__name__}")
        self.__dict__.setdefault("_out", [])
        if not self.__dict__.get("_ready"):
            self._ready = True
            self.postSetup()
        self._out = []
        self.handleWork(work)
        out, self._out = self._out, []
        return out


class FunctionJob(Job):
    """A job whose function's return value is emitted."""

    def __init__(self, fn: Callable, **config: Any):
        super().__init__(config)
        self.fn = fn

    def handleWork(self, work: Any) -> None:  # noqa: N802
        for out in outputs(applied(self.fn, work)):
            self.emit(out)


class Unwrap(Job):
    """A list's elements."""

    def handleWork(self, work: Any) -> None:  # noqa: N802
        for w in work:
            self.emit(w)


class Reducer:
    """Folds a ring. handleJoin merges partial stores; a reducer without one is folded in one task."""

    config: Mapping[str, Any] = {}
    global_config: Mapping[str, Any] = {}
    store_type: Callable[[], Any] = Object

    def __init__(self, config: Mapping[str, Any] | None = None, global_config: Mapping[str, Any] | None = None):
        self.config, self.global_config = config or {}, global_config or {}

    def postSetup(self) -> None:  # noqa: N802
        """Called once where the reducer runs."""

    def handleInit(self, store: Any) -> None:  # noqa: N802
        pass

    def handleAdd(self, store: Any, work: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleAdd")

    def handleJoin(self, store: Any, other: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleJoin")

    def handleDone(self, store: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleDone")

    def emit(self, work: Any) -> None:
        if self._adding:
            raise PlanError("a reducer emits when it is done, not when it adds")
        self._out.append(work)

    def recur(self, work: Any, target: str | None = None) -> None:
        self._again.append((work, target))

    @property
    def mergeable(self) -> bool:
        return type(self).handleJoin is not Reducer.handleJoin

    # what the engine calls; each returns (emitted, recurred)
    def _call(self, fn: Callable, *args: Any, adding: bool = False) -> tuple[list, list]:
        if not self.__dict__.get("_ready"):
            self._ready = True
            self.postSetup()
        self._out, self._again, self._adding = [], [], adding
        fn(*args)
        return self._out, self._again

    def open(self, first: Any) -> tuple[Any, list]:
        """A store, and the items that start the ring's work."""
        store = self.store_type()
        self._call(self.handleInit, store, adding=True)
        return store, [(first, None)]

    def add(self, store: Any, work: Any) -> list:
        return self._call(self.handleAdd, store, work, adding=True)[1]

    def join(self, store: Any, other: Any) -> None:
        self._call(self.handleJoin, store, other, adding=True)

    def done(self, store: Any) -> tuple[list, list]:
        return self._call(self.handleDone, store)


class Frame(Reducer):
    """A loop: the first item goes to the store, the items recurred run through the body."""

    def handleFirst(self, store: Any, first: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleFirst")

    def handleNext(self, store: Any, work: Any) -> None:  # noqa: N802
        raise NotImplementedError(f"{type(self).__name__}.handleNext")

    @property
    def mergeable(self) -> bool:
        return False

    def open(self, first: Any) -> tuple[Any, list]:
        store = self.store_type()
        return store, self._call(self.handleFirst, store, first, adding=True)[1]

    def add(self, store: Any, work: Any) -> list:
        return self._call(self.handleNext, store, work, adding=True)[1]


def reads(fn: Callable, place: int) -> bool:
    """Whether a Python function's code uses its parameter at that place."""
    code = getattr(fn, "__code__", None)
    if code is None or place >= code.co_argcount:
        return False
    name = code.co_varnames[place]
    used = (i.argval if isinstance(i.argval, tuple) else (i.argval,) for i in dis.get_instructions(code) if "LOAD_" in i.opname)
    return name in code.co_cellvars or any(name in names for names in used)


class FunctionReducer(Reducer):
    """fn(store, works, others); what it returns recurs, what emit(store) returns is emitted.

    others are partial stores to be merged. A function that never reads them can't merge: all that comes is
    then folded, in order, in one task, unless merge(store, other) is given.
    """

    def __init__(self, fn: Callable, store: Callable[[], Any] = Object, emit: Callable[[Any], Any] | None = None, merge: Callable[[Any, Any], Any] | None = None):
        super().__init__()
        self.fn, self.store_type, self.emit_of, self.merge = fn, store, emit or (lambda s: s), merge

    @property
    def mergeable(self) -> bool:
        return self.merge is not None or reads(self.fn, 2)

    def open(self, first: Any) -> tuple[Any, list]:
        return self.store_type(), [(first, None)]

    def add(self, store: Any, work: Any) -> list:
        return [(w, None) for w in outputs(self.fn(store, [work], []))]

    def join(self, store: Any, other: Any) -> list:
        return [(w, None) for w in outputs(self.merge(store, other) if self.merge else self.fn(store, [], [other]))]

    def done(self, store: Any) -> tuple[list, list]:
        return list(outputs(self.emit_of(store))), []


class FunctionFrame(Frame):
    """first(store, item) is a loop's header: what it returns goes through the body, None ends the loop."""

    def __init__(self, first: Callable, store: Callable[[], Any] = Object, emit: Callable[[Any], Any] | None = None):
        super().__init__()
        self.first, self.next, self.store_type, self.emit_of = first, None, store, emit or (lambda s: s)

    def open(self, first: Any) -> tuple[Any, list]:
        return _Loop(self.store_type(), first), []

    def _head(self, store: Any, first: Any) -> list:
        return [(w, None) for w in outputs(applied(self.first, first, store))]

    def add(self, store: _Loop, work: Any) -> list:
        return [(w, None) for w in outputs(applied(self.next, work, store.value))]

    def done(self, store: _Loop) -> tuple[list, list]:
        again = self._head(store.value, store.first)
        return ([], again) if again else (list(outputs(self.emit_of(store.value))), [])


class _Loop:
    def __init__(self, value: Any, first: Any):
        self.value, self.first = value, first


class Module:
    """Jobs in sequence (a list) or in a graph (a mapping of names, with `input` and each job's `to`)."""

    def __init__(self, jobs: list | Mapping[str, Any], reducer: Reducer | None = None, *, input: str | None = None, recur_to: Any = None, to: Any = None, path: str = "root"):  # noqa: A002
        self.reducer, self.recur_to, self.to, self.path = reducer, recur_to, to, path
        if isinstance(jobs, Mapping):
            if input is None:
                raise PlanError(f"{path}: a graph of jobs needs an input")
            self.jobs, self.input, self.sequence = dict(jobs), input, False
            for name in [input, *(t for j in jobs.values() for t in targets(j.to).values())]:
                if name not in self.jobs and name != "output":
                    raise PlanError(f"{path}: unknown job {name!r}")
        else:
            if input is not None:
                raise PlanError(f"{path}: a sequence of jobs takes no input")
            self.jobs, self.input, self.sequence = dict(enumerate(jobs)), 0 if jobs else "output", True
            for one, then in pairwise(jobs):
                gives, takes = getattr(one, "gives", None), getattr(then, "takes", None)
                if gives is not None and takes is not None and not issubclass(gives, takes):
                    raise PlanError(f"{path}: {type(one).__name__} gives {_named(gives)}, but {type(then).__name__} takes {_named(takes)}")
        for t in targets(recur_to).values():
            if t not in self.jobs and t not in ("output", "input"):
                raise PlanError(f"{path}: unknown job {t!r}")

    def after(self, name: Any, target: str | None) -> Any:
        if self.sequence:
            if target is not None:
                raise PlanError(f"{self.path}: a job in a sequence has one way out, not {target!r}")
            return name + 1 if name + 1 in self.jobs else "output"
        to = targets(self.jobs[name].to)
        if target not in to:
            raise PlanError(f"{self.path}.{name}: no target {target!r}")
        return to[target]

    def entry_of(self, target: str | None) -> Any:
        """Where recurred work goes in."""
        to = {None: "input"} if self.recur_to is None else targets(self.recur_to)
        if target is None and to.get(None, "input") == "input":
            return self.input
        if target not in to:
            raise PlanError(f"{self.path}: no recurTo {target!r}")
        return to[target]


def targets(to: Any) -> dict[str | None, Any]:
    return {None: "output"} if to is None else dict(to) if isinstance(to, Mapping) else {None: to}


def flow(module: Module, item: Any, entry: Any = None) -> Iterator[Any]:
    """What leaves the module's body for one item, last in first out."""
    stack = [(module.input if entry is None else entry, item)]
    while stack:
        name, work = stack.pop()
        if name == "output":
            yield work
            continue
        node = module.jobs[name]
        try:
            made = [(w, None) for w in run_item(node, work)] if isinstance(node, Module) else node.process(work)
        except PlanError:
            raise
        except Exception as e:
            e.add_note(f"in {module.path}::{name}, on {work!r:.200}")
            raise
        stack.extend((module.after(name, target), w) for w, target in reversed(made))


def run_item(module: Module, item: Any) -> Iterator[Any]:
    """What a module emits for one entering item, its ring included."""
    reducer = module.reducer
    if reducer is None:
        yield from flow(module, item)
        return
    store, pending = reducer.open(item)
    while True:
        stack = list(reversed(pending))
        while stack:
            work, target = stack.pop()
            for out in flow(module, work, module.entry_of(target)):
                stack.extend(reversed(reducer.add(store, out)))
        emitted, pending = reducer.done(store)
        yield from emitted
        if not pending:
            return
