"""Plans from YAML or dictionaries, with names of job classes from a registry.

    reducer: total            # or {type: total, recurTo: input}; or frame: ...
    jobs:                     # a list: in sequence; a mapping: a graph, with `input` and each job's `to`
      - addOne
      - {type: scale, by: 3}
      - {jobs: [...], reducer: ...}
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .plans.compile import Segment, checkpoint_of, delivered, each, interruptible, items_of, planned, resumed, values
from .plans.nodes import Frame, Job, Module, PlanError, Reducer
from .sources.staging import scratch

_registry: dict[str, type] = {}
#: Items queued for the next run() that is given none.
work: list[Any] = []


def register(kind: type, name: str | None = None) -> type:
    """Registers a job, reducer or frame class by its name; usable as a decorator."""
    name = name or getattr(kind, "NAME", None) or kind.__name__
    if name in _registry and _registry[name] is not kind:
        import logging

        logging.getLogger(__name__).warning("%s is registered twice; the later counts", name)
    _registry[name] = kind
    return kind


def _kind(name: Any, base: type, path: str) -> type:
    found = name if isinstance(name, type) else _registry.get(name)
    if found is None or not issubclass(found, base):
        raise PlanError(f"{path}: unknown {base.__name__.lower()} type {name!r}")
    return found


def module_of(config: Mapping[str, Any], root: Mapping[str, Any] | None = None, path: str = "root") -> Module:
    """The module a configuration describes."""
    root = config if root is None else root
    if not isinstance(config, Mapping) or "jobs" not in config:
        raise PlanError(f"{path}: a module needs jobs")
    if "frame" in config and "reducer" in config:
        raise PlanError(f"{path}: a frame and a reducer exclude each other")
    jobs = config["jobs"] if config["jobs"] is not None else []
    graph = isinstance(jobs, Mapping)
    if not graph and "input" in config:
        raise PlanError(f"{path}: a sequence of jobs takes no input")
    reducer = recur_to = None
    for word, base in (("reducer", Reducer), ("frame", Frame)):
        if word in config:
            given = config[word] if isinstance(config[word], Mapping) else {"type": config[word]}
            reducer = _kind(given.get("type"), base, f"{path}.{word}")(given, root)
            recur_to = given.get("recurTo")
    made: Any = {} if graph else []
    for name, given in jobs.items() if graph else enumerate(jobs):
        at = f"{path}::{name}"
        node = given if isinstance(given, Mapping) else {"type": given}
        if not graph and "to" in node:
            raise PlanError(f"{at}: a job in a sequence has no `to`")
        if graph and "to" not in node:
            raise PlanError(f"{at}: a job in a graph needs `to`")
        built = _kind(node["type"], Job, at)(node, root) if "type" in node else module_of(node, root, at)
        built.to = node.get("to")
        if graph:
            made[name] = built
        else:
            made.append(built)
    return Module(made, reducer, input=config.get("input"), recur_to=recur_to, path=path)


def loaded(source: str | Mapping[str, Any]) -> Mapping[str, Any]:
    """A mapping as it is; else a YAML text, or the path of a YAML file."""
    if isinstance(source, Mapping):
        return source
    import os

    import yaml

    if "\n" not in source and os.path.exists(source):
        with open(source) as f:
            source = f.read()
    found = yaml.safe_load(source)
    if not isinstance(found, Mapping):
        raise PlanError("the configuration isn't a mapping")
    return found


def run(config: str | Mapping[str, Any], given: Iterable[Any] | DataFrame | None = None, *, spark: SparkSession | None = None, handle=None, checkpoint: str | None = None, stop_after: int | None = None, **unknown: Any) -> list | None:
    """Runs a configured plan; returns the results, or hands each to handle.

    Without items of its own it takes those queued in `work`. checkpoint: see Work.
    """
    from .builder import active

    if unknown:
        raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
    spark, segments = spark or active(), [Segment(module_of(loaded(config)))]
    source = lambda: items_of(spark, list(work) if given is None else given)
    with interruptible(spark), scratch(spark):
        if checkpoint is None:
            table = isinstance(given, DataFrame)
            return _handed(planned(segments, given if table else source(), table), handle)
        state = checkpoint_of(spark, checkpoint, segments, stop_after=stop_after)
        with state.held():
            found = _handed(resumed(segments, source, spark, state), handle)
            delivered(spark, state)
            return found


def _handed(rows: DataFrame, handle) -> list | None:
    if handle is None:
        return values(rows)
    for item in each(rows):
        handle(item)
    return None
