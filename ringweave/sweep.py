"""Parameter sweeps whose trial counts adapt to a requested confidence.

Every round runs all experiments' open trials at once: trials are rows, dealt to all tasks, and their
figures are aggregated by experiment with partial sums, so an experiment of very many trials is no
large task. Means and deviations of rounds are merged from counts, means and squared deviations. A
round then decides how many more trials each experiment gets.
"""

from __future__ import annotations

import contextlib
import logging
import math
import pickle
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .builder import Work, active
from .plans.nodes import Args, Module, PlanError, run_item
from .sources.staging import staged

log = logging.getLogger(__name__)
#: Two-sided 95 % points by degrees of freedom, each from that number on.
POINTS = ((16, 1.96), (10, 2.23), (5, 2.57), (4, 2.78), (3, 3.18), (2, 4.30), (1, 12.71))
#: Relative and absolute error, and the least and most trials, unless others are given.
DEFAULTS = {"E": 0.1, "eps": 1e-2, "min": 3, "max": 10000}


def critical(n: Column) -> Column:
    """The z or t value for n trials."""
    out = F
    for least, value in POINTS:
        out = out.when(n - 1 >= least, value)
    return out.otherwise(1.96)


def needed(n: Column, mean: Column, dev: Column, relative: float, absolute: float) -> Column:
    """Trials after which the mean is within the error at 95 % confidence; null if the mean is not a number."""
    error = F.greatest(F.lit(float(relative)) * F.abs(mean), F.lit(float(absolute)))
    extra = F.when(n - 1 > 15, 0).otherwise(1)
    return F.when(~F.isnan(mean), F.ceil(F.pow(critical(n) * dev / error, F.lit(2.0)) + extra))


def grid(spark: SparkSession, variables: Mapping[str, DataFrame]) -> DataFrame:
    """All combinations of one-column tables with ids from 0, the first fastest; each table's values are numbered in its order.

    The tables are parameters' values: each is numbered in one task.
    """
    out, size = None, 1
    for name, values in variables.items():
        n = values.count()
        numbered = values.coalesce(1).select(F.col(values.columns[0]).alias(name), (F.monotonically_increasing_id() * size).alias(f"_i_{name}"))
        out = numbered if out is None else out.crossJoin(numbered)
        size *= max(n, 1)
    total = sum((F.col(f"_i_{name}") for name in variables), F.lit(0).cast("long"))
    return out.withColumn("id", total.cast("long")).select("id", *variables)


def experiments(variables: Any) -> tuple[list[dict], list[str]]:
    """The parameter sets, in order of their ids, and the parameters' names."""
    if isinstance(variables, list):
        if any(not isinstance(v, dict) for v in variables):
            raise ValueError("a list of variables must hold dicts")
        if len({frozenset(v) for v in variables}) > 1:
            raise ValueError("all parameter dicts must have the same keys")
        return [dict(v) for v in variables], sorted(variables[0]) if variables else []
    if not isinstance(variables, dict):
        raise ValueError(f"variables must be a list or a dict, not {variables!r}")
    names, sizes = list(variables), [len(v) for v in variables.values()]
    out = []
    for i in range(math.prod(sizes)):
        place, own = i, {}
        for name, size in zip(names, sizes, strict=True):
            own[name] = variables[name][place % size]
            place //= size
        out.append(own)
    return out, sorted(names)


def limits(trials: int, given: Mapping[str, Any]) -> dict[str, Any]:
    """E, eps, min and max after all checks."""
    if not isinstance(trials, int) or isinstance(trials, bool):
        raise ValueError("trials must be int")
    if not isinstance(given, Mapping):
        raise ValueError("trialsParms must be a dict")
    if unknown := set(given) - set(DEFAULTS):
        raise ValueError(f"unknown trialsParms: {', '.join(sorted(unknown))}")
    if "min" in given and trials > 0:
        raise ValueError("min can't be given with an exact number of trials")
    if "max" in given and trials != 0:
        raise ValueError("max can't be given with trials; use negative trials")
    out = DEFAULTS | dict(given)
    if out["E"] <= 0 and out["eps"] <= 0:
        raise ValueError("E and eps can't both be zero")
    if out["min"] > out["max"]:
        raise ValueError("min can't be greater than max")
    if trials:
        out["max"] = abs(trials)
        out["min"] = trials if trials > 0 else min(out["min"], -trials)
    return out


def _run_trials(open_: DataFrame, body: Module, names: list[str]) -> DataFrame:
    """id, key and the merged figures of the trials in open_ (id, parameters, first, next)."""
    code = cloudpickle.dumps(body)
    trials = open_.select("id", "parameters", F.explode(F.expr("sequence(first, next - 1)")).alias("trial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(code)
        for batch in batches:
            out: list[tuple] = []
            for i, parameters, trial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given = pickle.loads(parameters)
                got = list(run_item(own, Args(**({"id": i, "trial": trial} | given))))
                if len(got) != 1 or not isinstance(got[0], dict):
                    raise PlanError(f"a trial must give one dict, not {got!r:.300}")
                if clash := set(got[0]) & {"id", "trials", *names}:
                    raise PlanError(f"results named as parameters: {', '.join(sorted(clash))}")
                out += [(i, trial, k, float(v), len(got[0])) for k, v in got[0].items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["id", "trial", "key", "value", "keys"])

    found = trials.repartition("id", "trial").mapInArrow(run, "id long, trial long, key string, value double, keys long")
    return found.groupBy("id", "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"), F.min("keys").alias("fewest"), F.max("keys").alias("most"))


def merged(parts: DataFrame) -> DataFrame:
    """Counts, means and squared deviations of rounds as one."""
    both = parts.groupBy("id", "key").agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"), F.min("fewest").alias("fewest"), F.max("most").alias("most"))
    spread = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return both.select("id", "key", "n", "mean", spread.alias("m2"), "fewest", "most")


@contextlib.contextmanager
def sweep(variables: Any = None, trials: int = 0, output: str | None = None, trialsParms: Mapping[str, Any] | None = None, showProgress: bool = True, *, cpus: int | None = None, spark: SparkSession | None = None, report=print) -> Iterator[Work]:  # noqa: N803
    """`with sweep({'a': [...]}) as w:` and jobs that take id, trial and the parameters and give a dict.

    After the block, w.report is a pandas table indexed by id: trials, parameters, and mean, deviation
    and 95 % error of each result. It is printed, and written to `output` as CSV if that is given.
    """
    if output is not None and not isinstance(output, str):
        raise ValueError("output must be str or None")
    found, names = experiments({} if variables is None else variables)
    bounds = limits(trials, {} if trialsParms is None else trialsParms)
    work = Work(spark=spark)
    yield work
    if work.segments or len(work.scopes) > 1 or work.sink:
        raise PlanError("a sweep's jobs may not hold a reduction over all trials or a sink")
    work.report = _report(spark or active(), found, names, bounds, Module(work.scopes[0][0]), showProgress, cpus)
    if report:
        report(work.report.to_string())
    if output is not None:
        work.report.to_csv(output)


def _report(spark: SparkSession, found: list[dict], names: list[str], bounds: Mapping[str, Any], body: Module, show: bool, cpus: int | None):
    import pandas as pd

    if not found:
        return pd.DataFrame(columns=["id", "trials", *names]).set_index("id")
    cpus = cpus or spark.sparkContext.defaultParallelism
    first = min(bounds["max"], max(bounds["min"], cpus // len(found)))
    sets = spark.createDataFrame([(i, bytearray(cloudpickle.dumps(p)), 0, first) for i, p in enumerate(found)], "id long, parameters binary, first long, next long")
    open_, figures, step = sets, None, 0
    while True:
        new = _run_trials(open_, body, names)
        figures = staged(merged(new if figures is None else figures.unionByName(new)), "sweep")
        bad = figures.withColumn("of_id", F.max("n").over(Window.partitionBy("id"))).where((F.col("fewest") != F.col("most")) | (F.col("n") != F.col("of_id"))).limit(1).count()
        if bad:
            raise PlanError("every trial must give the same keys")
        dev = F.sqrt(F.greatest(F.col("m2") / F.col("n"), F.lit(0.0)))
        want = figures.groupBy("id").agg(F.max("n").alias("done"), F.max(needed(F.col("n"), F.col("mean"), dev, bounds["E"], bounds["eps"])).alias("need"))
        most = bounds["max"]
        grown = F.when((F.col("done") == 1) & F.lit(most > 1), F.lit(2)).when(F.col("done") == 1, F.lit(1)).otherwise(F.greatest(F.col("done"), F.least(F.coalesce("need", F.lit(0)), F.lit(most), 3 * F.col("done"))))
        open_ = staged(sets.select("id", "parameters").join(want, "id").select("id", "parameters", F.col("done").alias("first"), grown.cast("long").alias("next")).where("next > first"), "sweep")
        step += 1
        left = open_.count()
        if show:
            log.info("round %d of the sweep is done; %d experiments go on", step, left)
        if not left:
            break
    n, dev = F.col("n"), F.sqrt(F.greatest(F.col("m2") / F.col("n"), F.lit(0.0)))
    rows = figures.select("id", "key", "n", "mean", dev.alias("dev"), (critical(n) * dev / F.sqrt(n)).alias("err")).toPandas()
    keys = sorted(rows["key"].unique())
    out = []
    for i, own in rows.groupby("id"):
        row = {"id": i, "trials": int(own["n"].max()), **found[i]}
        for r in own.itertuples():
            row |= {r.key: r.mean, f"{r.key}_dev": r.dev, f"{r.key}_err": r.err}
        out.append(row)
    columns = sorted(c for k in keys for c in (k, f"{k}_dev", f"{k}_err"))
    if clash := set(columns) & set(names) or len(set(columns)) != len(columns):
        raise PlanError(f"results clash with parameters or each other: {clash}")
    return pd.DataFrame(out, columns=["id", "trials", *names, *columns]).sort_values("id").set_index("id")
