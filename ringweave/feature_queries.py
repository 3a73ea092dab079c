"""Sources, sinks, Python jobs, rings, frames, checkpoints and checks of the engine as queries on the test tables, each with its SQL."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, external, recipes, stats
from .builder import Work
from .cli import main
from .operators import Checkpoint
from .plans.compile import Segment, items_of, planned, typed
from .plans.nodes import Args, Frame, Job, Module, Multiple, PlanError, Reducer
from .queries import configured, query, read
from .sources.lines import handle, printed, source_of, write_csv
from .sources.staging import new_path, shared_dir
from .sweep import sweep

config.register(recipes.Add, "add")
config.register(recipes.Total, "sum")


def column(spark: SparkSession, values: list, ddl: str) -> DataFrame:
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ddl)


def nations(spark: SparkSession, sf: str) -> list[tuple[int, str]]:
    return [tuple(r) for r in read(spark, sf, "nation").select("n_nationkey", "n_name").collect()]


def raises(kind: type[BaseException], fn) -> bool:
    try:
        fn()
    except kind:
        return True
    except Exception as e:  # an error of a task comes as one of Spark's, with its text
        return kind.__name__ in str(e)
    return False


# --- sources


@query("SELECT n_nationkey AS key, length(n_name) AS n FROM nation")
def memory_source(spark, sf):
    """Items of a Python list."""
    work = Work(nations(spark, sf), spark=spark)
    work.job(lambda nation: (nation[0], len(nation[1])))
    return typed(work.rows(), "value array<long>").select(F.col("value")[0].cast("int").alias("key"), F.col("value")[1].alias("n"))


@query("SELECT n_nationkey + 1 AS value FROM nation")
def queued_work(spark, sf):
    """Items queued in the module's list, for a run that is given none."""
    config.work[:] = [k for k, _ in nations(spark, sf)]
    try:
        return column(spark, config.run({"jobs": ["add"]}, spark=spark), "value int")
    finally:
        config.work.clear()


@query("SELECT * FROM (VALUES (1, 'a b'), (2, '5,6'), (3, 'x,y'), (4, '')) t(id, found)")
def source_precedence(spark, sf):
    """The seed line, then what was queued, then lines; nothing is no items."""
    lines = [" x \n", "\n", "y"]
    found = [source_of(spark, seed=["a", "b"], queued=[5], stream=lines), source_of(spark, queued=[5, 6], stream=lines), source_of(spark, stream=lines), source_of(spark)]
    return column(spark, [(i, ",".join(map(str, f))) for i, f in enumerate(found, 1)], "id int, found string")


@query("SELECT CAST(n_nationkey * 2 AS INTEGER) AS value FROM nation UNION ALL SELECT 100")
def init_once(spark, sf):
    """init adds an item by its return value, before the jobs."""
    calls = []
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)
    work.init(lambda: calls.append(1) or 50)
    work.job(lambda key: key * 2)
    out = work.frame_of("value int")
    assert calls == [1]
    return out


# --- sinks


@query("SELECT CAST(n_nationkey + 2 AS VARCHAR) AS line FROM nation")
def command_line(spark, sf):
    """A configured plan over typed lines of standard input, printed a line an item."""
    out = io.StringIO()
    status = main(["run", "jobs:\n- add\n- add\n", "--type", "int"], out, io.StringIO("".join(f" {k}\n\n" for k, _ in nations(spark, sf))))
    assert status == 0
    return column(spark, out.getvalue().split("\n")[:-1], "line string")


@query("SELECT r_regionkey || ' ' || r_name AS line FROM region")
def printed_rows(spark, sf):
    out = io.StringIO()
    printed(read(spark, sf, "region").select("r_regionkey", "r_name"), out)
    return column(spark, out.getvalue().split("\n")[:-1], "line string")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def callback_sink(spark, sf):
    seen = []
    handle(read(spark, sf, "nation").select("n_nationkey", "n_name"), lambda r: seen.append(tuple(r)))
    return column(spark, seen, "key int, name string")


@query("SELECT n_name AS name, n_nationkey * n_regionkey AS product FROM nation")
def result_sink(spark, sf):
    """Called on the driver once for each result, with Args unpacked."""
    seen = []
    with Work(read(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey"), spark=spark) as work:
        work.job(lambda n: Args(n["n_nationkey"], n["n_regionkey"], name=n["n_name"]))

        @work.result
        def take(a, b, name):
            seen.append((name, a * b))

    return column(spark, seen, "name string, product int")


@query("SELECT n_nationkey % 7 AS value FROM nation")
def run_list(spark, sf):
    """Without a sink run() gives the list of results."""
    work = Work([k for k, _ in nations(spark, sf)], spark=spark)
    work.job(lambda k: k % 7)
    return column(spark, work.run(), "value int")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def csv_sink(spark, sf):
    path = new_path(spark, "csv")
    write_csv(read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path)
    return spark.read.option("header", True).schema("key int, name string").csv(path)


@query("SELECT n_nationkey + 6 AS value FROM nation")
def yaml_plan(spark, sf):
    """A plan of YAML text, with a job that is named once and a ring for each item."""
    plan = "jobs:\n- &two {type: add, by: 2}\n- reducer: sum\n  jobs: [*two, *two]\n"
    return column(spark, config.run(plan, [k for k, _ in nations(spark, sf)], spark=spark), "value int")


# --- jobs


class Prepared(Job):
    """Emits an item and its neighbour; what it adds is prepared where it runs."""

    takes = int

    def postSetup(self):  # noqa: N802
        self.offset = self.config.get("offset", 0) + self.global_config.get("base", 0)

    def handleWork(self, work):  # noqa: N802
        self.emit(work + self.offset)
        self.emit(work + self.offset + 1)


@query("SELECT unnest([n_nationkey + 107, n_nationkey + 108]) AS value FROM nation")
def job_class(spark, sf):
    """A job class with its own and the plan's configuration, prepared once, that emits twice."""
    rows = read(spark, sf, "nation").select("n_nationkey")
    return configured(rows, {"base": 100, "jobs": [{"type": Prepared, "offset": 7}]}, "value int")


@query("SELECT n_nationkey + 11 AS value FROM nation WHERE n_nationkey % 2 = 1")
def class_inline(spark, sf):
    """A job class and a function as jobs of one pipeline; None is no output."""
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)
    work.job(lambda k: k if k % 2 else None)
    work.job(recipes.Add, by=11)
    return work.frame_of("value int")


@query("SELECT unnest(range(r_regionkey)) AS value FROM region")
def unwrapped_lists(spark, sf):
    from .plans.nodes import Unwrap

    work = Work(read(spark, sf, "region").select("r_regionkey"), spark=spark)
    work.job(lambda k: list(range(k)))
    work.job(Unwrap)
    return work.frame_of("value long")


@query("SELECT n_nationkey + 4 AS value FROM nation")
def bubbling_output(spark, sf):
    """What leaves the innermost of three modules is what the outermost emits to the next job."""
    deep = {"jobs": [{"jobs": [{"jobs": ["add", "add"]}, "add"]}]}
    return configured(read(spark, sf, "nation").select("n_nationkey"), {"jobs": [deep, "add"]}, "value int")


@query("SELECT string_agg(CAST(n_nationkey * 100 + a * 10 + b AS VARCHAR), ',' ORDER BY a, b) AS found FROM nation, (VALUES (1), (2)) t(a), (VALUES (1), (2)) u(b) GROUP BY n_nationkey")
def depth_first(spark, sf):
    """Of several items that a job emits the first goes all the way before the second starts."""

    class Digits(Job):
        def handleWork(self, work):  # noqa: N802
            self.emit(work * 10 + 1)
            self.emit(work * 10 + 2)

    class Listed(Reducer):
        store_type = list

        def handleAdd(self, store, work):  # noqa: N802
            store.append(work)

        def handleDone(self, store):  # noqa: N802
            self.emit(",".join(map(str, store)))

    return configured(read(spark, sf, "nation").select("n_nationkey"), Module([Module([Digits(), Digits()], Listed())]), "found string")


# --- rings


class Extremes(Reducer):
    """The least and largest item, in a store of its own kind."""

    class Pair:
        def __init__(self):
            self.low = self.high = None

        def take(self, low, high):
            self.low, self.high = low if self.low is None else min(self.low, low), high if self.high is None else max(self.high, high)

    store_type = Pair

    def handleAdd(self, store, work):  # noqa: N802
        store.take(work, work)

    def handleJoin(self, store, other):  # noqa: N802
        if other.low is not None:
            store.take(other.low, other.high)

    def handleDone(self, store):  # noqa: N802
        self.emit({"low": store.low, "high": store.high})


@query("SELECT min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def reducer_class(spark, sf):
    """A reducer class over all rows: stores of its own kind, folded in every task, joined in one."""
    work = Work(read(spark, sf, "lineitem").select("l_orderkey"), spark=spark)
    work.reduce(Extremes)
    return work.frame_of("low long, high long")


@query("SELECT CAST(sum(n_nationkey) AS BIGINT) AS value FROM nation UNION ALL SELECT count(*) FROM nation")
def reduce_merge_function(spark, sf):
    """Stores merged by a function of their own; what is emitted may be several items."""
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)

    @work.reduce(store=lambda: {"sum": 0, "n": 0}, emit=lambda s: Multiple([s["sum"], None, s["n"]]), merge=lambda s, o: s.update(sum=s["sum"] + o["sum"], n=s["n"] + o["n"]))
    def add(store, works, others):
        for w in works:
            store["sum"], store["n"] = store["sum"] + w, store["n"] + 1

    return work.frame_of("value long")


@query("SELECT CAST(max(v) AS BIGINT) AS value FROM (WITH RECURSIVE r AS (SELECT count(*) AS v FROM nation UNION ALL SELECT v * 2 FROM r WHERE v < 1000) SELECT v FROM r)")
def recur_over_all_rows(spark, sf):
    """The ring over all rows recurs its sum, twice each time, until it is large."""

    class Grown(recipes.Total):
        def handleDone(self, store):  # noqa: N802
            if store.value < 1000:
                self.recur(store.value)
            else:
                self.emit(store.value)

    rows = read(spark, sf, "nation").select(F.lit(1).alias("one"))
    return typed(planned([Segment(Module([], Grown()))], items_of(spark, rows)), "value long")


# --- frames


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS k, 1 AS v FROM nation UNION ALL SELECT k, v * 2 FROM r WHERE v < k) SELECT v AS value FROM r WHERE v >= k")
def inline_frame(spark, sf):
    """A loop of functions: its head, a job, its end."""
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)

    @work.frame(store=lambda: [1], emit=lambda s: s[0])
    def head(store, first):
        return store[0] if store[0] < first else None

    work.job(lambda v: v * 2)

    @work.frameEnd
    def end(store, v):
        store[0] = v

    return work.frame_of("value int")


@query("SELECT CAST(n_regionkey * n_nationkey AS INTEGER) AS value FROM nation")
def nested_frames(spark, sf):
    """A product by a loop of sums within a loop."""
    work = Work(read(spark, sf, "nation").select("n_regionkey", "n_nationkey"), spark=spark)
    work.job(lambda n: Args(n["n_regionkey"], n["n_nationkey"]))

    @work.frame(store=lambda: [0, 0], emit=lambda s: s[0])
    def outer(store, a, b):
        store[1] += 1
        return b if store[1] <= a else None

    @work.frame(store=lambda: [0], emit=lambda s: s[0])
    def inner(store, b):
        return 1 if store[0] < b else None

    @work.frameEnd
    def inner_end(store, one):
        store[0] += one

    @work.frameEnd
    def outer_end(store, total):
        store[0] += total

    return work.frame_of("value int")


@query("SELECT CAST(sum(1 << n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def frames_in_a_ring(spark, sf):
    """Each region is a ring; each of its nations loops in a frame, whose results the ring sums."""

    class Power(Frame):
        def handleFirst(self, store, first):  # noqa: N802
            store.left, store.value = first, 1

        def handleNext(self, store, work):  # noqa: N802
            store.left, store.value = store.left - 1, work

        def handleDone(self, store):  # noqa: N802
            (self.recur if store.left else self.emit)(store.value)

    class Double(Job):
        def handleWork(self, work):  # noqa: N802
            self.emit(work * 2)

    class Members(Job):
        def handleWork(self, work):  # noqa: N802
            for key in work:
                self.emit(key)

    regions = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("keys"))
    return configured(regions.select("keys"), Module([Module([Members(), Module([Double()], Power())], recipes.Total())]), "total long")


# --- sweeps


@query("SELECT * FROM (VALUES ('exact', 4, 4), ('least', 3, 3), ('capped', 5, 5)) t(name, low, high)")
def sweep_limits(spark, sf):
    """Trials of an exact sweep, of one that agrees at once, and of one that is capped while it disagrees."""
    out = []
    for name, trials, job in (("exact", 4, lambda id, trial, a: {"v": trial}), ("least", 0, lambda id, trial, a: {"v": a}), ("capped", -5, lambda id, trial, a: {"v": (-1) ** trial * 100})):
        with sweep({"a": [1, 2]}, trials, cpus=2, spark=spark, report=None) as work:
            work.job(job)
        out.append((name, int(work.report.trials.min()), int(work.report.trials.max())))
    return column(spark, out, "name string, low int, high int")


@query("SELECT * FROM (VALUES ('clash with a parameter', true), ('E and eps both zero', true), ('different keys', true), ('max with trials', true), ('min over max', true), ('min with exact trials', true), ('not a dict', true), ('trials not a number', true), ('unequal lists', true), ('unknown name', true)) t(rule, raised)")
def sweep_checks(spark, sf):
    """Arguments and results that a sweep refuses."""

    def swept(variables, trials=1, job=lambda id, trial, a: {"v": 1}, **parms):
        def run():
            with sweep(variables, trials, trialsParms=parms, cpus=1, spark=spark, report=None) as work:
                work.job(job)

        return run

    one = {"a": [1]}
    cases = {
        "trials not a number": (ValueError, swept(one, "3")),
        "unknown name": (ValueError, swept(one, other=1)),
        "min with exact trials": (ValueError, swept(one, 3, min=1)),
        "max with trials": (ValueError, swept(one, 3, max=9)),
        "E and eps both zero": (ValueError, swept(one, 0, E=0, eps=0)),
        "min over max": (ValueError, swept(one, 0, min=9, max=2)),
        "unequal lists": (ValueError, swept([{"a": 1}, {"b": 1}])),
        "not a dict": (PlanError, swept(one, job=lambda id, trial, a: 3)),
        "clash with a parameter": (PlanError, swept(one, job=lambda id, trial, a: {"a": 1})),
        "different keys": (PlanError, swept(one, 2, job=lambda id, trial, a: {"v": 1} if trial else {"w": 1})),
    }
    return column(spark, [(rule, raises(kind, fn)) for rule, (kind, fn) in cases.items()], "rule string, raised boolean")


@query("SELECT CAST(i AS INTEGER) AS id, CAST(3 AS INTEGER) AS trials, CAST(i * 10 AS DOUBLE) AS v FROM range(3) t(i)")
def sweep_output(spark, sf):
    """The report of a sweep as a CSV file."""
    import pandas as pd

    with tempfile.TemporaryDirectory() as folder:
        with sweep({"a": [0, 1, 2]}, 3, f"{folder}/out.csv", cpus=2, spark=spark, report=None) as work:
            work.job(lambda id, trial, a: {"v": a * 10})
        found = pd.read_csv(f"{folder}/out.csv")
    return column(spark, [(int(r.id), int(r.trials), float(r.v)) for r in found.itertuples()], "id int, trials int, v double")


# --- programs


@query("SELECT r_name AS out, 'note' AS err FROM region")
def invoke_program(spark, sf):
    names = [r[0] for r in read(spark, sf, "region").select("r_name").collect()]
    found = [external.invoke(["/bin/sh", "-c", f"printf '%s' '{n}'; printf note >&2"]) for n in names]
    return column(spark, found, "out string, err string")


@query("SELECT * FROM (VALUES ('third', '1,2'), ('InvokeError', '')) t(found, waits)")
def invoke_retry(spark, sf):
    """A passing failure is tried again, after longer and longer waits; another is an error."""
    with tempfile.TemporaryDirectory() as folder:
        script = f"n=$(cat {folder}/n 2>/dev/null || echo 0); echo $((n + 1)) > {folder}/n; if [ $n -lt 2 ]; then echo busy >&2; exit 1; fi; printf third"
        waits: list[float] = []
        out, _ = external.invoke(["/bin/sh", "-c", script], ["busy"], sleep=waits.append)
    other: list[float] = []
    failed = raises(external.InvokeError, lambda: external.invoke(["/bin/sh", "-c", "exit 3"], ["busy"], sleep=other.append))
    return column(spark, [(out, ",".join(map(str, waits))), ("InvokeError" if failed else "none", ",".join(map(str, other)))], "found string, waits string")


# --- running


@query("SELECT 'result' AS name, CAST(sum(n_nationkey + 1) AS VARCHAR) AS found FROM nation UNION ALL SELECT * FROM (VALUES ('stops', '2'), ('another plan', 'Mismatch'), ('once more', 'Finished'), ('no folder', 'FileNotFoundError'), ('info', 'finished'), ('changed', 'true')) t(name, found)")
def checkpoint_plan(spark, sf):
    """A plan that stops after each step and goes on, its marker, and the errors of wrong uses."""
    folder, keys, plan = f"{shared_dir(spark)}/ringweave-plan-{uuid.uuid4().hex}", [k for k, _ in nations(spark, sf)], {"reducer": "sum", "jobs": ["add"]}
    run = lambda plan=plan, at=folder, given=(), **more: config.run(plan, given, spark=spark, checkpoint=at, **more)
    named = lambda kind, fn: kind.__name__ if raises(kind, fn) else "none"
    out, stops, result = [], 0, None
    for given in (keys, ()):  # the second time nothing is given: the source is in the checkpoint
        with contextlib.suppress(Checkpoint.Stopped):
            run(given=given, stop_after=1)
            continue
        stops += 1
    out.append(("stops", str(stops)))
    out.append(("another plan", named(Checkpoint.Mismatch, lambda: run({"reducer": "sum", "jobs": []}))))
    (result,) = run()
    state = Checkpoint(folder, "")
    out += [("result", str(result)), ("once more", named(Checkpoint.Finished, run)), ("no folder", named(FileNotFoundError, lambda: run(at=f"{folder}/none/state")))]
    out += [("info", "finished" if "finished" in state.info(spark) else "other"), ("changed", str(state.modified(spark) > 0).lower())]
    return column(spark, out, "name string, found string")


@query("SELECT * FROM (VALUES ('cores', true), ('cpu seconds', true), ('idle seconds', true), ('jobs', true), ('rows', true), ('run seconds', true), ('tasks', true)) t(name, right_)")
def run_figures(spark, sf):
    """Figures of a run: rows that passed, jobs, tasks, and the executors' times."""
    rows = read(spark, sf, "lineitem")
    with stats.measured(spark) as run:
        run.observe(rows.where("l_quantity > 10"), "passed").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    right = {"rows": run.count("passed") == rows.where("l_quantity > 10").count(), "jobs": run.jobs > 0, "tasks": run.tasks > 0, "cores": run.cores == stats.cpu_count(spark) > 0, "run seconds": run.run_seconds > 0, "cpu seconds": 0 < run.cpu_seconds, "idle seconds": run.idle_seconds >= 0}
    return column(spark, list(right.items()), "name string, right_ boolean")


@query("SELECT n_name AS name FROM nation")
def external_in_jobs(spark, sf):
    """A program run by jobs, with its input."""
    work = Work(read(spark, sf, "nation").select("n_name"), spark=spark)
    work.job(lambda name: external.run_with_stdin(["/bin/cat"], name)[1])
    return work.frame_of("name string")


@query("SELECT * FROM (VALUES ('a failing job names its place', true), ('a job of another type', true), ('frame and reducer', true), ('frameEnd without frame', true), ('graph without input', true), ('init with parameters', true), ('input of a list', true), ('job after result', true), ('module without jobs', true), ('reduce of one parameter', true), ('reduce within a frame', true), ('target in a list', true), ('unknown argument', true), ('unknown job', true), ('unknown target', true), ('unknown type', true)) t(rule, raised)")
def guard_rails(spark, sf):
    """Uses that are refused."""

    def built(use):
        def run():
            use(Work([1], spark=spark))

        return run

    def after_result(w):
        w.result(lambda x: None)
        w.job(lambda x: x)

    def in_frame(w):
        w.frame(lambda s, x: None)
        w.reduce(lambda s, w, o: None)

    plan = lambda c, **more: lambda: config.run(c, [1], spark=spark, **more)

    def place() -> bool:
        try:
            config.run({"jobs": [{"jobs": ["add", {"type": Broken}]}]}, [1], spark=spark)
        except Exception as e:
            return "root::0::1" in str(e) or "root::0" in str(e)
        return False

    cases = {
        "job after result": (PlanError, built(after_result)),
        "reduce within a frame": (PlanError, built(in_frame)),
        "init with parameters": (PlanError, built(lambda w: w.init(lambda a: a))),
        "reduce of one parameter": (PlanError, built(lambda w: w.reduce(lambda a: a))),
        "frameEnd without frame": (PlanError, built(lambda w: w.frameEnd(lambda s, x: x))),
        "module without jobs": (PlanError, plan({})),
        "input of a list": (PlanError, plan({"input": "a", "jobs": ["add"]})),
        "target in a list": (PlanError, plan({"jobs": [{"type": "add", "to": "output"}]})),
        "graph without input": (PlanError, plan({"jobs": {"a": {"type": "add", "to": "output"}}})),
        "unknown target": (PlanError, plan({"input": "a", "jobs": {"a": {"type": "add", "to": "b"}}})),
        "unknown job": (PlanError, plan({"input": "b", "jobs": {"a": {"type": "add", "to": "output"}}})),
        "unknown type": (PlanError, plan({"jobs": ["no such job"]})),
        "frame and reducer": (PlanError, plan({"frame": recipes.Kept, "reducer": "sum", "jobs": []})),
        "unknown argument": (TypeError, plan({"jobs": []}, other=1)),
        "a job of another type": (PlanError, lambda: config.run({"jobs": [Prepared]}, ["text"], spark=spark)),
    }
    found = [(rule, raises(kind, fn)) for rule, (kind, fn) in cases.items()]
    return column(spark, [*found, ("a failing job names its place", place())], "rule string, raised boolean")


class Broken(Job):
    def handleWork(self, work):  # noqa: N802
        raise ValueError(f"cannot take {work}")


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS spread FROM orders")
def work_on_many_cores(spark, sf):
    """Tasks of a pipeline with a ring over all rows run in several processes at once, if there are cores for it."""
    work = Work(read(spark, sf, "orders").select("o_orderkey").repartition(8), spark=spark)
    work.job(lambda key: os.getpid())

    @work.reduce(store=lambda: [0, set()], emit=lambda s: {"n": s[0], "spread": len(s[1]) > 1})
    def count(store, works, others):
        for pid in works:
            store[0] += 1
            store[1].add(pid)
        for n, pids in others:
            store[0] += n
            store[1] |= pids

    return work.frame_of("n long, spread boolean").withColumn("spread", F.col("spread") | F.lit(stats.cpu_count(spark) == 1))
