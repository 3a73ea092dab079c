"""Rings, frames, the decorator API, configurations and sweeps against known results."""

import contextlib
import io
import math
import os
import random
import time

import pytest
from pyspark import InheritableThread

import ringweave
from ringweave import Args, Frame, Job, Multiple, Object, PlanError, Reducer, Work, register
from ringweave.cli import main
from ringweave.config import module_of, run
from ringweave.operators.loops import Checkpoint
from ringweave.plans.nodes import FunctionReducer, Module, reads, run_item


class addOne(Job):
    def handleWork(self, work):
        self.emit(work + 1)


class duplicate(Job):
    def handleWork(self, work):
        self.emit(work)
        self.emit(work)


class getToTen(Job):
    def handleWork(self, work):
        self.emit(work, "keep_going" if work < 10 else "done")


def wrapped(x):
    return (x + 2**31) % 2**32 - 2**31


class total(Reducer):
    def handleInit(self, store):
        store.value = 0

    def handleAdd(self, store, work):
        store.value = wrapped(store.value + work)

    def handleJoin(self, store, other):
        store.value = wrapped(store.value + other.value)

    def handleDone(self, store):
        self.emit(store.value)


class unmergeable(total):
    handleJoin = Reducer.handleJoin


class getToValue(total):
    def handleAdd(self, store, work):
        if work < 3:
            self.recur(3)
        store.value = wrapped(store.value + work)

    def handleDone(self, store):
        if store.value >= self.config["value"]:
            self.emit(store.value)
        else:
            self.recur(store.value)


class charAverage(Frame):
    def handleFirst(self, store, first):
        store.n, store.sum = len(first), 0
        for c in first:
            self.recur(ord(c))

    def handleNext(self, store, work):
        store.sum += work

    def handleDone(self, store):
        self.emit(store.sum // store.n)


class getToCap(Frame):
    def handleFirst(self, store, first):
        store.value = first

    def handleNext(self, store, work):
        store.value = work

    def handleDone(self, store):
        if store.value >= self.config["cap"]:
            self.emit(store.value)
        else:
            self.recur(store.value)


class growHalf(Job):
    def handleWork(self, work):
        self.emit(work + work // 2 + 1)


class typedConfig(Job):
    def handleWork(self, work):
        x = self.config["x"]
        self.emit(f"{x}{work}" if isinstance(x, str) else "hi" if isinstance(work, str) else work + x)


for _k in (addOne, duplicate, getToTen, total, unmergeable, getToValue, charAverage, getToCap, growHalf, typedConfig):
    register(_k)

ADD3 = {"jobs": ["addOne", "addOne", "addOne"]}
NESTED = {
    "jobs": [
        "addOne",
        {"reducer": "total", "jobs": ["duplicate", {"reducer": "total", "jobs": [
            "addOne",
            {"reducer": {"type": "getToValue", "value": 1000}, "jobs": ["addOne", "duplicate", {"reducer": "total", "jobs": ["addOne"]}]},
            {"reducer": "total", "jobs": ["duplicate", {"reducer": "total", "jobs": ["addOne"]}]},
        ]}]},
    ]
}

CASES = [
    ({"reducer": "total", "jobs": ["addOne", "addOne"]}, [45, 7], [56]),
    ({"reducer": "unmergeable", "jobs": ["addOne", "addOne"]}, [45, 7], [56]),
    ({"jobs": ["addOne", {"reducer": "total", "jobs": ["duplicate"]}]}, [1, 2, 3], [4, 6, 8]),
    ({"input": "check", "jobs": {"check": {"type": "getToTen", "to": {"keep_going": "add", "done": "output"}}, "add": {"type": "addOne", "to": "check"}}}, [1, 8, 12], [10, 10, 12]),
    ({"reducer": {"type": "getToValue", "value": 100}, "jobs": ["duplicate", "addOne"]}, [1], [188]),
    ({"jobs": [{"frame": "charAverage", "jobs": ["addOne"]}]}, ["abba", "kadoodle", "j"], [98, 105, 107]),
    ({"jobs": [ADD3, ADD3]}, [10, 16, 90], [16, 22, 96]),
    (NESTED, list(range(10)), [4532, 5180, 5828, 6476, 7124, 7772, 8420, 9068, 9716, 11660]),
    (NESTED, [-400000] * 4, [1442058676] * 4),
    ({"jobs": [{"frame": {"type": "getToCap", "cap": 50}, "jobs": ["growHalf"]}, "addOne", {"frame": {"type": "getToCap", "cap": 100}, "jobs": ["growHalf"]}, "addOne"]}, [1, 2, 3, 4], [110, 143, 143, 143]),
    ({"jobs": []}, [1, 2], [1, 2]),
    ({"reducer": "total", "jobs": ["addOne"]}, [], []),
    ({"jobs": [{"type": "typedConfig", "x": 5}]}, [5, 8], [10, 13]),
    ({"jobs": [{"type": "typedConfig", "x": "hi"}]}, [5], ["hi5"]),
]


@pytest.mark.parametrize(("config", "work", "expected"), CASES)
def test_configured(spark, config, work, expected):
    assert sorted(run(config, work, spark=spark)) == expected


def test_empty_ring_gives_its_first_store():
    class drop(Job):
        def handleWork(self, work):
            pass

    assert list(run_item(module_of({"reducer": total, "jobs": [drop]}), 5)) == [0]


@pytest.mark.parametrize(
    "config",
    [{}, {"jobs": ["nope"]}, {"jobs": [], "input": "a"}, {"jobs": {"a": {"type": "addOne", "to": "output"}}}, {"jobs": {"a": {"type": "addOne"}}, "input": "a"}, {"jobs": {"a": {"type": "addOne", "to": "b"}}, "input": "a"}, {"jobs": [{"type": "addOne", "to": "output"}]}, {"jobs": [], "reducer": "total", "frame": "charAverage"}, {"jobs": [], "reducer": "nope"}, {"jobs": {"a": {"type": "addOne", "to": "output"}}, "input": "b"}],
)
def test_bad_configurations(config):
    with pytest.raises(PlanError):
        module_of(config)


def test_unknown_arguments_raise(spark):
    with pytest.raises(TypeError):
        run({"jobs": []}, [1], spark=spark, other=3)


def test_jobs_and_multiple(spark):
    w = Work([1, 2], spark=spark)

    @w.init
    def more():
        return Multiple([3, [4, 5]])

    @w.job
    def several(x):
        return Multiple(y for y in [x, None, x * 10])

    @w.job(useMultiprocessing=False)
    def odd(x):
        return x if x % 2 else None

    assert sorted(w.run()) == [1, 3, 5]


def test_reduce_then_jobs(spark):
    w = Work([1, 2, 3], spark=spark)

    @w.reduce(store=lambda: [0], emit=lambda s: s[0])
    def add(store, works, others):
        store[0] += sum(works) + sum(o[0] for o in others)

    @w.job
    def three(x):
        return Multiple([x] * 3)

    @w.reduce(store=lambda: [0], emit=lambda s: s[0])
    def again(store, works, others):
        store[0] += sum(works) + sum(o[0] for o in others)

    assert w.run() == [18]


def test_reduce_over_nothing_emits_its_store(spark):
    w = Work([], spark=spark)

    @w.reduce(store=lambda: [7], emit=lambda s: s[0])
    def add(store, works, others):
        raise AssertionError

    assert w.run() == [7]
    assert Work([], spark=spark).run() == []


def test_global_recurrence(spark):
    w = Work([1, 2], spark=spark)

    @w.job
    def add(x):
        return x + 1

    @w.reduce(store=lambda: [], emit=lambda s: sorted(s))
    def until(store, works, others):
        for x in works:
            store.append(x)
        for o in others:
            store.extend(o)
        return Multiple([x for x in works if x < 5])

    assert w.run() == [[2, 3, 3, 4, 4, 5, 5]]


def test_frames(spark):
    w = Work([3, 8, 9], spark=spark)

    @w.frame(emit=lambda s: s.value)
    def head(store, first):
        if not hasattr(store, "value"):
            store.value = 1
        return store.value if store.value < first else None

    @w.job
    def twice(x):
        return x * 2

    @w.frameEnd
    def tail(store, x):
        store.value = x

    assert sorted(w.run()) == [4, 8, 16]


def test_nested_frames_and_args(spark):
    w = Work([Args(1, 2, d=4, c=3)], spark=spark)

    @w.job
    def name(a, b, c, d):
        assert (a, b, c, d) == (1, 2, 3, 4)
        return Args(a + b, c + d)

    @w.frame(emit=lambda s: s.n)
    def outer(store, a, b):
        store.n = getattr(store, "n", 0)
        return a if store.n < b else None

    @w.frame(emit=lambda s: s.m)
    def inner(store, x):
        store.m = getattr(store, "m", 0)
        return 1 if store.m < x else None

    @w.frameEnd
    def inner_end(store, x):
        store.m += x

    @w.frameEnd
    def outer_end(store, x):
        store.n += x

    assert w.run() == [9]


def test_classes_inline(spark):
    w = Work([3, 4], spark=spark)
    w.job(addOne)
    w.job(addOne)
    w.reduce(total)
    assert w.run() == [11]


def test_sinks(spark):
    seen = []
    with Work([1, 2, 3], spark=spark) as w:

        @w.result
        def take(x):
            seen.append(x)

    assert sorted(seen) == [1, 2, 3]
    w = Work([1, 2, 3], spark=spark)
    w.finish(lambda found: sorted(found))
    assert w.run() == [1, 2, 3]
    w = Work([1], spark=spark)
    w.finish(lambda found: Multiple([1, 2]))
    with pytest.raises(PlanError):
        w.run()


def test_guards(spark):
    w = Work([1], spark=spark)
    w.result(lambda x: None)
    for late in (w.job, w.reduce, w.result, w.finish, w.frame, w.init):
        with pytest.raises(PlanError):
            late(lambda a, b=1, c=2: None)
    w = Work([1], spark=spark)
    for use, bad in ((w.init, lambda a: 1), (w.finish, lambda: 1), (w.reduce, lambda a: 1), (w.job, lambda: 1), (w.frame, lambda a: 1), (w.result, lambda: 1)):
        with pytest.raises(PlanError):
            use(bad)
    with pytest.raises(PlanError):
        w.frameEnd(lambda s, x: None)
    w.frame(lambda s, x: None)
    with pytest.raises(PlanError):
        w.reduce(lambda s, a, b: None)
    with pytest.raises(PlanError):
        w.run()


def test_map(spark):
    assert ringweave.map(lambda x: x * x, range(100), spark=spark) == [x * x for x in range(100)]
    assert ringweave.map(lambda a, b, k: (a, b, k), [1, 2, 3], "ab", spark=spark, k=5) == [(1, "a", 5), (2, "b", 5)]
    assert ringweave.map(lambda x: None, [1, 2], spark=spark) == [None, None]
    assert ringweave.map(abs, [], spark=spark) == []


def slow(x):
    time.sleep(0.25)
    return x, os.getpid()


def test_jobs_run_on_all_cores(spark):
    """One core takes eight seconds for each of these, four take two and what starting takes."""
    ringweave.map(slow, range(4), spark=spark)  # workers start
    began = time.monotonic()
    found = ringweave.map(slow, range(32), spark=spark)
    assert time.monotonic() - began < 6 and [x for x, _ in found] == list(range(32)) and len({p for _, p in found}) > 1
    for frame in (None, spark.range(32).repartition(8)):
        w = Work(range(32) if frame is None else frame, spark=spark)
        w.job(slow)

        @w.reduce(store=lambda: [0, set()], emit=lambda s: (s[0], len(s[1])))
        def total(store, works, others):
            for x, p in works:
                store[0] += x
                store[1].add(p)
            for n, p in others:
                store[0] += n
                store[1] |= p

        began = time.monotonic()
        ((n, workers),) = w.run()
        assert n == 496 and workers > 1 and time.monotonic() - began < 6
    w = Work(range(32), spark=spark)
    w.job(slow)
    w.reduce(store=list, emit=len)(lambda store, works, others: store.extend(works))
    began = time.monotonic()
    assert w.run() == [32] and time.monotonic() - began < 6


def test_functions_that_fold_only_works(spark):
    w = Work(range(10), spark=spark)
    w.reduce(store=list, emit=sum)(lambda store, works, others: store.extend(works))
    assert w.run() == [45]
    w = Work(spark.range(0, 1000, 1, 7), spark=spark)
    w.reduce(store=list, emit=lambda s: s)(lambda store, works, others: store.extend(works))
    assert w.run() == [list(range(1000))]  # in the order of the rows
    w = Work(range(10), spark=spark)
    w.reduce(store=lambda: [0], emit=lambda s: s[0], merge=lambda s, o: s.__setitem__(0, s[0] + o[0]))(lambda store, works, others: store.__setitem__(0, store[0] + sum(works)))
    assert w.run() == [45]
    assert reads(lambda a, b, c: c, 2) and reads(lambda a, b, c: [c for _ in b], 2) and not reads(lambda a, b, c: b, 2) and not reads(sum, 2)


def test_any_item_may_be_reduced(spark):
    import numpy as np

    w = Work([np.arange(3), np.arange(3)], spark=spark)
    w.reduce(store=lambda: [0], emit=lambda s: s[0])(lambda store, works, others: store.__setitem__(0, store[0] + works[0]))
    assert w.run()[0].tolist() == [0, 2, 4]
    w = Work(["\0started", "a", ""], spark=spark)
    w.reduce(store=list, emit=lambda s: s)(lambda store, works, others: store.extend(works))
    assert w.run() == [["\0started", "a", ""]]


def test_frames_over_all_rows(spark):
    class Words(Frame):
        def handleFirst(self, store, first):
            store.found, store.left = [f"first {first}"], 2

        def handleNext(self, store, work):
            store.found.append(work)

        def handleDone(self, store):
            store.left -= 1
            if store.left < 0:
                self.emit(store.found)
            else:
                self.recur("r")

    class Loud(Job):
        def handleWork(self, work):
            self.emit(work.upper())

    config = {"frame": Words, "jobs": [Loud]}
    assert run(config, ["a", "b", "c"], spark=spark) == [["first a", "b", "c", "R", "R"]]
    assert run(config, [], spark=spark) == []


def test_stores_merge_in_between(spark):
    """As on a cluster of many cores."""
    from ringweave.plans import compile as c

    class Many:
        def __getattr__(self, name):
            return 100 if name == "defaultParallelism" else getattr(spark.sparkContext, name)

    rows = c.items_of(spark, range(300), 40)

    def gather(store, works, others):
        for more in (works, *others):
            store.extend(more)

    module = Module([], FunctionReducer(gather, list, sorted))

    class Session:
        sparkContext = Many()

        def __getattr__(self, name):
            return getattr(spark, name)

    class Rows:
        sparkSession = Session()

        def __getattr__(self, name):
            return getattr(rows, name)

    assert c.values(c._reduced(c.Segment(module, True), Rows())) == [list(range(300))]


def test_types_of_edges(spark):
    class Number(Job):
        takes, gives = str, int

        def handleWork(self, work):
            self.emit(int(work) if work != "odd" else work)

    class Text(Job):
        takes, gives = (int, float), str

        def handleWork(self, work):
            self.emit(str(work))

    assert list(run_item(Module([Number(), Text(), Number()]), "7")) == [7]
    with pytest.raises(PlanError, match="Number gives int, but Number takes str"):
        Module([Number(), Number()])
    with pytest.raises(PlanError, match="takes str, not int"):
        list(run_item(Module([Number()]), 7))
    with pytest.raises(PlanError, match="gives int, not str"):
        list(run_item(Module([Number()]), "odd"))


def test_pieces_of_pipelines(spark):
    class Greeter:
        def __init__(self, word):
            self.word = word

        @classmethod
        def jobs_greet(cls, w):
            @w.job
            def greet(greeter, name):
                return f"{greeter.word} {name}"

    w = Work([("hello", "a"), ("bye", "b")], spark=spark)
    w.job(lambda given: Args(Greeter(given[0]), given[1]))
    Greeter.jobs_greet(w)
    w.include(lambda w: w.job(str.upper))
    assert sorted(w.run()) == ["BYE B", "HELLO A"]


def test_queued_work(spark):
    ringweave.work[:] = [1, 2]
    try:
        assert sorted(run({"jobs": [addOne]}, spark=spark)) == [2, 3]
    finally:
        ringweave.work.clear()


def test_configured_plans_go_on_from_their_checkpoint(spark, tmp_path):
    config, folder = {"reducer": "total", "jobs": [addOne]}, f"file://{tmp_path}/state"
    for step in (1, 2):
        with pytest.raises(Checkpoint.Stopped):
            run(config, [1, 2, 3], spark=spark, checkpoint=folder, stop_after=1)
        assert f"stopped after step {step}" in Checkpoint(folder, "").info(spark)
    with pytest.raises(Checkpoint.Mismatch):
        run({"reducer": "total", "jobs": []}, [1], spark=spark, checkpoint=folder)
    with Checkpoint(folder, "").held(), pytest.raises(Checkpoint.Busy):
        run(config, [], spark=spark, checkpoint=folder)
    assert run(config, [], spark=spark, checkpoint=folder) == [9]
    with pytest.raises(Checkpoint.Finished):
        run(config, [], spark=spark, checkpoint=folder)
    with pytest.raises(FileNotFoundError):
        run(config, [1], spark=spark, checkpoint=f"file://{tmp_path}/none/state")


def test_manifests_are_whole_at_any_time(spark, tmp_path):
    at = Checkpoint(f"file://{tmp_path}/m", "x")
    at.write(spark, {"step": 1, "done": False})
    at.write(spark, {"step": 2, "done": False})
    (tmp_path / "m" / ".writing-x").write_text("half")
    assert at.read(spark)["step"] == 2 and sorted(p.name for p in (tmp_path / "m").glob("manifest*")) == ["manifest-000000001.json"]
    # a crash between the new manifest and the removal of the old one
    (tmp_path / "m" / "manifest-000000000.json").write_text("{}")
    assert at.read(spark)["step"] == 2


def test_staged_tables_are_removed(spark):
    from ringweave.sources.staging import scratch, shared_dir, staged

    with scratch(spark) as paths:
        assert staged(spark.range(3), "t").count() == 3
        assert len(paths) == 1 and os.path.isdir(paths[0].removeprefix("file://"))
    assert not os.path.exists(paths[0].removeprefix("file://"))
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    w = Work([1, 2], spark=spark)
    w.reduce(total)
    assert w.run() == [3]
    with Work([1, 2], spark=spark) as w:
        w.result(lambda x: None)
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before


def test_interrupts_cancel_jobs(spark):
    from ringweave.plans.compile import interruptible

    tracker, errors = spark.sparkContext.statusTracker(), []

    def work():
        with contextlib.suppress(Exception):
            errors.append(ringweave.map(time.sleep, [60] * 4, spark=spark))

    with pytest.raises(KeyboardInterrupt), interruptible(spark):
        thread = InheritableThread(target=work)
        thread.start()
        while not tracker.getActiveJobsIds():
            time.sleep(0.1)
        raise KeyboardInterrupt
    thread.join(20)
    assert not thread.is_alive() and not errors and not tracker.getActiveJobsIds()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_dataframes_in_and_out(spark):
    w = Work(spark.range(5), spark=spark)
    w.job(lambda x: {"a": x, "b": str(x)})
    assert sorted(map(tuple, w.frame_of("a long, b string").collect())) == [(i, str(i)) for i in range(5)]


def test_errors_name_the_place(spark):
    w = Work([0], spark=spark)
    w.job(lambda x: 1 / x)
    with pytest.raises(Exception, match="ZeroDivision"):
        w.run()
    assert Object(a=1) == Object(a=1)


# --- sweeps


def swept(spark, variables, trials=0, cpus=8, value=lambda **k: 1.0, **parms):
    with ringweave.sweep(variables, trials, trialsParms=parms, cpus=cpus, spark=spark, report=None) as w:
        w.job(lambda id, trial, **k: {"value": value(id=id, trial=trial, **k)})
    return w.report


@pytest.mark.parametrize(("trials", "cpus", "expected"), [(0, 1, 3), (0, 8, 8), (-3, 8, 3), (-10, 8, 8), (1, 100, 1)])
def test_sweep_counts(spark, trials, cpus, expected):
    assert swept(spark, {"a": [1]}, trials, cpus).trials.tolist() == [expected]


def test_sweep_grid_and_statistics(spark):
    assert swept(spark, {"a": [1, 2], "b": [3, 4]}, 0, 32).trials.tolist() == [8] * 4
    got = swept(spark, {"a": [1]}, -8, 8, lambda trial, **k: trial, min=3)
    assert got.iloc[0].tolist() == [8, 1, 3.5, pytest.approx(2.29128784747792), pytest.approx(2.081937949363525)]
    assert list(got.columns) == ["trials", "a", "value", "value_dev", "value_err"]
    both = swept(spark, {"a": [1, 2], "b": [3, 4, 5]}, 1)
    assert both[["a", "b"]].values.tolist() == [[1, 3], [2, 3], [1, 4], [2, 4], [1, 5], [2, 5]]


def test_sweep_adapts(spark, tmp_path):
    def noisy(a, trial, **k):
        return a * a + random.Random(a * 1000 + trial).random() * 8

    with ringweave.sweep({"a": list(range(10))}, -100, str(tmp_path / "out.csv"), spark=spark, report=None) as w:
        w.job(lambda id, trial, a: {"value": noisy(a, trial)})
    for a, row in w.report.iterrows():
        assert 0 < row.value_dev < 5 and row.trials <= 100
        assert row.trials < 10 or abs(row.value - (a * a + 4)) < 3 * row.value_err
    assert w.report.trials.iloc[0] > w.report.trials.iloc[9]
    assert (tmp_path / "out.csv").read_text().startswith("id,trials,a,value,value_dev,value_err")


def test_sweep_checks(spark):
    got = swept(spark, [{"a": 8}, {"a": 9}], 0, 8, lambda a, **k: a)
    assert got.trials.iloc[0] == 4 and got.value.tolist() == [8, 9]
    assert len(swept(spark, {"a": []})) == 0
    for bad in ([{"a": 1}, {"b": 1}], [3], "x"):
        with pytest.raises(ValueError):
            swept(spark, bad)
    for kw in ({"trials": 2, "min": 1}, {"trials": -2, "max": 1}, {"E": 0, "eps": 0}, {"min": 9, "max": 3}, {"other": 1}):
        with pytest.raises(ValueError):
            swept(spark, {"a": [1]}, **kw)
    for value in (Multiple([{"v": 1}, {"v": 2}]), {"a": 1}, 5):
        with pytest.raises(Exception, match="one dict|named as"), ringweave.sweep({"a": [1]}, 1, spark=spark, report=None) as w:
            w.job(lambda id, trial, a, value=value: value)
    assert math.isnan(swept(spark, {"a": [1]}, 0, 4, lambda **k: float("nan")).value.iloc[0])


# --- the rest


def test_command_line(spark, tmp_path):
    (tmp_path / "plan.yaml").write_text("reducer: total\njobs:\n  - addOne\n  - addOne\n")
    out = io.StringIO()
    main(["run", str(tmp_path / "plan.yaml"), "--type", "int"], out, io.StringIO("45\n\n 7 \n"))
    assert out.getvalue() == "56\n"
    (tmp_path / "in.txt").write_text("1\n\n 2\n")
    out = io.StringIO()
    main(["run", str(tmp_path / "plan.yaml"), "--type", "int", "--input", str(tmp_path / "in.txt")], out)
    assert out.getvalue() == "7\n"
    out = io.StringIO()
    main(["checkpoint", str(tmp_path / "none")], out)
    assert "no checkpoint" in out.getvalue()
    out, command = io.StringIO(), ["run", str(tmp_path / "plan.yaml"), "--type", "int", "--stats", "-c", f"file://{tmp_path}/state"]
    assert main([*command, "--stop-after", "2", "5"], out) == 0x10 and out.getvalue() == ""
    assert main([*command, "5"], out) == 0 and out.getvalue() == "7\n"
    assert main([*command, "5"], out) == 0x11 and out.getvalue() == "7\n"
    main(["checkpoint", f"file://{tmp_path}/state"], out)
    assert "finished after step" in out.getvalue() and "ring: 1 tables" in out.getvalue()
    out = io.StringIO()
    main(["progress", f"file://{tmp_path}/state"], out)
    main(["progress", f"file://{tmp_path}/other"], out)
    changed, none = map(int, out.getvalue().split())
    assert changed > 1e12 and none == -1


def test_external_programs(tmp_path):
    assert ringweave.invoke(["/bin/echo", "a"]) == ("a\n", "")
    with pytest.raises(FileNotFoundError):
        ringweave.invoke([str(tmp_path / "none")])
    (tmp_path / "plain").write_text("x")
    with pytest.raises(FileNotFoundError):
        ringweave.invoke([str(tmp_path / "plain")])
    with pytest.raises(ringweave.InvokeError, match="7"):
        ringweave.invoke(["/bin/sh", "-c", "echo oh >&2; exit 7"])
    waits = []
    script = f"if [ -f {tmp_path}/two ]; then echo fine; elif [ -f {tmp_path}/one ]; then touch {tmp_path}/two; echo busy >&2; exit 1; else touch {tmp_path}/one; echo busy >&2; exit 1; fi"
    assert ringweave.invoke(["/bin/sh", "-c", script], ["busy"], sleep=waits.append)[0] == "fine\n"
    assert waits == [1, 2]
    assert ringweave.run_with_stdin(["/bin/sh", "-c", "cat; exit 3"], "hello") == (3, "hello", "")


def test_work_goes_on_from_its_checkpoint(spark, tmp_path):
    inits, results = [], []

    def run(step=3, folder=f"{tmp_path}/state"):
        with Work([1, 2], spark=spark, checkpoint=f"file://{folder}") as w:

            @w.init
            def more():
                inits.append(1)
                return 3

            @w.job
            def seen(x):
                with open(f"{tmp_path}/seen", "a") as f:
                    f.write(f"{x}\n")
                return x

            @w.reduce(store=lambda: [0, 0], emit=lambda s: s[0])
            def total(store, works, others):
                store[0] += sum(works) + sum(o[0] for o in others)
                return 7 if others and store[0] < 20 else None

            @w.job
            def fails(x, step=step):
                if not os.path.exists(f"{tmp_path}/go"):
                    raise ValueError("not yet")
                return x * step

            @w.result
            def take(x):
                results.append(x)

    with pytest.raises(Exception, match="not yet"):
        run()
    before = open(f"{tmp_path}/seen").read()
    open(f"{tmp_path}/go", "w").close()
    with pytest.raises(Checkpoint.Mismatch):
        run(step=4)
    run()
    assert open(f"{tmp_path}/seen").read() == before and len(inits) == 1 and len(results) == 1 and results[0] >= 60 and results[0] % 21 == 18
    with pytest.raises(Checkpoint.Finished):
        run()
    assert len(results) == 1
    with pytest.raises(FileNotFoundError):
        run(folder=f"{tmp_path}/missing/state")
