"""Figures of a run: rows by name, jobs and tasks, and the executors' times as the status of their stages has them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class RunStats:
    seconds: float = 0.0
    jobs: int = 0
    tasks: int = 0
    cores: int = 0
    run_seconds: float = 0.0
    cpu_seconds: float = 0.0
    gc_seconds: float = 0.0
    records_read: int = 0
    shuffle_bytes: int = 0
    rows: dict[str, Observation] = field(default_factory=dict)

    def observe(self, df: DataFrame, name: str) -> DataFrame:
        """df, with its rows counted as they pass."""
        self.rows[name] = Observation(name)
        return df.observe(self.rows[name], F.count(F.lit(1)).alias("rows"))

    def count(self, name: str) -> int:
        return self.rows[name].get["rows"]

    @property
    def user_share(self) -> float:
        """Time that tasks ran, of the run's; 1 is one core all the time. The JVM's and the Python workers' time together."""
        return self.run_seconds / max(self.seconds, 1e-9)

    @property
    def cpu_share(self) -> float:
        """CPU time of the executors' JVM threads, of the run's; the CPU time of Python workers is not in it."""
        return self.cpu_seconds / max(self.seconds, 1e-9)

    @property
    def idle_seconds(self) -> float:
        """Time that cores had no task."""
        return max(0.0, self.seconds * self.cores - self.run_seconds)

    def __str__(self) -> str:
        return f"{self.seconds:.3f} s, {self.jobs} jobs, {self.tasks} tasks on {self.cores} cores; user {self.user_share:.0%}, JVM CPU {self.cpu_share:.0%}, idle {self.idle_seconds:.3f} s, GC {self.gc_seconds:.3f} s"


@contextmanager
def measured(spark: SparkSession) -> Iterator[RunStats]:
    context, out, began = spark.sparkContext, RunStats(), time.monotonic()
    out.cores = context.defaultParallelism
    group, outer = f"ringweave-{time.monotonic_ns()}", context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "measured run")
    try:
        yield out
    finally:
        out.seconds = time.monotonic() - began
        jsc = context._jsc.sc()
        jsc.listenerBus().waitUntilEmpty()
        tracker, store = context.statusTracker(), jsc.statusStore()
        ids = tracker.getJobIdsForGroup(group)
        out.jobs = len(ids)
        for s in {s for i in ids if (info := tracker.getJobInfo(i)) for s in info.stageIds}:
            stage = store.lastStageAttempt(s)
            out.tasks += stage.numTasks() if stage.numCompleteTasks() else 0
            out.run_seconds += stage.executorRunTime() / 1e3
            out.cpu_seconds += stage.executorCpuTime() / 1e9
            out.gc_seconds += stage.jvmGcTime() / 1e3
            out.records_read += stage.inputRecords()
            out.shuffle_bytes += stage.shuffleWriteBytes()
        context.setLocalProperty("spark.jobGroup.id", outer)


def cpu_count(spark: SparkSession) -> int:
    """Cores that run tasks at once, over the whole cluster."""
    return spark.sparkContext.defaultParallelism
