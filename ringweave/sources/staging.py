"""Tables written once to the folder that all machines share, and their removal."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    A private temporary folder is used only where the setting is missing and the master is
    local, as in tests; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="ringweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which the innermost scratch() removes."""
    path = f"{shared_dir(spark)}/ringweave-{label}-{uuid.uuid4().hex}"
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return path


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes all tables staged within it at its end; what was made from them must have been written by then.

        with scratch(spark):
            near_duplicates(docs).write.parquet(out)
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    own: list[str] = []
    scopes.append(own)
    try:
        yield own
    finally:
        scopes[:] = [s for s in scopes if s is not own]
        removed(spark, *own)
