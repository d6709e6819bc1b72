"""Session defaults and tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
FILE_ROWS, LEAST_FILES = 250_000, 8


def local_session(cpus: str = "*", partitions: int = 8, app: str = "driftline") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def modest_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes that a Python worker is sent at once, unless the session has a bound of its own: texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, size)


KEPT = "_driftline_kept"  # a module of a worker's own, for what outlives a task


def tidy_worker(keep: bool = False) -> None:
    """At the start of a Python task: memory that tasks before it have left in this worker goes back to the system, and what they
    have kept for tasks of their kind too unless keep is set. Workers are used again, and each executor's memory has to do for all its stages."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if not keep:
        sys.modules.pop(KEPT, None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy_executors(spark: SparkSession) -> None:
    """Between stages: each executor's JVM collects its garbage and gives back the heap that is then free, which it otherwise keeps at the largest
    size that any stage before has needed. As many short tasks as there are cores, so that each executor gets one where all are idle."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder; where neither is set and all runs in one process (tests), a
    temporary one that is then kept in the setting. A cluster must name one, as its executors see no other machine's files."""
    path = spark.conf.get(SHARED, None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        path = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set(SHARED, path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/driftline-{spark.sparkContext.applicationId}"


_WRITTEN: list[str] = []  # by this driver, in order


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end: for steps whose result is itself written by then."""
    before = len(_WRITTEN)
    yield
    while len(_WRITTEN) > before:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read back: its lineage ends at files that outlive executors.

    rows is at least the number of rows, where it is known: short rows then make a file for each FILE_ROWS of them
    rather than for each shuffle partition. The files stay until `discard`, since results may still be read from them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df with a hint to broadcast it if it has at most so many rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its tables have fewer files than there are: for what Python does by row with a table of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, once no result is read any more."""
    _WRITTEN.clear()
    _delete(spark, own_dir(spark))
