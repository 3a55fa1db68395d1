"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # application -> temporary folder of a session on one machine
_written: dict[str, list[str]] = defaultdict(list)
_to_run: dict[str, list[str]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on one machine (master ``local``) without the setting, a temporary one for the application.

    A cluster without the setting is refused: other machines would not see what one of them writes.
    """
    at = spark.conf.get(SETTING, None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"{SETTING} is not set; it has to name a folder that all machines of the cluster share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='schemaweave-')}"
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/schemaweave/{name}-{uuid.uuid4().hex}"
    _written[spark.sparkContext.applicationId].append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_clean(spark: SparkSession, statement: str) -> None:
    _to_run[spark.sparkContext.applicationId].append(statement)


def clean(spark: SparkSession) -> int:
    """Delete all that this application has written here, once no result that reads it is needed; the number of folders."""
    for statement in _to_run.pop(spark.sparkContext.applicationId, []):
        spark.sql(statement)
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it; Spark's names are alike in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once: ten thousand long texts, Spark's own bound, can fill its memory.

    Spark reads these settings when a plan is run, so they hold for the session from here on.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def give_back() -> None:
    """Return freed memory of this worker to the machine; workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a function over the batches of a task: what it held goes back to the machine when the task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
