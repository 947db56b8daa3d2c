"""Shared plumbing of the training-data operators: shared folders, saved stages, file access from tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and its complement as a pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, else the checkpoint folder set on
    the context, else (local runs and tests only) a fresh temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*saved: DataFrame) -> None:
    """Remove the files of frames that save() gave, when all that was made of them has been saved too."""
    for df in saved:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system (local, hdfs, s3, gs) and path for a URI; usable in any task."""
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4_000_000) -> Iterator[None]:
    """What is run inside hands rows to Python in batches of `most` bytes or one row (Spark's own limits are 64 MB and 10,000
    rows), which the JVM and the worker each hold more than once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that this worker no longer uses back to the system, for the tasks and the JVM beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(f: Callable) -> Callable:
    """`f` over batches, releasing memory when a task has ended."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


def tidy_group(f: Callable) -> Callable:
    """`f` over one group, releasing memory after it."""

    def run(group):
        out = f(group)
        release()
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str = "text"):
    """Column: the array of words of a text; empty for null, empty or blank texts."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")
