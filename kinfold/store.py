"""Parquet snapshots: saved stages, merges without a table format, versioned tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors and driver share: spark.checkpoint.dir, else the context's checkpoint folder, else (local
    runs only) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it does not have, one for each key. Keys with a null never collide."""
    complete = F.lit(True)
    for k in key:
        complete = complete & F.col(k).isNotNull()
    keyed = new.where(complete).dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(keyed.select(*old.columns)).unionByName(new.where(~complete).select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of `new` replace those of `old` with an equal key (nulls equal); the columns of `keep` stay as in `old`."""
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.dropDuplicates(list(key)).withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, same, "full_outer")

    def pick(c: str):
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def delete_keys(old: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), list(key), "left_anti")


def replace_range(old: DataFrame, new: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """`old` without the rows with low <= column < high, and those of `new` in that range."""
    inside = (F.col(column) >= low) & (F.col(column) < high)
    return old.where(~inside).unionByName(new.where(inside).select(*old.columns))


def newest(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key: the first in `order`."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_r", first).where("_r = 1").drop("_r")


class Store:
    """Tables under a folder, each as numbered snapshots; readers get the latest complete one. A snapshot is never
    written over, so a table can be rebuilt from itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def versions(self, name: str) -> list[int]:
        path, fs, jvm = self._path(name)
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        version = max(self.versions(name), default=0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={self.versions(name)[-1]}")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest `keep` snapshots of every table, but of those whose versions count or log batches."""
        path, fs, jvm = self._path("")
        for table in [s.getPath().getName() for s in fs.listStatus(path)]:
            for v in self.versions(table)[:-keep] if table not in ("watermark", "cursors", "resolution_log") else ():
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/v={v}"), True)

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))
