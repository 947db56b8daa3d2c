"""Connected components by alternating large-star and small-star steps; every step is written to the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import forget, save


def spread(column: str, salts: int) -> Column:
    """A salt of a row: rows of one hot key go to up to `salts` tasks."""
    return F.pmod(F.xxhash64(column), F.lit(salts))


def _with_least(edges: DataFrame, salts: int) -> DataFrame:
    """`edges` with m, the smallest b of their a. A node's edges are dealt by salt, so a star's centre is split: its task
    gets a row for each salt, and the tasks of its salts get its edges."""
    salted = edges.withColumn("salt", spread("b", salts))
    least = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = least.select("a", "salt", F.min("m").over(W.partitionBy("a")).alias("m"))
    return salted.join(least, ["a", "salt"])


def _large(edges: DataFrame, salts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame, salts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the edge to the smallest stays, the others' ends move to it
    moved = _with_least(down, salts).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and no node has edges both up and down."""
    down = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = down.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)).limit(1).count() == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges` (a, b: long) to node, root: the smallest node of its component. Loops and repeats do no harm; nodes
    without an edge to another node do not appear."""
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    salts = max(1, math.isqrt(now.count()))
    for _ in range(most_rounds):
        if _settled(now):
            break
        before, now = now, save(_small(_large(now, salts), salts), "edges")
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
