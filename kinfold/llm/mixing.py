"""Mixing sources to target weights under a time-varying curriculum.

A source's weight over training time t in [0, 1] is a ramp: its target times (1 + a (2t - 1)). Its integral is the
cumulative demand D(t) for the source's words. Documents of a source stand in a fixed pseudo-random order, again and again,
and the copy of a document that begins after c words of its source gets the training position t at which D(t) reaches its
middle: D is inverted. Copies whose middle the demand never reaches are not taken. Copies are then range-sorted by position.

All of it is DataFrame code; the running sums go through buckets of the order, whose number grows with the rows, so one
source may hold any share of them. Null texts have size 0 and are taken 0 words; a null source is a source of its own, after all others; a null key
is ordered like an empty one; repeated rows are taken each on its own; an empty table gives no rows. Columns of the
documents are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, partitions, save

WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = (0.5, -0.5, 0.0)
SHARE = 1.5
MOST = 2.0


def cycled(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, ramps: Sequence[float] = RAMPS) -> DataFrame:
    """`sizes` (source, source_size) to source, source_size, weight, ramp, target.

    Targets share `share` times all sizes by weight. A target above `most` times its size stops there and its excess is
    reshared. In ascending order of size over weight the stopped sources come first, so the share of the others follows
    from running sums. The table has a row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", cycled(weights, F.col("rank"))).withColumn("ramp", cycled(ramps, F.col("rank")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    level = ranked.withColumn("level", left / F.sum("weight").over(rest))
    level = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(every)["level"])
    target = F.least(F.col("source_size") * F.lit(most), F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "weight", "ramp", F.coalesce(target, F.lit(0.0)).alias("target"))


#: Rows that a bucket of the order has about.
BUCKET_ROWS = 50_000


def demand(t: Column, target: Column, a: Column) -> Column:
    """Words of a source that are due up to training time t: the integral of its ramp."""
    return target * (t * (1 - a) + t * t * a)


def when_due(words: Column, target: Column, a: Column) -> Column:
    """The training time at which the demand reaches `words`, the inverse of demand(); null beyond the whole demand."""
    q = F.try_divide(words, target)
    t = F.try_divide(2 * q, (1 - a) + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * q, F.lit(0.0))))
    return F.when(words <= 0, F.lit(0.0)).when(words <= target, F.least(t, F.lit(1.0)))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", digits: int | None = None, keep: Sequence[str] | None = None, copies: int = 2, **how) -> DataFrame:
    """doc (struct of the columns of `keep`, all by default), source, size, source_size, target, ramp, before (words of the
    source before the row), positions (training time of each copy that is taken, in order), taken.

    The k-th copy of a row is due when the demand for its source reaches the copy's middle, so a source's taken words miss
    its target by half a document at most. `digits` hex digits of the order's hash make the buckets of a source; by default
    as many as keep a bucket near `BUCKET_ROWS` rows.
    """
    n = docs.count()
    doc = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)]).alias("doc")
    if not n:
        return docs.select(doc, *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("size", "long"), ("source_size", "long"), ("target", "double"), ("ramp", "double"), ("before", "long"), ("positions", "array<double>"), ("taken", "long"))])
    if digits is None:
        digits = max(3, math.ceil(math.log(n / BUCKET_ROWS, 16)))
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        doc, F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"), F.substring(order, 1, digits).alias("bucket"), F.xxhash64(text).alias("tie"),
    )
    sums = save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    targets = save(source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), **how), "mix-targets")
    start = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # a name of the source that is never null: running sums and the join below then share one shuffle of the documents
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    starts = sums.select(name.alias("name"), "bucket", F.coalesce(F.sum("bucket_size").over(start), F.lit(0)).alias("bucket_start"))
    starts = starts.join(targets.withColumn("name", name).drop("source"), "name")
    running = W.partitionBy("name", "bucket").orderBy("order", "key", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("name", name).withColumn("own", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = placed.join(starts, ["name", "bucket"])
    placed = placed.withColumn("before", F.col("bucket_start") + F.col("own"))
    due = lambda k: when_due(F.col("before") + F.lit(k) * F.col("source_size") + F.col("size") / 2, F.col("target"), F.col("ramp"))
    none = F.array().cast("array<double>")
    placed = placed.withColumn("positions", F.when(F.col("size") > 0, F.array_compact(F.array(*[due(k) for k in range(copies)]))).otherwise(none))
    return placed.select("doc", "source", "size", "source_size", "target", "ramp", "before", "positions", (F.col("size") * F.size("positions")).alias("taken"))


def schedule(mixed: DataFrame) -> DataFrame:
    """A row for each taken copy: the columns of `mixed` but `positions` and `taken`, copy, position in [0, 1]; sorted by
    position over all partitions."""
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions", "taken")
    return copies.repartitionByRange(partitions(mixed.sparkSession), "position").sortWithinPartitions("position")


def curriculum(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """doc (struct of the key), size, source_size, target, taken, first_position, last_position (null if not taken) of each
    row, from the schedule of all copies, which is written in training order. Texts are read where they are, not shuffled."""
    mixed = save(mix(docs, key, keep=[key], **how), "mix").withColumn("row", F.monotonically_increasing_id())
    mixed = save(mixed, "mix-rows")
    written = save(schedule(mixed.select("row", "size", "positions", "taken")), "mix-schedule")
    copies = written.groupBy("row").agg(F.sum("size").alias("scheduled"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    rows = mixed.join(copies, "row", "left")
    return rows.select("doc", "source", "before", "size", "source_size", "target", F.coalesce("scheduled", F.lit(0).cast("long")).alias("taken"), "first_position", "last_position")


#: DuckDB SQL for the rows of curriculum() over the table `documents`: each copy's position solves the integral of its
#: source's ramp for the copy's middle.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rnk - 1) % 3 + 1)::INT] AS weight, [0.5::DOUBLE, -0.5::DOUBLE, 0.0::DOUBLE][((rnk - 1) % 3 + 1)::INT] AS a FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
  / sum(weight) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT arg_min(level, source_size / weight) AS level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE),
t AS (SELECT source, source_size, a, least(source_size * 2.0::DOUBLE, m.level * weight) AS target FROM w, m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (before + size / 2) AS mid0, (before + source_size + size / 2) AS mid1 FROM p),
r AS (SELECT *, CASE WHEN size > 0 AND mid0 <= target THEN least(2 * (mid0 / target) / ((1 - a) + sqrt(greatest((1 - a) * (1 - a) + 4 * a * (mid0 / target), 0.0::DOUBLE))), 1.0::DOUBLE) END AS t0,
  CASE WHEN size > 0 AND mid1 <= target THEN least(2 * (mid1 / target) / ((1 - a) + sqrt(greatest((1 - a) * (1 - a) + 4 * a * (mid1 / target), 0.0::DOUBLE))), 1.0::DOUBLE) END AS t1 FROM q)
SELECT doc_id, size, source_size, target, (size * ((t0 IS NOT NULL)::INT + (t1 IS NOT NULL)::INT))::BIGINT AS taken, t0 AS first_position, coalesce(t1, t0) AS last_position FROM r
"""
