"""Bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles (five words; of a shorter
text all its words; none for null, empty and blank texts). Sketches of parts merge to that of the whole's shingles, and
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import words

K = 128
SHINGLE = 5
#: Cells that quantiles of the key delimit, and buckets in a cell at most.
CELLS, BUCKETS = 256, 256
BUCKET_ROWS = 2000


def shingle_hashes(text: str, size: int = SHINGLE) -> Column:
    """Hashes of a text's shingles, in order, repeats included."""

    def over(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    # a let-binding: the words' hashes are computed once
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(hashed), over))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def shared(a: Column, b: Column, k: int = K) -> Column:
    return F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact while the union has k shingles at most; 1 for two empty sketches."""
    n = F.size(merge(a, b, k))
    return F.when(n == 0, F.lit(1.0)).otherwise(shared(a, b, k) / n)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    inter = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def union_sketch(df: DataFrame, by: list[str], column: str = "sketch", k: int = K, salts: int = 16) -> DataFrame:
    """Merge the sketches of many parts for each group, in two steps so that a hot group is spread over `salts` tasks."""
    one = df.select(*by, F.explode(column).alias("h"), F.pmod(F.hash(column), F.lit(salts)).alias("salt")).distinct()
    rank = lambda *p: F.row_number().over(W.partitionBy(*p).orderBy("h"))
    part = one.withColumn("r", rank(*by, "salt")).where(F.col("r") <= k).select(*by, "h").distinct()
    whole = part.withColumn("r", rank(*by)).where(F.col("r") <= k)
    return whole.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def _cell(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def with_next(rows: DataFrame, key: str, then: list[str], take: list[str]) -> DataFrame:
    """`rows` with next_<c> for each column c of `take`, from the next row in descending order of the key (after the last
    row, the first). Null keys come last; rows of equal keys are ordered by the columns of `then`.

    Rows go to buckets of the key's range, bounded by quantiles and equal widths between them, so clustered keys make even
    buckets too; the first row of each bucket is copied to the bucket before it. The rows are shuffled once.
    """
    low = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    least, most, n = (low[0] if low[0] is not None else 0) - 1, low[1] if low[1] is not None else 0, low[2]
    k = F.coalesce(F.col(key), F.lit(least))
    cells = CELLS if n > BUCKET_ROWS * CELLS // 16 else 16
    cuts = rows.agg(F.percentile_approx(k, F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10_000)).first()[0]
    bounds = [least, *sorted({c for c in cuts or [] if c > least}), most + 1]
    inner = max(1, min(BUCKETS, n // (len(bounds) - 1) // BUCKET_ROWS))
    lows = F.array(*[F.lit(b) for b in bounds[:-1]])
    steps = F.array(*[F.lit(max(1, -(-(b - a) // inner))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    placed = rows.withColumns({"_k": k, "_cell": _cell(k, bounds[1:-1])})
    within = F.floor((F.col("_k") - F.get(lows, F.col("_cell"))) / F.get(steps, F.col("_cell")))
    placed = placed.withColumn("_bucket", F.col("_cell") * BUCKETS + within)
    # CELLS * BUCKETS rows at most, whatever the input: fit for one task and for a broadcast
    heads = placed.groupBy("_bucket").agg(F.max("_k").alias("_head"))
    up = W.orderBy("_bucket")
    every = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("_head", F.coalesce(F.lead("_bucket").over(up), F.first("_bucket").over(every)).alias("_guest_of"))
    seated = placed.join(F.broadcast(heads), F.col("_k") == F.col("_head"), "left")
    guest = F.struct(F.lit(True).alias("_guest"), F.col("_guest_of").alias("_seat"))
    seats = F.array(F.struct(F.lit(False).alias("_guest"), F.col("_bucket").alias("_seat")), F.when(F.col("_guest_of").isNotNull(), guest))
    seated = seated.select(*rows.columns, "_k", F.inline(F.array_compact(seats)))
    row = W.partitionBy("_seat").orderBy("_guest", F.col("_k").desc(), *then)
    seated = seated.withColumns({f"next_{c}": F.lead(c).over(row) for c in take})
    return seated.where(~F.col("_guest")).select(*rows.columns, *[f"next_{c}" for c in take])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint each text and the same text with its last third replaced by the start of the next document's, and
    compare the fingerprint with the edited text's and the next document's.

    Null texts are empty; equal texts have equal fingerprints; repeated rows each get a row; an empty table gives none.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("own", sketch(shingle_hashes("text"), k))
    pairs = with_next(rows, "key", ["text"], ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = pairs.select("key", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    pairs = pairs.withColumn("new", sketch(shingle_hashes("edited"), k))
    return pairs.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("new"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
    )
