"""Approximate nearest neighbours by cosine: a forest of random-projection trees searched through one priority queue.

The trees are fitted on the driver on a bounded sample of the different vectors (`SAMPLE_OF_LEAF` for each leaf, at most
`MOST_LEAVES` leaves a tree); every vector is indexed in every tree. A query goes down the branches of all trees by
their margins through one shared queue until the leaves it has seen hold `share` of all vectors (by their counts, trees
taken as independent); all vectors in these leaves are reranked exactly, in double precision.

Vectors of one direction have the same cosines: they are indexed once, by the one of the smallest id and with the smallest
of their ids, so copies and multiples cost nothing and cannot crowd a leaf. Index and queries meet block by block in one
shuffle; a block's vectors are held, its queries stream past them. Scores that agree to ten digits count as equal where
candidates are cut, and to twelve in the ranks, so that ties go to the smaller id whatever the rounding. Vectors zero, of another length than most, or hold null or non-finite components take no part; null ids neither.
Rows repeated in full count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import save

TREES = 8
SHARE = 0.7
LEAF_ROWS = 64
MOST_LEAVES = 4096
SAMPLE_OF_LEAF = 20
BLOCK_ROWS = 40_000
#: Blocks of a small index. More would only bring each query's nearest more often: its rows grow with the blocks.
LEAST_BLOCKS = 16
#: Rows of a block that are compared with a run of queries at a time.
STRIPE = 1000
SEED = 7


class Forest:
    """Trees as arrays: `normal[node]`, `cut[node]`, `kids[node]` (left, right; a leaf has -1 - leaf in both)."""

    def __init__(self, sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal, cut, kids, self.roots, self.n_leaves = [], [], [], [], 0
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))

        def grow(rows: np.ndarray, left: int) -> int:
            k = len(normal)
            normal.append(np.zeros(sample.shape[1], np.float32)), cut.append(0.0), kids.append((0, 0))
            for _ in range(3 if left and len(rows) > 1 else 0):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                w = a - b
                if not np.linalg.norm(w):
                    continue
                w = (w / np.linalg.norm(w)).astype(np.float32)
                p = sample[rows] @ w
                t = float(np.median(p))
                if (p <= t).all():
                    continue
                normal[k], cut[k] = w, t
                kids[k] = (grow(rows[p <= t], left - 1), grow(rows[p > t], left - 1))
                return k
            kids[k] = (-1 - self.n_leaves,) * 2
            self.n_leaves += 1
            return k

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample)), depth))
        self.normal, self.cut, self.kids = np.array(normal, np.float32).reshape(len(normal), -1), np.array(cut, np.float32), np.array(kids, np.int64)
        self.tree_of = np.zeros(self.n_leaves, np.int64)
        for t, root in enumerate(self.roots):
            stack = [root]
            while stack:
                a, b = self.kids[stack.pop()]
                if a < 0:
                    self.tree_of[-1 - a] = t
                else:
                    stack += [int(a), int(b)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (on := self.kids[node, 0] >= 0).any():
                at = np.flatnonzero(on)
                n = node[at]
                right = (np.einsum("ij,ij->i", x[at], self.normal[n]) > self.cut[n]).astype(np.int64)
                node[at] = self.kids[n, right]
            out[:, t] = -1 - self.kids[node, 0]
        return out

    def search(self, v: np.ndarray, counts: np.ndarray, share: float, least: int) -> list[int]:
        """Leaves in the order of their margins until enough vectors are seen."""
        margin = (self.normal @ v - self.cut).tolist()
        kids, total = self.kids, counts.sum() / len(self.roots)
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        seen, found, n = np.zeros(len(self.roots)), [], 0
        while queue:
            far, node = heapq.heappop(queue)
            while kids[node, 0] >= 0:
                m = margin[node]
                near, other = (kids[node, 1], kids[node, 0]) if m > 0 else (kids[node, 0], kids[node, 1])
                heapq.heappush(queue, (max(far, abs(m)), int(other)))
                node = int(near)
            leaf = int(-1 - kids[node, 0])
            found.append(leaf)
            seen[self.tree_of[leaf]] += counts[leaf]
            n += counts[leaf]
            if n >= least * len(self.roots) and 1 - np.prod(1 - seen / max(total, 1)) >= share:
                break
        return found


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; all of one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def direction(v: Column) -> Column:
    """Equal for vectors of equal direction: the components by the largest one's size, to twelve digits."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.transform(v, lambda x: F.round(x / most, 12) + F.lit(0.0))


def different(rows: DataFrame, keep: int) -> DataFrame:
    """vid, ids (the `keep` smallest), vec (that of vid) of each direction."""
    # the rank filter also runs before the shuffle, so a direction shared by very many rows sends few
    of = rows.withColumn("way", direction(F.col("vec")))
    ranked = of.withColumn("r", F.dense_rank().over(W.partitionBy("way").orderBy("id"))).where(F.col("r") <= keep)
    return ranked.groupBy("way").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min(F.struct("id", "vec"))["vec"].alias("vec")).select(F.col("ids")[0].alias("vid"), "ids", "vec")


def nearest(q: np.ndarray, r: np.ndarray, vid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in r, cosines) of the `most` nearest rows of each query, ties to the smaller vid."""
    by_id = np.argsort(vid, kind="stable")
    qn, rn = np.linalg.norm(q, axis=1), np.linalg.norm(r, axis=1)
    places, scores = [], []
    for a in range(0, len(by_id), STRIPE):
        at = by_id[a : a + STRIPE]
        s = (q @ r[at].T) / qn[:, None] / rn[at]
        cut = np.round(s, 10) - np.arange(len(at)) * 1e-14  # STRIPE * 1e-14 is less than a step of the rounding
        top = np.argpartition(-cut, min(most, len(at)) - 1, axis=1)[:, :most]
        places.append(at[top]), scores.append(np.take_along_axis(s, top, 1))
    place, score = np.concatenate(places, axis=1), np.concatenate(scores, axis=1)
    if place.shape[1] > most:
        order = np.lexsort((vid[place], -np.round(score, 10)), axis=1)[:, :most]
        place, score = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
    return place, score


class Block:
    """The index rows of a block, by leaf."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks()
        self.vec, self.vid, self.ids = matrix(held.column("vec").combine_chunks()), held.column("vid").to_numpy(), held.column("ids")
        leaf = held.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        names, first = np.unique(leaf[order], return_index=True)
        self.members = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True)) if len(names) else {}

    def search(self, query_id: np.ndarray, q: np.ndarray, leaves: list[list[int]], most: int) -> pa.RecordBatch:
        """The `most` nearest of each query in the leaves that it asks for."""
        by_leaf: dict[int, list[int]] = {}
        for i, wanted in enumerate(leaves):
            for x in wanted:
                by_leaf.setdefault(x, []).append(i)
        who, place, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, asks in by_leaf.items():
            if (at := self.members.get(x)) is not None:
                w = np.array(asks)
                near, s = nearest(q[w], self.vec[at], self.vid[at], most)
                who.append(np.repeat(w, near.shape[1])), place.append(at[near].ravel()), score.append(s.ravel())
        who, place, score = np.concatenate(who), np.concatenate(place), np.concatenate(score)
        order = np.lexsort((self.vid[place], -np.round(score, 10), who))
        who, place = who[order], place[order]
        # a vector is in several trees: once for each query
        _, once = np.unique(who * (len(self.vid) + 1) + np.unique(self.vid, return_inverse=True)[1][place], return_index=True)
        once.sort()
        who, place = who[once], place[once]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
        who, place = who[rank < most], place[rank < most]
        exact = (self.vec[place] * q[who]).sum(axis=1) / (np.linalg.norm(self.vec[place], axis=1) * np.linalg.norm(q[who], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(query_id[who]), pa.array(self.vid[place]), self.ids.take(pa.array(place)).combine_chunks(), pa.array(exact)], ["query_id", "vid", "ids", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `is_query` (on the key) holds, its `k` nearest found."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("asks")).where(F.col("id").isNotNull() & valid(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == lengths["d"])
    base = save(different(rows.select("id", "vec"), k + 1), "vectors")
    n = base.count()
    leaves = min(MOST_LEAVES, max(1, n // LEAF_ROWS))
    # SAMPLE_OF_LEAF * MOST_LEAVES rows at most
    sample = base.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE_OF_LEAF * leaves).select("vec").toArrow()
    forest = Forest(unit(matrix(sample.column(0).combine_chunks())), leaves, trees)
    shared = spark.sparkContext.broadcast(forest)
    n_blocks = max(1, min(forest.n_leaves, max(LEAST_BLOCKS, n * trees // BLOCK_ROWS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(shared.value.n_leaves, np.int64)
        for b in batches:
            c += np.bincount(shared.value.leaves(unit(matrix(b.column("vec")))).ravel(), minlength=len(c))
        yield pa.RecordBatch.from_pydict({"leaf": np.arange(len(c)), "n": c})

    # a row for each leaf: trees * MOST_LEAVES at most
    counted = base.select("vec").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(forest.n_leaves, np.int64)
    for r in counted:
        counts[r["leaf"]] = r["n"]
    queries = save(rows.where("asks").select("id", "vec").distinct(), "queries")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(unit(matrix(b.column("vec"))))
            owner = pa.array(np.repeat(np.arange(len(leaf)), leaf.shape[1]))
            leaf = leaf.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(leaf % n_blocks), pa.array(leaf), *[b.column(c).take(owner) for c in ("vid", "ids", "vec")]], ["block", "leaf", "vid", "ids", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            blocks, owners, lists = [], [], []
            for i, v in enumerate(unit(matrix(b.column("vec")))):
                found = np.array(f.search(v, counts, share, 10 * k))
                found = found[np.argsort(found % n_blocks, kind="stable")]
                cut = np.flatnonzero(np.diff(found % n_blocks)) + 1
                for part in np.split(found, cut):
                    blocks.append(part[0] % n_blocks), owners.append(i), lists.append(part)
            take = pa.array(np.array(owners, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), b.column("id").take(take), b.column("vec").take(take), pa.array(lists, pa.list_(pa.int64()))], ["block", "vid", "vec", "leaves"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for b in batches:
            blocks, asks = b.column("block").to_numpy(), b.column("leaf").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(blocks * 2 + asks)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if e == a:
                    continue
                if blocks[a] != block:
                    block, held, ready = blocks[a], [], None
                if not asks[a]:
                    held.append(b.slice(a, e - a))
                    continue
                if ready is None:
                    ready, held = Block(held) if held else False, []
                if ready:
                    part = b.slice(a, e - a)
                    yield ready.search(part.column("vid").to_numpy(), matrix(part.column("vec")), part.column("leaves").to_pylist(), k + 4)

    columns = ["block", "leaf", "vid", "ids", "vec", "leaves"]
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    indexed = base.mapInArrow(index, "block long, leaf long, vid long, ids array<long>, vec array<double>").withColumn("leaves", none("array<long>", "leaves")).select(columns)
    asked = queries.mapInArrow(ask, "block long, vid long, vec array<double>, leaves array<long>").withColumns({"leaf": none("long", "leaf"), "ids": none("array<long>", "ids")}).select(columns)
    # a block's index rows come before its queries
    met = indexed.unionByName(asked).repartition(n_blocks, "block").sortWithinPartitions("block", F.col("leaf").isNull(), "vid")
    near = met.mapInArrow(rerank, "query_id long, vid long, ids array<long>, score double")
    near = near.groupBy("query_id", "vid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    near = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
