"""Packing documents into fixed-length sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut; the pieces are dealt by hash into cells of bounded size, so no task ever
holds an unbounded group, and each cell is packed by several islands (tasks with seeds of their own). An island evolves
a small population: crossover injects whole well-filled bins of one parent into another, removes the bins that hold a
piece twice, and best-fits the displaced pieces; mutation dissolves poorly filled bins. After each epoch every island's
best packing migrates to the next island of its cell. The best packing over a cell's islands is kept. An island stops
early only at a packing that none can beat: as few sequences as the sizes allow, and all but one of them full. What the
cells leave over meets once more: the emptiest sequence of each cell is taken up again, together with those of other cells.

Null texts are empty (end id only); repeated rows are packed each on its own; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import save, small_batches, tidy, tidy_group
from kinfold.llm.tokens import encoder, text_runs

CAPACITY = 2048
CELL = 40_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 8
GENERATIONS = 12
#: Cells whose emptiest sequences are packed together at the end.
JOINED_CELLS = 64


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32. Of a text longer than `capacity`, the first
    piece takes what the full ones leave over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            for _, rows in text_runs(batch):
                ids, starts = enc.encode_arrow(rows.column("text"))
                out = []
                for k, a, b in zip(rows.column("key").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = np.concatenate([ids[a:b], np.array([end_id], ids.dtype)]).astype("<u4")
                    first = len(own) % capacity or capacity
                    at = 0
                    for i, end in enumerate(range(first, len(own) + 1, capacity)):
                        out.append((uid, k, i, at, end - at, zlib.crc32(own[at:end].tobytes())))
                        at, uid = end, uid + 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(cut), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Best fit in constant time: open bins by what they have left, and a bit for each such amount."""

    def __init__(self, capacity: int, left: np.ndarray):
        self.capacity, self.left = capacity, left.tolist()
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        for b, r in enumerate(self.left):
            if r > 0:
                self.by[r].append(b)
                self.bits |= 1 << r

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = self.by[r].pop()
            if not self.by[r]:
                self.bits ^= 1 << r
        else:
            b, r = len(self.left), self.capacity
            self.left.append(r)
        r -= size
        self.left[b] = r
        if r:
            self.by[r].append(b)
            self.bits |= 1 << r
        return b


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray | None = None) -> np.ndarray:
    """Put the items of `order` into the bins of `bins` (-1: not yet placed), and new ones."""
    if bins is None:
        bins = np.full(len(sizes), -1, np.int64)
    held = bins >= 0
    load = np.bincount(bins[held], sizes[held], minlength=int(bins.max(initial=-1)) + 1).astype(np.int64)
    put = Bins(capacity, capacity - load).put
    bins[order] = [put(s) for s in sizes[order].tolist()]
    return compact(bins)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    load = np.bincount(bins, sizes)
    return -len(load), float(np.mean((load / capacity) ** 2)) if len(load) else 0.0


def unbeatable(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> bool:
    """Whether all bins but one are full, so that no packing has fewer or fuller ones."""
    return int((np.bincount(bins, sizes) < capacity).sum()) <= 1


def falling(sizes: np.ndarray, items: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    return items[np.argsort(-(sizes[items] * (1 + noise * rng.random(len(items)))), kind="stable")]


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of `a` with whole well-filled bins of `b`."""
    load_b = np.bincount(b, sizes)
    full = load_b >= np.quantile(load_b, 0.5)
    chosen = full & (rng.random(len(load_b)) < rng.uniform(0.2, 0.8))
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True  # bins of a that hold an injected item go
    child = np.where(injected, b + len(hit), np.where(hit[a], -1, a))
    loose = np.flatnonzero(child < 0)
    child[child >= 0] = compact(child[child >= 0])
    return best_fit(sizes, falling(sizes, loose, rng, 0.05), capacity, child)


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the least filled bins and some random ones, and best-fit their items."""
    load = np.bincount(a, sizes)
    gone = (load <= np.quantile(load, 0.02)) & (load < capacity) | (rng.random(len(load)) < 0.02)
    child = np.where(gone[a], -1, a)
    loose = np.flatnonzero(child < 0)
    child[child >= 0] = compact(child[child >= 0])
    return best_fit(sizes, falling(sizes, loose, rng, 0.0), capacity, child)


def evolve(sizes: np.ndarray, capacity: int, seed: int, start: list[np.ndarray], population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The best packing that an island finds from the packings in `start` and its own."""
    rng = np.random.default_rng(seed)
    every = np.arange(len(sizes))
    scored = lambda x: (fitness(sizes, x, capacity), x)
    first = lambda x: x[0]
    pool = [scored(x) for x in start]
    while len(pool) < population:
        pool.append(scored(best_fit(sizes, falling(sizes, every, rng, 0.0 if not pool else rng.uniform(0.02, 0.3)), capacity)))
    pool.sort(key=first, reverse=True)
    for _ in range(generations):
        if unbeatable(sizes, pool[0][1], capacity):
            break
        i, j = rng.permutation(len(pool))[:2]
        for child in (crossover(sizes, pool[i][1], pool[j][1], capacity, rng), mutate(sizes, pool[0][1], capacity, rng)):
            if (new := scored(child))[0] > pool[-1][0]:
                pool[-1] = new
                pool.sort(key=first, reverse=True)
    return pool[0][1]


def islander(capacity: int, epoch: int):
    """What one island does in one epoch with the pieces of its cell. `loose`: the piece is in the emptiest sequence."""

    def island(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], ignore_index=True)
        sizes = g["length"].to_numpy(np.int64)
        start = [compact(g[c].to_numpy()) for c in ("own", "guest") if g[c].iloc[0] >= 0]
        best = evolve(sizes, capacity, (int(g["cell"].iloc[0]) * 1009 + int(g["island"].iloc[0])) * 31 + epoch, start)
        g["own"], g["guest"] = best, -1
        g["bins"], g["fill"] = -fitness(sizes, best, capacity)[0], fitness(sizes, best, capacity)[1]
        g["loose"] = best == np.bincount(best, sizes).argmin()
        order = np.argsort(best, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.flatnonzero(np.diff(best[order], prepend=-1))
        offset = np.empty(len(g), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(first, append=len(g)))
        g["offset"] = offset
        return g

    return island


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """`items` (uid, doc_id, piece, length up to `capacity`) to uid, sequence_id, offset. Read more than once: pass a saved table."""
    n_cells = max(1, -(-items.count() // cell))
    if islands < 2:
        epochs = 1
    placed = items.select(
        F.pmod(F.xxhash64("doc_id", "piece", "uid"), F.lit(n_cells)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "uid", "doc_id", "piece", "length", F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("guest"),
    )
    schema = "cell int, island int, uid long, doc_id long, piece int, length long, own long, guest long, bins long, fill double, loose boolean, offset long"
    for epoch in range(epochs):
        placed = save(placed.groupBy("cell", "island").applyInPandas(tidy_group(islander(capacity, epoch)), schema), f"islands-{epoch}")
        if epoch + 1 < epochs:
            elite = placed.select("cell", ((F.col("island") + 1) % islands).alias("island"), "uid", F.col("own").alias("guest"))
            placed = placed.drop("guest", "bins", "fill", "loose", "offset").join(elite, ["cell", "island", "uid"])
            placed = placed.select("cell", "island", "uid", "doc_id", "piece", "length", "own", "guest")
    won = placed.groupBy("cell").agg(F.min(F.struct("bins", (-F.col("fill")).alias("fill"), "island")).alias("w")).select("cell", F.col("w.island").alias("island"))
    won = placed.join(won, ["cell", "island"], "left_semi")
    named = lambda t: t.select("uid", ((F.col("cell").cast("long") * (1 << 32)) + F.col("own")).alias("sequence_id"), "offset")
    if n_cells == 1:
        return named(won)
    # the packing that the cells bring is among those to start from, so there are never more sequences than before
    brought = won.where("loose").select((F.lit(n_cells) + F.floor(F.col("cell") / JOINED_CELLS)).cast("int").alias("cell"), F.lit(0).alias("island"), "uid", "doc_id", "piece", "length", (F.col("cell").cast("long")).alias("own"), F.lit(-1).cast("long").alias("guest"))
    joined = brought.groupBy("cell", "island").applyInPandas(tidy_group(islander(capacity, epochs)), schema)
    return named(won.where("NOT loose")).unionByName(named(joined))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end_id: int = 0, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    with small_batches(docs.sparkSession):
        cut = save(pieces(docs, tokenizer, capacity, key, text, end_id), "pieces")
    return cut.join(pack(cut, capacity, **how), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
