"""N-gram Jaccard join by signature trees.

A document's set is its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence as one; none: the
empty set, linked with nothing). Two documents link if 100 * intersection >= 80 * union.

1. Documents of equal sets are one class; only classes are joined.
2. Routing. In any common order of shingles, linked sets of size n share one of their first n - ceil(0.8 n) + 1 shingles
   (their keys). The order puts rare shingles first: a bounded summary of frequent ones, counted over all documents, comes
   last. Classes that share a key form a group; equal groups are kept once; a group too large for a task is not looked
   into but joined up as a whole.
3. Signature trees over each group's bitmaps. A node holds the OR of its classes' shingle bitmaps and the range of their
   sizes. Dual traversal drops node pairs whose largest possible overlap is under what their sizes need; what is left
   joins classes to blocks. No link can be lost, as bounds and keys are exact.
4. The same trees over the blocks' full sets, ending in exact intersections. Pairs already connected are skipped, so a
   group of many near copies costs about its length. Blocks too large for a task are split: parts first, then one class
   of each component found, and last every class outside the largest component against all classes of the block.

Null texts have no words. Repeated rows and ties are in one class. Null ids keep a row, and get their class's smallest id
that is not null, else null. An empty table gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import forget, save, tidy, tidy_group
from kinfold.llm.components import components, spread
from kinfold.llm.tokens import text_runs

SHINGLE = 5
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Frequent shingles kept, and kept of each batch of documents.
FREQUENT, FREQUENT_OF_BATCH = 65_536, 8_192
#: Classes of a group or block that one task compares.
MOST = 1_500
LEAF = 8
#: Keys that one bucket of the routing step gets.
BUCKET_KEYS = 1_000_000
#: Bytes of text that a task turns into sets at a time.
RUN = 6_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def needed(n: int) -> int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-4 * n // 5)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's set."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts).cast(pa.large_string()), ""))
    coded = split.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    index = coded.indices.to_numpy()
    blank = np.flatnonzero(names == "") if len(names) else []
    real = index != blank[0] if len(blank) else np.ones(len(index), bool)
    ends = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
    w = hashes[index[real]]
    rolled = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        rolled += w[j : j + len(rolled)] * MULTIPLIERS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((w[a:b] * MULTIPLIERS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def width_for(n: int) -> int:
    return max(64, 1 << max(0, n - 1).bit_length())


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """Bits (as 64-bit words) at the hashes modulo the width, a power of two."""
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(m: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of a smaller width: halves are ORed together."""
    while m.shape[1] > words:
        half = m.shape[1] // 2
        m = m[:, :half] | m[:, half:]
    return m


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


class Tree:
    """Levels of nodes from single sets up; a node has `LEAF` or two children next to each other below."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles that share a bit with another
        self.levels = [(bits, sizes, sizes, spare)]
        self.fan = []
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp = self.levels[-1]
            fan = LEAF if len(self.levels) == 1 else 2
            at = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at)))
            self.fan.append(fan)

    def at(self, level: int) -> tuple:
        return self.levels[min(level, len(self.levels) - 1)]


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below the nodes i of level a and j of level b can link at all."""
    keep = np.ones(len(i), bool)
    for at in range(0, len(i), 200_000):
        p, q = i[at : at + 200_000], j[at : at + 200_000]
        sized = 5 * np.minimum(a[2][p], b[2][q]) >= 4 * np.maximum(a[1][p], b[1][q])
        most = np.zeros(len(p), np.int64)
        p2, q2 = p[sized], q[sized]
        most[sized] = np.bitwise_count(a[0][p2] & b[0][q2]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][p2], b[3][q2])
        keep[at : at + 200_000] = sized & (9 * most >= 4 * (a[1][p] + b[1][q]))
    return keep


def children(i: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(children of the nodes i, which of i each belongs to)."""
    kids = (i[:, None] * fan + np.arange(fan)).ravel()
    owner = np.repeat(np.arange(len(i)), fan)
    return kids[kids < n], owner[kids < n]


def candidate_pairs(x: Tree, y: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the dual traversal of two trees (or of one with itself) cannot drop."""
    own = y is None
    y = x if own else y
    level = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        keep = possible(x.at(level), y.at(level), i, j)
        i, j = i[keep], j[keep]
        if level == 0:
            break
        level -= 1
        for tree, first in ((x, True), (y, False)):
            if level < len(tree.fan):
                kids, owner = children(i if first else j, tree.fan[level], len(tree.levels[level][0]))
                i, j = (kids, j[owner]) if first else (i[owner], kids)
        if own:
            i, j = i[i <= j], j[i <= j]
    return (i[i < j], j[i < j]) if own else (i, j)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def connect(i: np.ndarray, j: np.ndarray, union: Union, test: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links found among the pairs, those between sets already connected left out."""
    found, at, step = [], 0, 256
    order = np.argsort(j - i, kind="stable")
    i, j = i[order], j[order]
    while at < len(i):
        roots = union.roots()
        open_ = roots[i[at:]] != roots[j[at:]]
        i, j, at = i[at:][open_], j[at:][open_], 0
        for p, q in zip(i[:step].tolist(), j[:step].tolist(), strict=True):
            if union.find(p) != union.find(q) and test(p, q):
                union.join(p, q)
                found.append((p, q))
        at, step = min(step, len(i)), step * 2
    return found


def join_sets(sets: list[np.ndarray], other: list[np.ndarray] | None = None, labels: np.ndarray | None = None, other_labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets (or the sets with the others) as all links between them do; places in the lists, those
    of `other` after those of `sets`. Sets of equal labels count as connected."""
    both = [*sets, *(other or [])]
    if len(both) < 2:
        return []
    n = np.array([len(s) for s in both], np.int64)
    width = width_for(int(min(n.max(), 1 << 16)))
    bits = np.stack([bitmap(s, width) for s in both])
    first = np.array([s[0] if len(s) else 0 for s in both], np.uint64)
    union = Union(len(both))
    if labels is not None:
        seen: dict = {}
        for k, v in enumerate([*labels.tolist(), *(other_labels.tolist() if other_labels is not None else [])]):
            union.join(k, seen.setdefault(v, k))
    rank = lambda ids: ids[np.lexsort((n[ids], first[ids], (np.log(np.maximum(n[ids], 1)) / np.log(1.25)).astype(int)))]
    test = lambda p, q: linked(both[p], both[q])
    p = rank(np.arange(len(sets)))
    if other is None:
        i, j = candidate_pairs(Tree(bits[p], n[p]))
        return connect(p[i], p[j], union, test)
    q = rank(np.arange(len(sets), len(both)))
    i, j = candidate_pairs(Tree(bits[p], n[p]), Tree(bits[q], n[q]))
    return connect(p[i], q[j], union, test)


# ---- steps -----------------------------------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def frequent(docs: DataFrame) -> dict[int, int]:
    """Shingles held by many documents with a lower bound of their number: of each batch the most frequent, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in text_runs(batch, most=RUN):
                h, c = np.unique(np.concatenate(shingle_sets(rows.column("text"))), return_counts=True)
                h, c = h[c > 1], c[c > 1]
                if len(h) > FREQUENT_OF_BATCH:
                    top = np.argpartition(-c, FREQUENT_OF_BATCH)[:FREQUENT_OF_BATCH]
                    h, c = h[top], c[top]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(c.astype(np.int64))], ["h", "n"])

    found = docs.select("text").mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    return {r["h"]: r["n"] for r in found.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()}


def features(docs: DataFrame, often: dict[int, int]) -> DataFrame:
    """doc_id, n, cls (of the set; null if empty), bits, keys for each row."""
    h = np.array(list(often), np.int64).view(np.uint64)
    by_hash = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[by_hash], np.array(list(often.values()), np.int64)[by_hash]))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            for _, rows in text_runs(batch, most=RUN):
                n, cls, bits, keys = [], [], [], []
                for s in shingle_sets(rows.column("text")):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), bits.append(None), keys.append(None)
                        continue
                    cls.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))
                    bits.append(bitmap(s, width_for(len(s))).tobytes())
                    most = len(s) - needed(len(s)) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        common = known[at] == s
                        if common.any():
                            late = s[common][np.lexsort((s[common], count[at[common]]))]
                            s = np.concatenate([s[~common][:most], late])
                    keys.append(s[:most].tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n", "cls", "bits", "keys"])

    return docs.mapInArrow(tidy(own), "doc_id long, n long, cls long, bits binary, keys binary")


def groups(rows: DataFrame, often: dict[int, int], most: int = MOST) -> DataFrame:
    """gid, members (classes) of groups, and a, b of edges between classes and keys of groups too large."""
    total = rows.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    n_buckets = max(1, int(total // BUCKET_KEYS) + 1)
    if n_buckets > 1:
        n_buckets = max(n_buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([h for h, n in often.items() if n > most // 4], np.int64).view(np.uint64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = large.value
        for batch in batches:
            raw = [(c, np.frombuffer(k, np.uint64)) for c, k in zip(batch.column("cls").to_pylist(), batch.column("keys").to_pylist(), strict=True) if k]
            raw = list({c: (c, k) for c, k in raw}.values())
            if not raw:
                continue
            key = np.concatenate([k for _, k in raw])
            cls = np.repeat(np.array([c for c, _ in raw], np.int64), [len(k) for _, k in raw])
            if len(hot):
                rare = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] != key
                key, cls = key[rare], cls[rare]
            if not len(key):
                continue
            bucket = (mix(key) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-2))
            pairs = np.stack([key[order], cls[order].view(np.uint64)], axis=1)
            ends = [*cut[1:].tolist(), len(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut]), pa.array([pairs[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary())], ["bucket", "pairs"])

    def split(table: pa.Table) -> pa.Table:
        key, cls = _unique_pairs(table)
        at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        ends = np.append(at[1:], len(key))
        out: dict[int, np.ndarray] = {}
        a, b = [], []
        for s, e in zip(at[ends - at > 1].tolist(), ends[ends - at > 1].tolist(), strict=True):
            if e - s > most:
                a.append(cls[s:e].view(np.int64)), b.append(np.full(e - s, cls[s].view(np.int64)))
                continue
            members = cls[s:e].view(np.int64)
            out.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()) >> 1, members)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        n = len(out)
        return pa.table({
            "gid": pa.concat_arrays([pa.array(list(out), pa.int64()), pa.nulls(len(a), pa.int64())]), "members": pa.concat_arrays([pa.array(list(out.values()), pa.list_(pa.int64())), pa.nulls(len(a), pa.list_(pa.int64()))]),
            "a": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a)]), "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(b)]),
        })

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges between classes and their keys that are frequent."""
        hot = large.value
        for batch in batches if len(hot) else ():
            cls, keys = batch.column("cls"), pc.fill_null(batch.column("keys"), b"")
            key = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)
            owner = np.repeat(np.arange(len(batch)), pc.binary_length(keys).to_numpy(zero_copy_only=False) // 8)
            at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), cls.take(pa.array(owner[at])), pa.array(_signed(key[at]))], ["gid", "members", "a", "b"])

    schema = "gid long, members array<long>, a long, b long"
    some = rows.where("cls IS NOT NULL").select("cls", "keys")
    small = some.mapInArrow(tidy(deal), "bucket long, pairs binary").groupBy("bucket").applyInArrow(tidy_group(split), schema)
    return small.unionByName(some.mapInArrow(tidy(stars), schema))  # no task has two Python workers


def _unique_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and classes, sorted by both, each pair once."""
    pairs = np.concatenate([np.frombuffer(p.as_py(), np.uint64).reshape(-1, 2) for p in table.column("pairs")])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[new, 0], pairs[new, 1]


def narrow(members: DataFrame) -> DataFrame:
    """`members` (block, gid, cls, n, bits) to edges a, b between classes of a group that may link, by their bitmaps."""

    def block(table: pa.Table) -> pa.Table:
        gid, cls, n = (table.column(c).to_numpy() for c in ("gid", "cls", "n"))
        order = np.lexsort((n, gid))
        gid, cls, n = gid[order], cls[order], n[order]
        raw = table.column("bits").combine_chunks()
        width = np.array([width_for(int(x)) for x in n], np.int64)
        maps: dict[int, np.ndarray] = {}
        row = np.zeros(len(n), np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            row[at] = np.arange(len(at))
            maps[w] = np.frombuffer(b"".join(raw.take(pa.array(order[at])).to_pylist()), np.uint64).reshape(len(at), w // 64)
        starts = np.flatnonzero(np.diff(gid, prepend=~gid[:1]))
        lengths = np.diff(np.append(starts, len(gid)))
        p, q = [], []
        for size in range(2, LEAF + 1):  # a small group is a single leaf
            at = starts[lengths == size]
            i, j = np.triu_indices(size, 1)
            p.append((at[:, None] + i).ravel()), q.append((at[:, None] + j).ravel())
        for s, length in zip(starts[lengths > LEAF].tolist(), lengths[lengths > LEAF].tolist(), strict=True):
            words = int(width[s : s + length].min()) // 64
            bits = np.concatenate([fold(maps[int(width[k])][row[k] : row[k] + 1], words) for k in range(s, s + length)])
            i, j = candidate_pairs(Tree(bits, n[s : s + length]))
            p.append(i + s), q.append(j + s)
        p, q = np.concatenate([np.zeros(0, np.int64), *p]), np.concatenate([np.zeros(0, np.int64), *q])
        keep = np.zeros(len(p), bool)
        for wp, wq in {(int(a), int(b)) for a, b in np.unique(np.stack([width[p], width[q]], 1), axis=0)}:
            at = np.flatnonzero((width[p] == wp) & (width[q] == wq))
            words = min(wp, wq) // 64
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                a, b = fold(maps[wp][row[p[part]]], words), fold(maps[wq][row[q[part]]], words)
                spare = np.minimum(n[p[part]] - np.bitwise_count(a).sum(1, dtype=np.int64), n[q[part]] - np.bitwise_count(b).sum(1, dtype=np.int64))
                most = np.bitwise_count(a & b).sum(1, dtype=np.int64) + spare
                small, big = np.minimum(n[p[part]], n[q[part]]), np.maximum(n[p[part]], n[q[part]])
                keep[part] = (5 * small >= 4 * big) & (9 * most >= 4 * (small + big))
        names, place = np.unique(cls, return_inverse=True)
        return _stars(names, zip(place[p[keep]].tolist(), place[q[keep]].tolist(), strict=True))

    return members.groupBy("block").applyInArrow(tidy_group(block), "a long, b long")


def _sets_of(docs: DataFrame) -> DataFrame:
    """cls, block, s (set as bytes) of rows (text, cls, block) whose text has that class."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in text_runs(batch, most=RUN):
                sets = [s.tobytes() for s in shingle_sets(rows.column("text"))]
                cls = pa.array([int(np.uint64(xxhash.xxh3_64_intdigest(s)).view(np.int64)) for s in sets], pa.int64())
                out = pa.RecordBatch.from_arrays([rows.column("cls"), rows.column("block"), pa.array(sets, pa.binary())], ["cls", "block", "s"])
                yield out.filter(pc.equal(cls, rows.column("cls")))

    return docs.select("text", "cls", "block").mapInArrow(tidy(own), "cls long, block long, s binary")


def _stars(cls: np.ndarray, found: Iterable[tuple[int, int]]) -> pa.Table:
    """An edge from each class that the links connect to the smallest one that it is connected with."""
    union = Union(len(cls))
    for i, j in found:
        union.join(i, j)
    roots = union.roots()
    least = cls.copy()
    np.minimum.at(least, roots, cls)
    moved = np.flatnonzero(least[roots] != cls)
    return pa.table({"a": cls[moved], "b": least[roots[moved]]})


def _load(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return table.column("cls").to_numpy(), [np.frombuffer(s.as_py(), np.uint64) for s in table.column("s")]


def _within(table: pa.Table) -> pa.Table:
    """From each class that links to others in its block, an edge to the smallest class that links reach there."""
    out = []
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        cls, sets = _load(table.take(pa.array(at)))
        out.append(_stars(cls, join_sets(sets)))
    return pa.concat_tables(out)


def _across(table: pa.Table) -> pa.Table:
    """Links between the rows that are loose and the others of different labels."""
    cls, sets = _load(table)
    label, loose = table.column("label").to_numpy(), table.column("loose").to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(loose), np.flatnonzero(~loose)
    if not len(a) or not len(b):
        return _stars(cls, [])
    found = join_sets([sets[i] for i in a], [sets[i] for i in b], label[a], label[b])
    return _stars(cls[np.concatenate([a, b])], found)


def join_large(sets: DataFrame, most: int = MOST, most_turns: int = 20) -> DataFrame:
    """cls, label of the classes of blocks (block, cls, s) of any size; classes that links connect have equal labels.

    A block is cut into parts, each compared in whole; then the smallest class of each component found stands for it, and
    the same is done with these until they fit one part. A link can now be missing only where it has an end outside its
    block's largest component: those classes are compared with all of the block.
    """
    label = sets.select("block", "cls", F.col("cls").alias("label"))
    heads, before = sets.select("block", "cls"), -1
    for turn in range(most_turns):
        sizes = heads.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        part = F.pmod(F.xxhash64("cls", F.lit(turn)), F.ceil(F.col("size") / most)).alias("part")
        dealt = heads.join(sizes, "block").select(F.col("cls").alias("c"), F.xxhash64("block", part).alias("own"), "size")
        rows = sets.join(dealt, sets["cls"] == dealt["c"]).drop("c")
        stars = save(rows.select("own", "block", "cls", "s").groupBy("own").applyInArrow(tidy_group(_within), "a long, b long"), "large-stars")
        label = save(label.join(stars, label["label"] == stars["a"], "left").select("block", "cls", F.coalesce("b", "label").alias("label")), "large-labels")
        whole = sizes.agg(F.max("size")).first()[0] or 0
        heads = label.select("block", F.col("label").alias("cls")).distinct()
        n = heads.count()
        if whole <= most or n == before:
            break
        before = n
    count = label.groupBy("block", "label").agg(F.count(F.lit(1)).alias("size"))
    top = count.groupBy("block").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("n")).select("block", F.col("top.label").alias("main"), (F.col("n") - F.col("top.size")).alias("n_loose"), F.ceil(F.col("n") / most).alias("parts"))
    top = top.where("n_loose > 0").select("block", "main", "parts", F.ceil(F.col("n_loose") / most).alias("loose_parts"))
    placed = save(label.join(top, "block").withColumn("loose", F.col("label") != F.col("main")), "large-placed")
    if placed.isEmpty():
        return label.select("cls", "label")
    # a grid of tasks: each part of the loose classes with each part of all of the block's
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda rows, loose: rows.select("cls", "label", F.lit(loose).alias("loose"), F.xxhash64("block", "x", "y").alias("own"))
    lone = cell(placed.where("loose").select("*", F.pmod(F.xxhash64("cls"), "loose_parts").alias("x"), F.explode(upto("parts")).alias("y")), True)
    rest = cell(placed.select("*", F.pmod(F.xxhash64("cls", F.lit(7)), "parts").alias("y"), F.explode(upto("loose_parts")).alias("x")), False)
    pairs = sets.select("cls", "s").join(lone.unionByName(rest), "cls")
    found = pairs.groupBy("own").applyInArrow(tidy_group(_across), "a long, b long")
    known = label.where("cls <> label").select(F.col("cls").alias("a"), F.col("label").alias("b"))
    roots = components(known.unionByName(found))
    return label.select("cls").join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("label"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    often = frequent(docs)
    rows = save(features(docs, often), "features")
    routed = save(groups(rows, often, most), "groups")
    kinds = save(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    listed = routed.where("gid IS NOT NULL").dropDuplicates(["gid"])
    n_blocks = max(1, int(listed.count() // 20_000) + 1)
    if n_blocks > 1:
        n_blocks = max(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    member = listed.select("gid", F.explode("members").alias("cls"))
    member = member.join(kinds.select("cls", "n", "bits"), "cls").withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(n_blocks)))
    maybe = narrow(member).unionByName(routed.where("gid IS NULL").select("a", "b"))
    blocks = save(components(maybe).select(F.col("node").alias("cls"), F.col("root").alias("block")), "blocks")
    chosen = kinds.select("cls", "rep").join(blocks, "cls")
    texts = docs.join(chosen, F.col("key").eqNullSafe(F.col("rep")))
    sets = save(_sets_of(texts).dropDuplicates(["cls"]), "sets")
    forget(routed, blocks)
    sizes = sets.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > most).select("block")
    n_tasks = max(1, int(sets.count() // 2_000) + 1)
    small = sets.join(large, "block", "left_anti").withColumn("own", F.pmod(F.xxhash64("block"), F.lit(n_tasks)))
    roots = save(small.groupBy("own").applyInArrow(tidy_group(_within), "a long, b long"), "stars").withColumnsRenamed({"a": "node", "b": "root"})
    if not large.isEmpty():
        rest = save(sets.join(large, "block", "left_semi"), "large")
        roots = roots.unionByName(join_large(rest, most).toDF("node", "root"))
        forget(rest)
    forget(sets)
    labelled = kinds.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    named = labelled.join(least, "root").select("cls", "component")
    # copies of one text, and texts without words, may be any share of the rows: their class's name goes to each salt that has one
    salted = rows.select("doc_id", "n", "cls", spread("doc_id", max(1, math.isqrt(rows.count()))).alias("salt"))
    dealt = salted.where("cls IS NOT NULL").select("cls", "salt").distinct().join(named, "cls")
    out = save(salted.join(dealt, ["cls", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")), "linked")
    forget(rows, kinds)
    return out
