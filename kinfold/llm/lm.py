"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides.

All different words (by 64-bit hashes) are counted over the whole corpus in a written table, which grows with it. For the
network they are hashed to `BUCKETS` buckets. The commonest buckets have an id of their own, the
others share `SHARED` ids. Buckets in order of their counts are cut into classes of about equal mass; the network predicts
the class of a masked word from the `SIDE` words before and after it (a tanh layer and a softmax), and a bucket's share of
its class and a word's share of its bucket give the rest:  p(word | sides) = p(class | sides) * p(bucket | class) *
p(word | bucket).  The words that the corpus does not hold have a share of each bucket, by its words of one occurrence
(Good-Turing), and all of a bucket without words. A document's score is the sum of the log-probabilities of its words, each
given the words around it (a pseudo-log-likelihood); positions outside the document hold a border id.

Training is data-parallel over all documents: in each round every task starts from the same weights, runs over the round's
share of the positions of all its documents, and sends its weights; their mean by the number of positions starts the next
round. The rounds deal the positions out by a hash, so every word
of every document is a target in exactly one of them. What is sent grows with the number of tasks, so with the input; the
network does not. Scoring has the shares of at most `FREQUENT` words, the commonest, in each task and joins the other words
to the table.

Null, empty and blank texts have no words: n_tokens 0, score 0, no mean. Repeated rows each get a row; an empty table gives
no rows (and an untrained model); columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import save, tidy, tidy_group
from kinfold.llm.tokens import text_runs

BUCKETS = 1 << 15
OWN, SHARED = 4096, 1024
BORDER = OWN + SHARED
DIM, HIDDEN, CLASSES = 16, 32, 64
SIDE = 2
ROUNDS = 2
#: Adagrad's rate and the squares that it starts from.
RATE, START = 0.1, 1e-6
BATCH = 4096
#: Added to each bucket's count.
SMOOTH = 0.1
#: Words whose shares are sent to all tasks; the others are looked up by a join, with the same result.
FREQUENT = 1 << 19
RUN = 4_000_000
SEED = 11


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words, index of each word, where each text's words begin and the last's end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = parts.values.dictionary_encode()
    index = coded.indices.to_numpy()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    blank = np.flatnonzero(names == "") if len(names) else []
    real = index != blank[0] if len(blank) else np.ones(len(index), bool)
    at = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy()]
    return hashes, index[real], at


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, where each text's words begin and the last's end)."""
    hashes, index, at = split(texts)
    return bucket_of(hashes)[index], at


class Vocabulary:
    """Ids, classes and in-class log-probabilities of buckets, from their counts."""

    def __init__(self, counts: np.ndarray):
        self.empty = counts == 0
        smooth = counts + SMOOTH
        order = np.argsort(-smooth, kind="stable")
        self.ids = (OWN + np.arange(BUCKETS) % SHARED).astype(np.int64)
        self.ids[order[:OWN]] = np.arange(OWN)
        mass = np.cumsum(smooth[order]) / smooth.sum()
        self.classes = np.zeros(BUCKETS, np.int64)
        self.classes[order] = np.unique(np.minimum((np.concatenate([[0], mass[:-1]]) * CLASSES).astype(np.int64), CLASSES - 1), return_inverse=True)[1]
        total = np.bincount(self.classes, smooth, CLASSES)
        self.within = np.log(smooth / total[self.classes])
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)


class Network:
    """Weights by name; `flat` and `load` turn them into one vector and back."""

    def __init__(self, prior: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {
            "emb": rng.normal(0, 0.1, (BORDER + 1, DIM)).astype(np.float32),
            "into": rng.normal(0, 1 / np.sqrt(2 * SIDE * DIM), (2 * SIDE, DIM, HIDDEN)).astype(np.float32),
            "hid": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.05, (HIDDEN, CLASSES)).astype(np.float32),
            "bias": prior.copy(),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def step(self, around: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the mean negative log-probability of the classes `target` given the ids `around`. Each id's
        part of the hidden layer is computed once, and gradients are summed by id before they go back through it."""
        w, n = self.w, len(target)
        emb, into, ones = w["emb"], w["into"], np.ones(n, np.float32)
        h = hidden([emb @ into[p] for p in range(2 * SIDE)], around, w["hid"])
        z = h @ w["out"]
        z += w["bias"]
        if not small(w):
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= np.float32(1 / n) / (z @ np.ones((CLASSES, 1), np.float32))
        z[np.arange(n), target] -= np.float32(1 / n)
        dh = z @ w["out"].T
        dh *= 1 - h * h
        grads = {"out": h.T @ z, "bias": ones @ z, "hid": ones @ dh, "into": np.empty_like(into), "emb": np.zeros_like(emb)}
        for p in range(2 * SIDE):
            column = around[:, p].astype(np.uint16)  # sorted by radix
            order = np.argsort(column, kind="stable")
            first = np.flatnonzero(np.diff(column[order].astype(np.int64), prepend=-1))
            ids = column[order[first]].astype(np.int64)
            by_id = np.add.reduceat(dh.take(order, axis=0), first, axis=0)
            grads["into"][p] = emb[ids].T @ by_id
            grads["emb"][ids] += by_id @ into[p].T
        for k, g in grads.items():
            squares[k] += g * g
            w[k] -= RATE * g / np.sqrt(squares[k])


def small(w: dict[str, np.ndarray]) -> bool:
    """Whether no score of a class can be beyond 80 either way (the hidden layer is within 1), so that its power is finite
    and not 0 without taking the greatest score off."""
    return bool((np.abs(w["bias"]) + np.abs(w["out"]).sum(axis=0)).max() < 80)


def hidden(parts: list[np.ndarray], around: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The hidden layer, from the parts of each id at each place."""
    h = parts[0].take(around[:, 0], axis=0)
    for p in range(1, len(parts)):
        h += parts[p].take(around[:, p], axis=0)
    h += bias
    return np.tanh(h, out=h)


class Scorer:
    """Log-probabilities by a trained network; each id's part of the hidden layer is computed once."""

    def __init__(self, vocabulary: Vocabulary, network: Network):
        self.v, self.net = vocabulary, network
        #: How many words were targets in training.
        self.trained = 0
        self.words: Words | None = None
        self.parts: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": None}

    def log_probs(self, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each word given the words around it in its text."""
        w = self.net.w
        if self.parts is None:
            self.parts = [w["emb"] @ w["into"][p] for p in range(2 * SIDE)]
        around = window(self.v.ids[bucket], at)
        target, out = self.v.classes[bucket], self.v.within[bucket].copy()
        ones, bounded = np.ones(CLASSES, np.float32), small(w)
        for a in range(0, len(bucket), 4096):
            s = slice(a, a + 4096)
            z = hidden(self.parts, around[s], w["hid"]) @ w["out"]
            z += w["bias"]
            if not bounded:
                z -= z.max(axis=1, keepdims=True)
            t = z[np.arange(len(z)), target[s]]
            out[s] += t - np.log(np.exp(z, out=z) @ ones)
        return out


def window(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids `SIDE` before to `SIDE` after each place, without its own; the border id outside its text."""
    n = len(ids)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.full((n, 2 * SIDE), BORDER, np.int64, order="F")
    for p, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        k = abs(d)
        if n > k:
            same = text[k:] == text[:-k]
            if d < 0:
                out[k:, p] = np.where(same, ids[:-k], BORDER)
            else:
                out[:-k, p] = np.where(same, ids[k:], BORDER)
    return out


def targets(bucket: np.ndarray, at: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places that are masked and predicted in a round; each place is in one of the rounds."""
    place = np.arange(len(bucket)) - np.repeat(at[:-1], np.diff(at))
    return np.flatnonzero((bucket * 31 + place * 17 + turn) % rounds == 0)


class Words:
    """The corpus' words: `table` (word: its hash, n, share: log of the word's share of its bucket's occurrences), the share
    of unknown words, and the commonest words with their shares for the tasks."""

    def __init__(self, table: DataFrame):
        self.table = table
        # a row for each step of the counts, of which there are 253 at most
        steps = sorted(table.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect(), reverse=True)
        n, once = sum(r["n"] for r in steps), sum(r["once"] for r in steps)
        unknown = (once + 1) / (n + 2)
        self.known, self.unknown = float(np.log1p(-unknown)), float(np.log(unknown))
        fits = [r["step"] for r, words in zip(steps, np.cumsum([r["words"] for r in steps]), strict=True) if words <= FREQUENT]
        # FREQUENT rows at most
        top = table.where(F.floor(F.log2("n") * 4) >= F.lit(min(fits, default=1 << 20))).select("word", "share").toArrow()
        words = top.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        self.words, self.shares = words[order], top.column("share").to_numpy()[order] + self.known

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def local(self, hashes: np.ndarray) -> np.ndarray:
        """Log shares of the words that are frequent; NaN for others."""
        if not len(self.words):
            return np.full(len(hashes), np.nan)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[place] == hashes, self.shares[place], np.nan)


def count_words(docs: DataFrame, text: str = "text") -> tuple[Words, np.ndarray]:
    """The words of the corpus, and how often each bucket occurs in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in text_runs(batch, most=RUN):
                hashes, index, _ = split(rows.column("text"))
                n = np.bincount(index, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0].view(np.int64)), pa.array(n[n > 0])], ["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(tidy(count), "word long, n long")
    bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    counted = save(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts").select("word", bucket, "n")
    sums = counted.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    out = np.zeros(BUCKETS, np.int64)
    # BUCKETS rows
    for r in sums.collect():
        out[r["bucket"]] = r["in_bucket"]
    table = counted.join(F.broadcast(sums), "bucket").select("word", "n", F.log(F.col("n") / F.col("in_bucket")).alias("share"))
    return Words(save(table, "lm-words")), out


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, batch_size: int = BATCH) -> Scorer:
    """Fit to all documents. The driver holds counts of buckets, frequent words and weights only, of fixed size."""
    spark = docs.sparkSession
    words, counts = count_words(docs, text)
    vocabulary = Vocabulary(counts)
    network = Network(vocabulary.prior)
    size, chunk, trained = len(network.flat()), 4096, 0
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, network))

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            v, start = shared.value
            net = Network(v.prior)
            net.load(start.flat())
            squares = {k: np.full(x.shape, START, np.float32) for k, x in net.w.items()}
            seen = 0
            for batch in batches:
                for _, rows in text_runs(batch, most=RUN):
                    bucket, at = buckets(rows.column("text"))
                    if not len(bucket):
                        continue
                    chosen = targets(bucket, at, turn, rounds)
                    around, target = window(v.ids[bucket], at)[chosen], v.classes[bucket[chosen]]
                    order = np.random.default_rng(SEED + len(chosen)).permutation(len(chosen))
                    a = 0
                    while a < len(order):  # small steps first
                        part = order[a : a + min(batch_size, 512 + (seen + a) // 32)]
                        net.step(around[part], target[part], squares)
                        a += len(part)
                    seen += len(chosen)
            flat = net.flat() * np.float32(seen)
            cut = np.arange(0, size, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut))), pa.array([seen] * len(cut), pa.int64()), pa.array([flat[c : c + chunk].tobytes() for c in cut], pa.binary())], ["chunk", "seen", "w"])

        def mean(t: pa.Table) -> pa.Table:
            n = sum(t.column("seen").to_pylist())
            total = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("w").to_pylist()], axis=0)
            return pa.table({"chunk": [t.column("chunk")[0].as_py()], "w": pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary()), "seen": [n]})

        sent = docs.select(F.col(text).alias("text")).mapInArrow(tidy(local), "chunk long, seen long, w binary")
        # size / chunk rows: the weights once
        got = sorted(sent.groupBy("chunk").applyInArrow(tidy_group(mean), "chunk long, w binary, seen long").collect(), key=lambda r: r["chunk"])
        if got and got[0]["seen"]:
            network.load(np.concatenate([np.frombuffer(r["w"], np.float32) for r in got]))
            trained += got[0]["seen"]
    scorer = Scorer(vocabulary, network)
    scorer.trained, scorer.words = trained, words
    return scorer


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, log_likelihood (sum over all words), mean_log_prob of every row. Texts are not shuffled, only their
    words that are not frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for _, rows in text_runs(batch, most=RUN):
                hashes, index, at = split(rows.column("text"))
                bucket = bucket_of(hashes)
                share = np.where(s.v.empty[bucket], 0.0, s.words.local(hashes))
                rare = np.isnan(share)[index]
                run = np.concatenate([[0.0], np.cumsum(s.log_probs(bucket[index], at) + np.nan_to_num(share)[index])])
                cut = np.concatenate([[0], np.cumsum(rare)])[at]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes[index[rare]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(np.diff(at).astype(np.int64)), pa.array(run[at[1:]] - run[at[:-1]]), lists], ["key", "n_tokens", "part", "rare"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = rows.mapInArrow(tidy(own), "key long, n_tokens long, part double, rare array<long>")
    parts = save(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("row", F.explode("rare").alias("word")).join(scorer.words.table.select("word", "share"), "word", "left")
    rest = rare.groupBy("row").agg(F.sum(F.coalesce(F.col("share") + scorer.words.known, F.lit(scorer.words.unknown))).alias("rest"))
    total = F.col("part") + F.coalesce("rest", F.lit(0.0))
    out = parts.drop("rare").join(rest, "row", "left").select("key", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))).withColumnRenamed("key", key)
