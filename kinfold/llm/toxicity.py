"""Toxicity by a convolutional text classifier, trained in numpy.

Words are embedded by hashing: a word's vector is the sum of a hashed row for the word (lower case, punctuation at its ends
removed) and the mean of hashed rows for its byte n-grams. Filters of several widths run over the words, each is
max-pooled over the whole text, and a logistic layer scores the pooled values. Scores are shifted so that the threshold
with the best F1 on all labelled rows lies at 0.3; thresholds are then calibrated for each language, on all its labelled
rows.

The model is fitted on the driver on a bounded sample of labelled rows (`MOST_POSITIVE`, `MOST_NEGATIVE`, `MOST_CHARS`).
classify() runs the network over all texts once, without a shuffle, and writes their log-odds; those of all rows with a
label are counted by language and label for the calibration, which then moves the written values to scores. Null and empty
texts have the score of a text without words; repeated rows each get a row; an empty table gives no rows; without labels of
both kinds every score is the share of toxic labels (0 if there are none). Of the texts of a repeated key the sample has the
one of the smallest hash. Columns other than key and text are not read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinfold.llm.common import save, tidy
from kinfold.llm.tokens import text_runs

ROWS = 1 << 16
DIM = 16
WIDTHS = {1: 16, 2: 8, 3: 8}
GRAMS = (4, 5)
THRESHOLD = 0.3
#: Bounds of the training sample.
MOST_POSITIVE, MOST_NEGATIVE, MOST_CHARS = 1500, 3000, 20_000_000
#: Bytes of text that a task scores at a time.
RUN = 4_000_000
#: Width of the steps of log-odds in which scores are counted for calibration.
STEP = 0.01
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#-_~`/\\"
SEED = 20240501


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each word, where each text's words begin and the last's end, the different words)."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = split.values.dictionary_encode()
    names = coded.dictionary
    real = pc.not_equal(split.values, "").to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
    return coded.indices.to_numpy()[real], at, names


def word_rows(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of all n-grams, number of n-grams of each word)."""
    bare = pc.utf8_trim(names, characters=PUNCTUATION)
    own = (pd.util.hash_array(bare.to_numpy(zero_copy_only=False), categorize=False) % ROWS).astype(np.int64)
    framed = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), bare, pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    lengths = pc.binary_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(framed.cast(pa.large_binary()).to_pylist()), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    rows, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[j : j + len(h)] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        inside = word[: len(h)] == word[n - 1 :]
        rows.append((h[inside] % np.uint64(ROWS)).astype(np.int64) + ROWS), owners.append(word[: len(h)][inside])
    if not rows:
        return own, np.zeros(0, np.int64), np.zeros(len(names), np.int64)
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return own, rows[order], np.bincount(owners, minlength=len(names))


def grams_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each n-gram of the words among all n-grams, which of the words it belongs to)."""
    n = counts[words]
    owner = np.repeat(np.arange(len(words)), n)
    return (np.cumsum(counts) - counts)[words][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner], owner


class Model:
    """`table`: hashed rows of words, then of n-grams; `taps[w]`: filters of width w as (position, dimension, filter)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (2 * ROWS, DIM)).astype(np.float32)
        self.taps = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, n)).astype(np.float32) for w, n in WIDTHS.items()}
        self.bias = {w: np.zeros(n, np.float32) for w, n in WIDTHS.items()}
        self.out = np.zeros(sum(WIDTHS.values()), np.float32)
        self.base = np.float32(0)
        self.shift = 0.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}

    def vectors(self, own: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = self.table[own]
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for at in range(0, len(some), 20_000):
                s = some[at : at + 20_000]
                first, last = starts[at], starts[at + len(s)] if at + len(s) < len(some) else len(grams)
                out[s] += np.add.reduceat(self.table[grams[first:last]], starts[at : at + len(s)] - first, axis=0) / counts[s][:, None]
        return out

    def pooled(self, e: np.ndarray, index: np.ndarray, at: np.ndarray, where: bool = False) -> tuple[np.ndarray, dict]:
        """Max-pooled filter values of each text (0 where a text is shorter than the filter, as no value is below 0), and
        with `where` the position of each maximum (-1: none)."""
        n = len(at) - 1
        parts, places = [], {}
        for w, taps in self.taps.items():
            best = np.zeros((n, taps.shape[2]), np.float32)
            place = np.full((n, taps.shape[2]), -1, np.int64)
            by_word = [e @ taps[k] for k in range(w)]
            lengths = np.diff(at)
            long = np.flatnonzero(lengths >= w)
            for a in range(0, len(long), 256):
                t = long[a : a + 256]
                s = at[t]
                first, last = int(s[0]), int(at[t[-1] + 1])
                run = index[first:last]
                v = by_word[0][run[: len(run) - w + 1]]
                for k in range(1, w):
                    v = v + by_word[k][run[k : len(run) - w + 1 + k]]
                v += self.bias[w]
                # windows that cross into the next text do not count; they are the last w - 1 of each
                if w > 1:
                    ends = (at[1:][(at[1:] > first) & (at[1:] < last)] - first)[:, None] - np.arange(1, w)
                    v[ends[ends >= 0]] = -1
                cut = s - first
                top = np.maximum.reduceat(v, cut, axis=0)
                best[t] = np.maximum(top, 0)
                if where:
                    for r, i in enumerate(t.tolist()):
                        stop = int(at[i + 1]) - first - w + 1
                        place[i] = v[cut[r] : stop].argmax(axis=0) + at[i]
            places[w] = np.where(best > 0, place, -1)
            parts.append(best)
        return np.concatenate(parts, axis=1), places

    def odds(self, texts: pa.Array) -> np.ndarray:
        """Log-odds before calibration."""
        if self.constant is not None:
            return np.zeros(len(texts))
        index, at, names = tokens(texts)
        x, _ = self.pooled(self.vectors(*word_rows(names)), index, at)
        return x.astype(np.float64) @ self.out + self.base

    def score_of(self, odds: Column) -> Column:
        """Scores from log-odds."""
        if self.constant is not None:
            return F.lit(self.constant)
        return 1 / (1 + F.exp(-(odds + F.lit(self.shift))))

    def start(self, texts: list[str], labels: np.ndarray) -> None:
        """The first dimension of each row starts as the log-odds of the label given the row, and the first filter of each
        width as its mean over the window."""
        seen = np.zeros((2, 2 * ROWS))
        for i, text in enumerate(texts):
            index, _, names = tokens(pa.array([text], pa.large_string()))
            own, grams, counts = word_rows(names)
            used = np.unique(index)
            seen[int(labels[i]), np.unique(np.concatenate([own[used], grams[grams_of(used, counts)[0]]]))] += 1
        share = (seen + 0.5) / (np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None] + 1)
        self.table[:, 0] = np.clip(np.log(share[1] / share[0]), -4, 4)
        for w, taps in self.taps.items():
            taps[:, :, 0] = 0
            taps[:, 0, 0] = 1 / w
            self.bias[w][0] = -1.0

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, batch: int = 64, seed: int = SEED) -> None:
        """Adagrad on the logistic loss; only the maxima of a text have gradients."""
        rng = np.random.default_rng(seed)
        self.start(texts, labels)
        params = {"table": self.table, "out": self.out} | {f"t{w}": t for w, t in self.taps.items()} | {f"b{w}": b for w, b in self.bias.items()}
        squares = {k: np.full(v.shape, 0.01, np.float32) for k, v in params.items()}
        base_square = 0.01
        share = float(labels.mean())
        self.base = np.float32(np.log(share / (1 - share)))
        self.out[:] = rng.normal(0, 0.1, len(self.out))
        self.out[np.cumsum([0, *WIDTHS.values()])[:-1]] = 0.5

        def step(name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
            at = slice(None) if rows is None else rows
            squares[name][at] += g * g
            params[name][at] -= rate * g / np.sqrt(squares[name][at])

        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), batch):
                chosen = order[b : b + batch]
                index, at, names = tokens(pa.array([texts[i] for i in chosen], pa.large_string()))
                if not len(names):
                    continue
                own, grams, counts = word_rows(names)
                e = self.vectors(own, grams, counts)
                x, places = self.pooled(e, index, at, where=True)
                p = 1 / (1 + np.exp(-(x @ self.out + self.base)))
                d = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
                dx = d[:, None] * self.out
                ge: dict[int, np.ndarray] = {}
                words, grads, c = [], [], 0
                for w, taps in self.taps.items():
                    n = taps.shape[2]
                    t, f = np.nonzero(places[w] >= 0)
                    g, pos = dx[t, c + f], places[w][t, f]
                    gt = np.zeros_like(taps)
                    for k in range(w):
                        wd = index[pos + k]
                        np.add.at(gt[k].T, f, g[:, None] * e[wd])
                        words.append(wd), grads.append(g[:, None] * taps[k].T[f])
                    step(f"b{w}", np.bincount(f, g, n).astype(np.float32))
                    ge[w], c = gt, c + n
                step("out", x.T @ d)
                base_square += float(d.sum()) ** 2
                self.base -= np.float32(rate * float(d.sum()) / np.sqrt(base_square))
                for w, gt in ge.items():
                    step(f"t{w}", gt)
                if words:
                    wd, gw = np.concatenate(words), np.concatenate(grads)
                    used, place = np.unique(wd, return_inverse=True)
                    per = np.zeros((len(used), DIM), np.float32)
                    np.add.at(per, place, gw)
                    gram_at, owner = grams_of(used, counts)
                    rows = np.concatenate([own[used], grams[gram_at]])
                    values = np.concatenate([per, per[owner] / counts[used][owner, None]])
                    used, place = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(used), DIM), np.float32)
                    np.add.at(total, place, values)
                    step("table", total, used)


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold with the best F1, in the middle between the scores beside it. With `n` each score stands for `n` rows,
    `y` of them toxic."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    rows = np.arange(1, len(p) + 1) if n is None else np.cumsum(n[order])
    f1 = 2 * hits / (rows + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    logit = lambda v: np.log(np.clip(v, 1e-6, 1 - 1e-6) / (1 - np.clip(v, 1e-6, 1 - 1e-6)))
    return float(1 / (1 + np.exp(-(logit(p[order[k]]) + logit(low)) / 2)))


def longest_text(lengths: list[int], most: int | None = None) -> int:
    """The largest length to which texts can be cut so that all together have no more than `most` characters."""
    left = MOST_CHARS if most is None else most
    lengths = sorted(lengths)
    for k, n in enumerate(lengths):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def marked(labels: DataFrame, key: str, label: str, usable: Column | None) -> DataFrame:
    """key, label of the labelled rows for which `usable` holds; a key with both labels is toxic."""
    rows = labels.where(usable) if usable is not None else labels
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    return rows.where("label IN (0, 1)")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None) -> Model:
    """Fit on a sample of the labelled rows for which `usable` (on the key) holds, without calibration. The sample is the
    rows of the smallest hashes of the key, up to the bounds for each label; of texts that are too long together only the
    longest are cut, all to one length. Repeated label rows count once; a key with both labels is toxic."""
    known = marked(labels, key, label, usable).join(docs.select(F.col(key).alias("key")), "key", "left_semi")
    pick = lambda v, n: known.where(F.col("label") == v).orderBy(F.crc32(F.concat(F.lit("sample"), F.col("key").cast("string"))), "key").limit(n)
    # bounded by MOST_POSITIVE + MOST_NEGATIVE rows
    sample = pick(1, MOST_POSITIVE).unionByName(pick(0, MOST_NEGATIVE))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = own.join(F.broadcast(sample), "key").withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, MOST_CHARS))
    rows = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")).select("key", "r.text", "r.label")
    rows = save(rows, "toxicity-sample").orderBy(F.crc32(F.col("key").cast("string")), "key")
    longest = longest_text([r[0] for r in rows.select(F.length("text")).collect()])
    texts, y = [], []
    for r in rows.withColumn("text", F.substring("text", 1, longest)).toLocalIterator():
        texts.append(r["text"]), y.append(r["label"])
    y, model = np.array(y, np.float64), Model()
    if len(y) == 0 or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    # a fifth is not fitted, so that rows which the model has not seen count at every size
    fitted = np.arange(len(y)) % 5 != 4
    if y[fitted].min() == y[fitted].max():
        fitted[:] = True
    model.fit([t for t, f in zip(texts, fitted, strict=True) if f], y[fitted])
    return model


def calibrate(model: Model, found: DataFrame, known: DataFrame, key: str, lang: str | None, odds: str) -> None:
    """Choose shift and thresholds from the log-odds (column `odds` of `found`) of all rows of labelled keys, counted by
    language and label in steps of `STEP`. Only keys, languages and log-odds are shuffled."""
    if model.constant is not None:
        return
    rows = found.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"), F.round(F.greatest(F.least(F.col(odds), F.lit(14.0)), F.lit(-14.0)) / STEP).cast("int").alias("step"))
    counts = rows.join(known, "key").groupBy("lang", "step").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    # at most 28 / STEP rows for each language
    table = counts.toPandas()
    logit = lambda v: float(np.log(v / (1 - v)))

    def cut(t: pd.DataFrame) -> float | None:
        t = t.groupby("step", as_index=False)[["hits", "n"]].sum()
        if not 0 < t["hits"].sum() < t["n"].sum():
            return None
        return logit(best_threshold(1 / (1 + np.exp(-t["step"].to_numpy(np.float64) * STEP)), t["hits"].to_numpy(np.float64), t["n"].to_numpy(np.float64)))

    general = cut(table)
    model.shift = logit(THRESHOLD) - general if general is not None else 0.0
    for name, own in table[table["lang"].fillna("") != ""].groupby("lang"):
        if (c := cut(own)) is not None:
            model.thresholds[name] = float(1 / (1 + np.exp(-(c + model.shift))))


def log_odds(docs: DataFrame, model: Model, text: str, keep: list[str], name: str) -> DataFrame:
    """The columns of `keep` and the log-odds before calibration as `name`, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = "_text"
    while inner in keep:
        inner += "_"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for _, rows in text_runs(batch, inner, RUN):
                p = m.odds(rows.column(inner))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in range(len(keep))], pa.array(p, pa.float64())], [*keep, name])

    rows = docs.select(*keep, F.col(text).alias(inner))
    fields = [f for f in rows.schema.fields if f.name != inner]
    return rows.mapInArrow(tidy(own), StructType([*fields, StructField(name, DoubleType())]))


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", usable: Column | None = None, keep: list[str] | None = None, name: str = "score") -> tuple[DataFrame, Model]:
    """The columns of `keep` (key by default) and the calibrated score as `name`, for every row, and the model. Texts are run
    through the network once; what it gives is written with the columns kept."""
    keep = [key] if keep is None else list(keep)
    model = fit(docs, labels, key, text, label, usable)
    by = lang if lang in docs.columns else None
    more = [c for c in (key, by) if c is not None and c not in keep]
    odds = free_name("_odds", [*keep, *more, name])
    found = save(log_odds(docs, model, text, [*keep, *more], odds), "toxicity-odds")
    calibrate(model, found, marked(labels, key, label, usable), key, by, odds)
    return found.select(*keep, model.score_of(F.col(odds)).alias(name)), model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", usable: Column | None = None) -> Model:
    """A calibrated model."""
    return classify(docs, labels, key, text, label, lang, usable)[1]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of `keep` (key by default) and the score as `name`, for every row."""
    keep = [key] if keep is None else list(keep)
    odds = free_name("_odds", [*keep, name])
    return log_odds(docs, model, text, keep, odds).select(*keep, model.score_of(F.col(odds)).alias(name))


def threshold_of(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a language; 0.3 for one without."""
    if not model.thresholds:
        return F.lit(THRESHOLD)
    known = F.create_map(*[F.lit(v) for pair in sorted(model.thresholds.items()) for v in pair])
    return F.coalesce(F.try_element_at(known, lang.cast("string")), F.lit(THRESHOLD))
