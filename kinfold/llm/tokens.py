"""Exact, cached encoding of whole texts with the tokenizers library.

A byte-level BPE without normaliser never merges across the start of a single white-space character between two visible
ones, so a text falls into pieces (that character, then visible characters) which encode independently of each other.
Arrow splits a run of texts into pieces and numbers the different ones; the library encodes each new piece once per
worker, and the ids of the texts are gathered from those of their pieces. Texts with runs of white space, with white
space at an end or with any but blanks and line feeds, and tokenizers of another kind, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: RE2: texts that are encoded whole. White space by Unicode's and Python's definitions, but for lone blanks and line feeds.
WHOLE = (
    r"\A[ \n]|[ \n][ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
MOST_CACHED = 400_000
CLOSING = frozenset(".,;:!?")
#: Pieces that the library encodes as one text, and texts that it encodes in one call: what it returns takes a hundred bytes an id.
JOINED = 200
CALL = 100
#: Bytes of text, or one text, that are split into pieces at once: the arrays on the way take many times as much.
RUN = 2_000_000


class Encoder:
    """Ids of texts as numpy arrays of `dtype` (two bytes an id where the vocabulary allows), as the library gives them
    with add_special_tokens=False; texts that hold an added token's string are encoded whole."""

    def __init__(self, path: str):
        # a task has one core; each thread of the library would hold memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        conf = json.loads(self.tokenizer.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.pieces = conf["model"]["type"] == "BPE" and conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
        self.added = {t["content"] for t in conf.get("added_tokens") or []}
        self.whole = "|".join([WHOLE, *(re.sub(r"([^A-Za-z0-9])", r"\\\1", t) for t in sorted(self.added))])
        #: In a byte-level vocabulary each character of a token stands for one byte; an added token is its own string.
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        #: Tokens that begin with the white space before a piece.
        self.first = np.zeros(len(self.n_bytes), bool)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if token in self.added else len(token)
            self.first[i] = token[:1] in "ĠĊ" and token not in self.added
        self.alone = {c: vocab[c] for c in CLOSING if c in vocab}
        self._forget()

    def _forget(self) -> None:
        """Empty the table of pieces: their numbers, and the ids of piece k at flat[begin[k] : begin[k] + size[k]]."""
        self.cache = {"": 0}
        self.flat, self.begin, self.size = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)
        if self.pieces:
            self._add(["\n"], *self._joined(["\n"]))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        calls = (texts[a : a + CALL] for a in range(0, len(texts), CALL))
        return [np.array(e.ids, self.dtype) for call in calls for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of pieces, encoded as texts of many; a piece begins at each token that begins with its white
        space, as pieces hold no other."""
        marked = [p if p[0] == "\n" else " " + p for p in pieces]
        ids = np.concatenate([np.zeros(0, self.dtype), *self._whole(["".join(marked[a : a + JOINED]) for a in range(0, len(marked), JOINED)])])
        starts = np.flatnonzero(self.first[ids])
        if len(starts) != len(pieces) or len(ids) and starts[0]:
            parts = self._whole(marked)  # a vocabulary of another kind
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(starts, append=len(ids))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.begin)
        self.cache.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _gather(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, where each ends)."""
        sizes = self.size[pieces]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[pieces] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], ends

    def _learn(self, pieces: list[str]) -> None:
        cache, alone = self.cache, self.alone
        # closing punctuation after letters is a token of its own
        closed = [p for p in pieces if p[-1] in alone and p[:-1].isalpha()]
        bare = [p[:-1] for p in closed]
        rest = [p for p in set(bare).union(set(pieces).difference(closed) if closed else pieces) if p not in cache]
        if rest:
            self._add(rest, *self._joined(rest))
        if closed:
            own, ends = self._gather(np.fromiter(map(cache.__getitem__, bare), np.int64, len(bare)))
            marks = np.array([alone[p[-1]] for p in closed], self.dtype)
            self._add(closed, np.insert(own, ends, marks), np.diff(ends, prepend=0) + 1)

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end); null counts as empty."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for _, run in text_runs(pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], ["text"]), most=RUN):
            own, starts = self._encode_run(run.column(0))
            ids.append(own)
            counts.append(np.diff(starts))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.whole) if self.pieces else pa.array(np.ones(n, bool))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            by_hand = self._whole(texts.take(pa.array(odd)).to_pylist())
            texts = pc.if_else(whole, pa.scalar("", pa.large_string()), texts)
        if not self.pieces:
            return np.concatenate([np.zeros(0, self.dtype), *by_hand]), np.concatenate([[0], np.cumsum([len(x) for x in by_hand])]).astype(np.int64)
        if len(self.cache) > MOST_CACHED:
            self._forget()
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " \n")
        split = pc.split_pattern(marked, " ")
        coded = split.values.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.cache.get, own, repeat(-1)), np.int64, len(own))
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new = [own[i] for i in unknown.tolist()]
            self._learn(new)
            places[unknown] = np.fromiter(map(self.cache.__getitem__, new), np.int64, len(new))
        ids, ends = self._gather(places[coded.indices.to_numpy()])
        starts = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        keep = np.ones(len(ids), bool)
        keep[starts[:-1]] = False  # the line feed put before each text
        ids, starts = ids[keep], starts - np.arange(n + 1)
        if len(odd):
            parts, at = [], 0
            counts = np.diff(starts)
            for i, raw in zip(odd.tolist(), by_hand, strict=True):
                parts += [ids[starts[at] : starts[i]], raw]
                at = i
                counts[i] = len(raw)
            ids = np.concatenate([*parts, ids[starts[at] :]])
            starts = np.concatenate([[0], np.cumsum(counts)])
        return ids, starts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        ids, at = self.encode_arrow(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character, end character) of each token; a token that holds part of a character's bytes spans
        that character."""
        if not self.pieces:
            off = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return off[:, 0], off[:, 1]
        ends = np.cumsum(self.n_bytes[ids])
        starts = ends - self.n_bytes[ids]
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(text):
            return starts, ends
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_runs(batch: pa.RecordBatch, column: str = "text", most: int = 8_000_000):
    """(first row, slice) runs of a batch whose texts hold `most` bytes at most, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(sizes, dtype=np.int64)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        part = batch.slice(at, stop - at)
        # taken rows are copied: some of Arrow's string functions misread slices
        yield at, part.take(pa.array(np.arange(len(part)))) if len(part) < len(batch) else part
        at = stop
