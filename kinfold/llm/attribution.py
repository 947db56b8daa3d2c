"""Token counts attributed to sections of documents by character offsets.

A text is encoded once, as a whole. Its sections (lines, or the spans that fields take when they are joined) are character
intervals that cover it; each token's character span is interval-joined with them by binary search. A token that crosses a
border is allocated by a rule:

  start     to the section of its first character
  end       to the section of its last character
  majority  to the section with most of its characters, the earlier one if equal
  split     to each section by its share of the token's characters

The rules give the same total, the tokens of the text. A token holding part of a character's bytes spans that character.
Null and empty texts have one section, empty, with no tokens; null fields are empty sections; repeated rows each get their
rows; an empty table gives none; columns other than the key and the fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import tidy
from kinfold.llm.tokens import encoder, text_runs

RULES = ("start", "end", "majority", "split")


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. Section i is borders[i] up to borders[i + 1]; crossing tokens are
    counted in the section of their first character."""
    n = len(borders) - 1
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, np.maximum(ends - 1, starts), "right") - 1
    crosses = np.bincount(first[first < last], minlength=n)
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(np.float64)
    over = np.flatnonzero(~inside)
    if rule == "start":
        counts += np.bincount(first[over], minlength=n)
    elif rule == "end":
        counts += np.bincount(last[over], minlength=n)
    else:
        for t in over.tolist():
            sections = np.arange(first[t], last[t] + 1)
            held = np.minimum(ends[t], borders[sections + 1]) - np.maximum(starts[t], borders[sections])
            if rule == "split":
                counts[sections] += held / held.sum()
            else:
                counts[sections[np.argmax(held)]] += 1
    return counts, crosses


def line_borders(text: str) -> np.ndarray:
    """Borders of a text's lines; a line feed belongs to the line that it ends."""
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)], [len(data)]])


def _attribute(rows: DataFrame, tokenizer: str, rule: str, borders) -> DataFrame:
    """`rows` (key, text, more columns for `borders`) to key, section, start_char, n_chars, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for _, run in text_runs(batch):
                ids, at = enc.encode_arrow(run.column("text"))
                texts = run.column("text").to_pylist()
                owner, parts = [], [[], [], [], [], []]
                for i, (t, a, b) in enumerate(zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    edges = borders(t or "", run, i)
                    starts, ends = enc.spans(t or "", ids[a:b])
                    n, crossing = allocate(starts, ends, edges, rule)
                    owner.append(np.full(len(n), i))
                    for p, v in zip(parts, (np.arange(len(n)), edges[:-1], np.diff(edges), n, crossing), strict=True):
                        p.append(v)
                sec, start, size, n, crossing = (np.concatenate(p) for p in parts)
                key = run.column("key").take(pa.array(np.concatenate(owner)))
                yield pa.RecordBatch.from_arrays([key, pa.array(sec.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(n), pa.array(crossing.astype(np.int64))], ["key", "section", "start_char", "n_chars", "n_tokens", "n_crossing"])

    return rows.mapInArrow(tidy(own), "key long, section int, start_char long, n_chars long, n_tokens double, n_crossing long")


def by_line(docs: DataFrame, tokenizer: str, rule: str = "start", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of each text: key, section, start_char, n_chars, n_tokens, n_crossing."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return _attribute(rows, tokenizer, rule, lambda t, run, i: line_borders(t)).withColumnRenamed("key", key)


def by_field(docs: DataFrame, tokenizer: str, fields: Sequence[str], rule: str = "start", key: str = "doc_id", between: str = "\n") -> DataFrame:
    """A row for each field of each row whose fields are joined by `between` and encoded as one text; section i is
    fields[i] with the separator after it."""
    n, sep = len(fields), len(between)
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    lengths = [(F.length(t) + (sep if i < n - 1 else 0)).cast("long") for i, t in enumerate(texts)]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.concat_ws(between, *texts).alias("text"), F.array(*lengths).alias("lengths"))

    def borders(t: str, run: pa.RecordBatch, i: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(run.column("lengths")[i].values.to_numpy())])

    return _attribute(rows, tokenizer, rule, borders).withColumnRenamed("key", key)
