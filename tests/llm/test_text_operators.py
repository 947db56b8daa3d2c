"""Brute-force checks of the operators on texts, on small fixtures with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import attribution, common, components, jaccard, mixing, packing, records, sketch, tokens
from kinfold.llm.tokens import default_path, encoder, text_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, k string, key string"


def library():
    """The tokenizers library itself, as the operators' contract calls it."""
    return Tokenizer.from_file(default_path())


def made(seed, n=120):
    """Texts with families of near copies, odd white space, nulls and blanks."""
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 20, 60, 150]))] for _ in range(n // 4)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n", "  ", "\t"]).join(w))
    return [*texts, None, "", " \n", "one", "One", "a b c d", texts[0], "x" * 30_000, "pad " * 3000, "a <|endoftext|> b", "a<|endoftext|>", "é.\nZ, q! (b).c"]


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, 0, 1, "c", "k", "q") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(sets):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                    a, b = find(x), find(y)
                    up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  \n\n,.'st1é日\t🙂_<|>xB\xa0")), max_size=40), max_size=4))
def test_encoder_equals_library(texts):
    enc, lib = encoder(default_path()), library()
    texts = [*texts, *(t + "<|endoftext|>" + t for t in texts[:1])]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CACHED", 50)
    enc, lib = tokens.Encoder(default_path()), library()
    for seed in range(4):
        texts = made(seed)
        assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(enc.cache) < 2000


def test_encoder_on_slices():
    enc = encoder(default_path())
    texts = made(1)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got = []
    for _, run in text_runs(batch, most=2000):
        ids, at = enc.encode_arrow(run.column("text"))
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    lib = library()
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_cuts_long_columns(monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 300)
    monkeypatch.setattr(tokens, "CALL", 3)
    texts = made(3)
    enc, lib = tokens.Encoder(default_path()), library()
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [len(x) for x in enc.encode_arrow(pa.array([], pa.string()))] == [0, 1]


MEMORY = """
import re
import numpy as np, pyarrow as pa
from kinfold.llm.tokens import Encoder, default_path
peak = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1000
enc, rng = Encoder(default_path()), np.random.default_rng(1)
words = np.array(["".join(map(chr, w)) for w in rng.integers(97, 123, (250_000, 5))])
texts = pa.array([" ".join(words[rng.integers(0, len(words), 500)]) for _ in range(4000)], pa.string())
before = peak()
ids, starts = enc.encode_arrow(texts)
assert len(starts) == 4001 and starts[-1] == len(ids)
print(peak() - before)
"""


def test_encoder_memory_is_bounded():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    said = subprocess.run([sys.executable, "-c", MEMORY], env=env, capture_output=True, text=True, check=True).stdout
    assert float(said) < 250, f"{said} MB for 12 MB of texts"


def test_batches_for_the_encoder_are_small(spark, monkeypatch):
    limit = lambda: spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    before, seen = limit(), {}
    monkeypatch.setattr(packing, "save", lambda df, name, f=packing.save: (seen.setdefault(name, limit()), f(df, name))[1])
    packing.pack_documents(frame(spark, made(4)), default_path())
    assert int(seen["pieces"]) <= 4_000_000 and limit() == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    texts = spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 10000)").alias("text")).mapInArrow(sizes, "rows long, size long")
    with common.small_batches(spark):
        found = texts.collect()
    assert sum(r["rows"] for r in found) == 3000 and max(r["size"] for r in found) < 5_000_000


def test_records_are_written_from_small_batches(spark, monkeypatch):
    limit = lambda: spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    before, seen = limit(), []
    monkeypatch.setattr(records, "tidy", lambda f, g=records.tidy: (seen.append(limit()), g(f))[1])
    manifest = records.write(frame(spark, made(5)), None, default_path())
    assert int(seen[0]) <= 4_000_000 and limit() == before and sum(m["records"] for m in manifest) == len(made(5))


@pytest.mark.parametrize("most", [jaccard.MOST, 7])
def test_jaccard_join(spark, most):
    texts = made(2)
    out = {r["doc_id"]: r for r in jaccard.join(frame(spark, texts), most=most).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets)
    assert {i: (out[i]["n_shingles"], out[i]["component_id"]) for i in out} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_large_block_with_loose_classes(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(60):  # a chain: neighbours are near, ends are not
        w = base[:]
        for j in range(i // 2):
            w[j] = f"n{j}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, texts), most=5).collect()}
    assert out == brute_components({i: shingles(t) for i, t in enumerate(texts)})


def test_jaccard_odd_inputs(spark):
    assert jaccard.join(frame(spark, [])).collect() == []
    out = jaccard.join(frame(spark, ["a b c d e f", "a b c d e f", None, "z"], [5, 5, None, 2]))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.where("doc_id is not null").collect()) == [(2, 1, 2), (5, 2, 5), (5, 2, 5)]


def test_tree_bounds_never_lose_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(3, 300)).astype(np.uint64)
        sets.append(np.unique(base))
        keep = rng.random(len(base)) < 0.93
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, 2).astype(np.uint64)])))
    n = np.array([len(s) for s in sets])
    for width in (64, 256, 1024):
        bits = np.stack([jaccard.bitmap(s, width) for s in sets])
        found = set(zip(*(x.tolist() for x in jaccard.candidate_pairs(jaccard.Tree(bits, n))), strict=True))
        links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j])}
        assert links <= found
    assert links


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    assert out == {a: min(s) for a, s in up.items() if len(s) > 1}


@pytest.mark.parametrize("most", [records.SHARD_BYTES, 3000])
def test_records_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(records, "SHARD_BYTES", most)
    texts = made(6)
    ids = [*range(len(texts) - 2), None, 3]
    manifest = records.write(frame(spark, texts, ids), None, default_path())
    enc = library()
    tie = {r["text"]: r["t"] for r in frame(spark, texts).select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    rows = records.read(spark, manifest).orderBy("start", F.col("n_tokens")).collect()
    start = 0
    for (i, t), r in zip(order, rows, strict=True):
        own = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    again = Counter((k, tuple(x.tolist())) for k, x in records.shuffled(manifest, 1))
    assert again == Counter((i, (*enc.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in order)
    assert records.write(frame(spark, []), None, default_path()) == [] and records.read(spark, []).count() == 0


def test_records_detect_damage():
    data = records.frame(records.pack_ids(5, np.array([1, 2, 3], "<u2")))
    assert records.unpack_ids(records.unframe(data)[0])[1].tolist() == [1, 2, 3]
    for i in range(len(data)):
        with pytest.raises(records.Corrupt):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
        with pytest.raises(records.Corrupt):
            records.unframe(data[:i])


def packed(rows, texts, ids, capacity):
    enc = library()
    own = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        own[i].append([*enc.encode(t or "", add_special_tokens=False).ids, 0])
    bins = defaultdict(list)
    for r in rows:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in own[r["doc_id"]])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in rows) == sum(len(x) for v in own.values() for x in v)
    return len(bins)


def test_packing(spark):
    texts, ids = made(7), [*range(len(made(7)) - 1), 0]
    total = None
    for cell in (50_000, 40):
        rows = packing.pack_documents(frame(spark, texts, ids), default_path(), capacity=256, cell=cell).collect()
        total = packed(rows, texts, ids, 256)
        assert total <= 1.15 * -(-sum(r["length"] for r in rows) // 256) + 1 + len(rows) // 40
    assert packing.pack_documents(frame(spark, []), default_path()).collect() == []


def test_genetic_operators_keep_packings_valid():
    rng = np.random.default_rng(8)
    sizes = -np.sort(-rng.integers(1, 100, 300))
    a = packing.best_fit(sizes, np.arange(300), 100)
    b = packing.best_fit(sizes, rng.permutation(300), 100)
    for _ in range(30):
        for child in (packing.crossover(sizes, a, b, 100, rng), packing.mutate(sizes, a, 100, rng)):
            assert np.bincount(child, sizes).max() <= 100 and child.min() == 0 and len(np.unique(child)) == child.max() + 1
    best = packing.evolve(sizes, 100, 1, [], 4, 10)
    assert packing.fitness(sizes, best, 100) >= packing.fitness(sizes, a, 100)


def test_islands_go_on_where_best_fit_meets_the_bound(monkeypatch):
    """Best fit has the fewest sequences here, but several that are not full: the search is not left out."""
    sizes, runs = np.full(60, 33), []
    first = packing.best_fit(sizes, np.arange(60), 100)
    assert len(np.unique(first)) == 20 and not packing.unbeatable(sizes, first, 100)
    cross = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *x: (runs.append(1), cross(*x))[1])
    assert packing.fitness(sizes, packing.evolve(sizes, 100, 5, []), 100) >= packing.fitness(sizes, first, 100)
    assert len(runs) == packing.GENERATIONS
    runs.clear()
    full = np.array([60, 60, 40, 40, 50])
    assert packing.unbeatable(full, packing.evolve(full, 100, 5, []), 100) and not runs


def test_cells_share_what_they_leave_over(spark):
    """Ten cells of about ten pieces: alone, each would leave a sequence that is hardly filled."""
    items = spark.range(100).selectExpr("id AS uid", "id AS doc_id", "0 AS piece", "30L AS length")
    got = packing.pack(items, 100, cell=10).join(items, "uid").collect()
    assert len(got) == 100 and len({r["uid"] for r in got}) == 100
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in spans.values():
        x.sort()
        assert [a for a, _ in x] == [30 * i for i in range(len(x))] and len(x) <= 3
    assert len(spans) == 34  # three pieces in each


def test_mixing(spark):
    texts = made(9)
    docs = frame(spark, texts)
    mixed = mixing.mix(docs)
    rows = mixed.select("doc.*", F.col("size").alias("words"), "source_size", "target", "taken").collect()
    sizes = Counter()
    for r in rows:
        assert r["words"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["words"]
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = dict(zip(names, [3, 1, 2] * len(names), strict=False))
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["words"], 2 * r["words"])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r["words"] for r in rows if r["source"] == s) / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).select("doc.doc_id", "taken").collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in rows)
    plan = mixing.schedule(mixed).withColumn("p", F.spark_partition_id()).collect()
    assert sum(r["size"] for r in plan) == sum(taken.values()) and all(0 <= r["position"] <= 1 for r in plan)
    assert [r["position"] for r in plan] == sorted(r["position"] for r in plan)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_curriculum_follows_ramps(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 5), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    plan = mixing.schedule(mixing.mix(docs)).select("doc.source", "position").toPandas()
    early = plan[plan.position < 0.5].groupby("source").size() / plan.groupby("source").size()
    # the share of a ramp's integral in the first half: (1 - a / 2) / 2
    assert abs(early["s0"] - 0.375) < 0.02 and abs(early["s1"] - 0.625) < 0.02 and abs(early["s2"] - 0.5) < 0.02
    # other ramps give other positions, and another order of training
    order = lambda ramps: [tuple(r) for r in mixing.schedule(mixing.mix(docs, ramps=ramps)).select("doc.doc_id", "copy").collect()]
    one, other = order((0.5, -0.5, 0.0)), order((-0.5, 0.5, 0.9))
    assert sorted(one) == sorted(other) and one != other and len(set(one[:500]) & set(other[:500])) < 450


def test_demand_is_inverted(spark):
    rows = spark.createDataFrame([(a, 200.0, t / 20) for a in (-1.0, -0.5, 0.0, 0.3, 1.0) for t in range(21)], "a double, target double, t double")
    due = mixing.demand(F.col("t"), F.col("target"), F.col("a"))
    for r in rows.select("t", "a", mixing.when_due(due, F.col("target"), F.col("a")).alias("back"), mixing.when_due(F.lit(200.5), F.col("target"), F.col("a")).alias("late")).collect():
        assert r["back"] == pytest.approx(r["t"], abs=1e-7) and r["late"] is None


def test_mixing_does_not_depend_on_buckets(spark):
    docs = frame(spark, made(19))
    taken = [sorted(map(tuple, mixing.mix(docs, digits=d).select("doc.doc_id", "before", "taken").collect())) for d in (1, 3, 5)]
    assert taken[0] == taken[1] == taken[2]


def test_sketch(spark):
    texts = made(10)
    ids = [*range(len(texts) - 1), None]
    rows = {r["doc_id"]: r for r in sketch.fingerprints(frame(spark, texts, ids)).collect()}
    order = [(i, t or "") for i, t in sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0)))]
    exact = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    cased = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t)] for i in range(len(w) - 4)} or {tuple(w) for w in [WORD.findall(t)] if w}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = cased(t), cased(edited), cased(after)
        assert abs(r["near_edited"] - exact(a, b)) < (0.2 if len(a | b) > sketch.K else 1e-9)
        assert abs(r["near_next"] - exact(a, c)) < (0.2 if len(a | c) > sketch.K else 1e-9)
    assert len({rows[i]["fingerprint"] for i, t in order if t == texts[0]}) == 1
    assert sketch.fingerprints(frame(spark, [])).collect() == []
    one = sketch.fingerprints(frame(spark, ["a b c d e f g h i j"])).collect()[0]
    assert one["near_next"] == 1.0


def test_next_row_with_clustered_keys(spark):
    keys = [*range(50), *range(10**15, 10**15 + 50), -5, -(10**17), 3]
    rows = spark.createDataFrame([(k, f"t{j}") for j, k in enumerate(keys)], "key long, text string").repartition(5)
    got = sketch.with_next(rows, "key", ["text"], ["text"]).collect()
    order = sorted(((k, f"t{j}") for j, k in enumerate(keys)), key=lambda r: (-r[0], r[1]))
    assert {(r["key"], r["text"]): r["next_text"] for r in got} == {o: order[(i + 1) % len(order)][1] for i, o in enumerate(order)}


def test_sketch_estimates_and_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = spark.createDataFrame([(1, " ".join(words[:2000]), " ".join(words[1000:])), (2, None, "a b")], "i int, a string, b string")
    s = rows.select("i", sketch.sketch(sketch.shingle_hashes("a")).alias("a"), sketch.sketch(sketch.shingle_hashes("b")).alias("b"))
    r = s.select("*", sketch.distinct_shingles(F.col("a")).alias("d"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.resemblance(F.col("a"), F.col("b")).alias("j"), sketch.merge(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert abs(r[0]["d"] - 1996) < 600 and abs(r[0]["c"] - 0.5) < 0.2 and abs(r[0]["j"] - 1 / 3) < 0.15
    assert (r[1]["d"], r[1]["c"], r[1]["j"]) == (0.0, 1.0, 0.0)
    parts = s.select("i", F.col("a").alias("sketch")).unionByName(s.select("i", F.col("b").alias("sketch")))
    assert sketch.union_sketch(parts, ["i"]).where("i = 1").first()["sketch"] == r[0]["m"]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, rule):
    texts = [*made(11, 24), "a\n\n\nb\n", "é日\n🙂x"]
    out = defaultdict(list)
    for r in attribution.by_line(frame(spark, texts), default_path(), rule).collect():
        out[r["doc_id"]].append(r)
    tok = library()
    for i, t in enumerate(texts):
        t = t or ""
        spans = tok.encode(t, add_special_tokens=False).offsets
        rows = sorted(out[i], key=lambda r: r["section"])
        assert math.isclose(sum(r["n_tokens"] for r in rows), len(spans)) and sum(r["n_chars"] for r in rows) == len(t)
        owner = [k for k, r in enumerate(rows) for _ in range(r["n_chars"])]
        want = [0.0] * len(rows)
        for a, b in spans:
            held = Counter(owner[a:b])
            if rule == "start":
                want[owner[a]] += 1
            elif rule == "end":
                want[owner[b - 1]] += 1
            elif rule == "majority":
                want[min(held, key=lambda s: (-held[s], s))] += 1
            else:
                for s, n in held.items():
                    want[s] += n / (b - a)
        assert np.allclose([r["n_tokens"] for r in rows], want)


def test_attribution_by_field(spark):
    rows = spark.createDataFrame([(1, "title", None, "body text"), (2, "", "x", "y")], "doc_id long, a string, b string, c string")
    out = attribution.by_field(rows, default_path(), ["a", "b", "c"], "split").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section"], r["n_chars"]) for r in out] == [(1, 0, 6), (1, 1, 1), (1, 2, 9), (2, 0, 1), (2, 1, 2), (2, 2, 1)]
    tok = library()
    assert math.isclose(sum(r["n_tokens"] for r in out if r["doc_id"] == 1), len(tok.encode("title\n\nbody text").ids))
