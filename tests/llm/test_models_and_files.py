"""Checks of the vector, archive and model operators, and of the pipeline, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import ann, jaccard, lm, mixing, queries, toxicity, warc


WORDS = re.compile(r"[^\x20\x09-\x0D]+")

# ---- nearest neighbours ----------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf int, vid string")


def brute(rows, k=5, every=50):
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v, *_ in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    x = np.stack([ok[i] for i in ids])
    n = np.linalg.norm(x, axis=1)
    out = {}
    for q in (i for i in ids if i % every == 0):
        s = (x * ok[q]).sum(axis=1) / (n * np.linalg.norm(ok[q]))
        out[q] = sorted(((-round(v, 12), i) for v, i in zip(s, ids, strict=True) if i != q))[:k]
    return out


def test_ann_of_a_whole_search_is_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist(), 0, 1, "x") for i in range(160)]
    rows += [(1000 + i, rows[3][1], 0, 1, "x") for i in range(40)] + [(2000, rows[0][1], 0, 1, "x")] * 2
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 3]
    rows += [(3000 + 50 * i, v, 0, 1, "x") for i, v in enumerate(odd)] + [(None, rows[1][1], 0, 1, "x")]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, share=1.0).collect()
    want = brute(rows)
    assert {r["query_id"] for r in got} == set(want)
    for q, near in want.items():
        own = sorted((r["rank"], r["vec_id"], round(r["score"], 12)) for r in got if r["query_id"] == q)
        assert own == [(k + 1, i, -v) for k, (v, i) in enumerate(near)]


def test_ann_empty_and_fewer_than_k(spark):
    assert ann.search(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    got = ann.search(vectors(spark, [(0, [1.0, 0.0], 0, 1, "x"), (7, [1.0, 1.0], 0, 1, "x")]), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 7)]


def test_ann_ties_of_parallel_and_symmetric_vectors(spark):
    rows = [(i, [float(3 ** (i % 5) * c) for c in (1, 2, 3, 4, 0, 0, 0, 0)], 0, 1, "x") for i in range(1, 2500) if i % 50]
    rows += [(i, [float(c) for c in v], 0, 1, "x") for i, v in ((50, "12350000"), (100, "24680000"), (150, "11000000"))]
    rows += [(9000 - i, [1.0 if j in (0, 2 + i % 6) else 0.0 for j in range(8)], 0, 1, "x") for i in range(60)]
    got = ann.search(vectors(spark, rows), F.col("vec_id").isin(50, 100, 150), share=1.0).orderBy("query_id", "rank").collect()
    ids = {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in (50, 100, 150)}
    assert ids[50] == [1, 2, 3, 4, 5] and ids[100] == [1, 2, 3, 4, 5]
    want = brute(rows, every=150)
    assert [(r["vec_id"], round(r["score"], 12)) for r in got if r["query_id"] == 150] == [(i, -v) for v, i in want[150]]


def test_ann_blocks_follow_the_index_and_not_the_partitions(spark):
    rng, plans, before = np.random.default_rng(4), [], spark.conf.get("spark.sql.shuffle.partitions")
    rows = vectors(spark, [(i, rng.normal(size=8).tolist(), 0, 1, "x") for i in range(640)])
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            plan = ann.search(rows, F.col("vec_id") % 50 == 0)._jdf.queryExecution().analyzed().toString()
            plans.append([x.split("block#")[1].split(",")[1:] for x in plan.splitlines() if "RepartitionByExpression" in x])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(plans[0]) == 1 and plans[0] == plans[1]


def test_ann_streams_queries_past_a_block():
    rng = np.random.default_rng(5)
    r, q, vid = rng.normal(size=(2300, 6)), rng.normal(size=(30, 6)), rng.permutation(2300)
    r[::7] = r[0]
    place, score = ann.nearest(q, r, vid, 9)
    s = (q @ r.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(r, axis=1)
    for i in range(30):
        assert vid[place[i]].tolist() == vid[np.lexsort((vid, -np.round(s[i], 10)))[:9]].tolist() and np.allclose(score[i], s[i, place[i]])


@pytest.mark.parametrize("n", [250, 2000])
def test_ann_forest_recall(spark, n):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([rng.normal(size=(n, 32)), centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 32))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.search(rows, F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2 * n, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert hits / (2 * n // 50 * 5) >= 0.9


# ---- archives --------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, sha string, kind string, n int"


def test_warc_round_trip_with_revisits(spark):
    texts = ["<p>a</p>", "", None, "é" * 5000, "<p>a</p>", "x", "<p>a</p>"]
    rows = [(i, f"http://x/{i}\r\n", t, "s", "k", 1) for i, t in enumerate(texts)] + [(6, "http://y", "<p>a</p>", "s", "k", 1), (None, None, "x", "s", "k", 1)]
    out = warc.read(spark, warc.write(spark.createDataFrame(rows, PAGES).repartition(3))).collect()
    assert all(r["kind"] == "record" for r in out) and len(out) == len(rows)
    last = {"<p>a</p>": 6, "": 2, "é" * 5000: 3, "x": 5}
    want = Counter()
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        refers = last[t or ""] if i is None or i < last[t or ""] else None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert all(r["payload"] is not None for r in out if r["record_type"] == "response")
    assert warc.write(spark.createDataFrame([], PAGES)) == [] and warc.read(spark, []).count() == 0
    few = warc.read(spark, warc.write(spark.createDataFrame(rows, PAGES), least=9)).where("record_type = 'revisit'").count()
    assert few == 0


def test_salvage_recovers_after_any_damage():
    rng = random.Random(4)
    parts = [warc.compose(i, f"http://x/{i}", bytes([65 + i]) * (50 * i), None if i % 2 else 9, "2024-01-01T00:00:00Z") for i in range(8)]
    starts = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    assert [x[:2] for x in warc.salvage(whole)] == list(zip(starts[:-1], starts[1:], strict=True))
    for _ in range(150):
        a = rng.randrange(len(whole))
        kind = rng.choice(["flip", "cut", "insert", "drop"])
        data = {"flip": whole[:a] + bytes([whole[a] ^ 0xFF]) + whole[a + 1 :], "cut": whole[:a], "insert": whole[:a] + b"junk\x1f\x8b\x08WARC/1.1\r\n" + whole[a:], "drop": whole[:a] + whole[a + 40 :]}[kind]
        found = list(warc.salvage(data))
        at = 0
        for start, end, head, _, reason in found:
            assert start == at and end > start and (head is None) == bool(reason)
            at = end
        assert at == len(data)
        kept = {int(h["x-page-id"]) for _, _, h, _, _ in found if h}
        touched = {int(np.searchsorted(starts, p, "right")) - 1 for p in range(a, min(a + 41, len(whole)))}
        spared = set(range(8)) - (touched if kind != "cut" else set(range(min(touched), 8)))
        assert spared <= kept


def test_salvage_of_plain_records():
    raw = [zlib.decompress(warc.compose(i, "u", b"body", None, "d"), 31) for i in range(3)]
    data = raw[0] + raw[1][:-9] + raw[2]
    found = list(warc.salvage(data))
    assert [h and h["x-page-id"] for _, _, h, _, _ in found] == ["0", None, "2"]


def test_payload_digest_is_checked(spark, tmp_path):
    raw = zlib.decompress(warc.compose(1, "u", b"body", None, "d"), 31)
    bad = raw.replace(b"\r\n\r\nbody", b"\r\n\r\nBODY")
    block = bad.split(b"\r\n\r\n", 1)[1][:-4]
    old = hashlib.sha1(raw.split(b"\r\n\r\n", 1)[1][:-4]).digest()
    bad = bad.replace(warc.digest32(old).encode(), warc.digest32(hashlib.sha1(block).digest()).encode())
    (tmp_path / "a.warc").write_bytes(bad)
    row = warc.read(spark, [f"file://{tmp_path}/a.warc"]).first()
    assert (row["kind"], row["reason"]) == ("gap", "wrong payload digest")


def test_pages_with_long_urls_are_read_back(spark):
    rows = [(i, "http://x/?" + "q" * n, f"<p>{i}</p>", "s", "k", 1) for i, n in zip((0, 7, (1 << 63) - 1, -(1 << 62)), (5, 66_000, 300_000, 1_000_000), strict=True)]
    out = warc.read(spark, warc.write(spark.createDataFrame(rows, PAGES))).collect()
    assert {(r["kind"], r["page_id"], r["url"], (r["payload"] or b"").decode()) for r in out} == {("record", i, u, t) for i, u, t, *_ in rows}


def test_hostile_headers_are_gaps_or_nulls(spark, tmp_path):
    raw = zlib.decompress(warc.compose(5, "u", b"body", None, "d"), 31)
    length = next(x for x in raw.split(b"\r\n") if x.startswith(b"Content-Length"))
    gaps = [raw.replace(length, b"Content-Length: " + x) for x in ("²".encode(), b"9" * 5000, b"-5", b"", b"1e3", "٣".encode())] + [raw.replace(b"WARC-Date: d", b"WARC-Date d")]
    sha = lambda x, y: re.sub(rb"(WARC-(Payload|Block)-Digest): sha1:", lambda m: m[1] + b": " + x + b":", y)
    fine = [raw.replace(b"X-Page-ID: 5", b"X-Page-ID: " + x) for x in (b"abc", b"9" * 5000, "²".encode())] + [sha(b"sha256", raw), sha(b"md5", raw)]
    fine += [raw.replace(b"Digest: sha1:" + warc.digest32(d).encode(), b"Digest: SHA1:" + d.hex().encode()) for d in [hashlib.sha1(b"body").digest()]]
    for k, (data, kinds) in enumerate([(gaps, ["gap"]), (fine, ["record"])]):
        for j, x in enumerate(data):
            (tmp_path / f"{k}-{j}.warc").write_bytes(x)
            out = warc.read(spark, [f"file://{tmp_path}/{k}-{j}.warc"]).collect() if j < 3 else None
            found = list(warc.salvage(x))
            assert [h is None for _, _, h, _, _ in found] == [kinds == ["gap"]]
            assert out is None or ([r["kind"] for r in out] == kinds and [r["page_id"] for r in out] == [None])
    assert warc.number("9223372036854775808") is None and warc.number("-9223372036854775808") == -(1 << 63) and warc.number("1²") is None
    paths = [f"file://{tmp_path}/1-{j}.warc" for j in range(3, len(fine))]
    assert [(r["kind"], r["page_id"], r["payload_digest"]) for r in warc.read(spark, paths).collect()] == [("record", 5, warc.digest32(hashlib.sha1(b"body").digest()))] * 3


def test_members_of_many_records(spark, tmp_path):
    raw = [zlib.decompress(warc.compose(i, "u", b"body %d \x1f\x8b\x08" % i, None, "d"), 31) for i in range(5)]
    gz = lambda x: (c := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(x) + c.flush()
    alone = warc.compose(9, "u", b"alone", None, "d")
    whole, bad = gz(b"".join(raw)), gz(raw[0] + raw[1].replace(b"body", b"BODY") + raw[2])
    found = list(warc.salvage(whole + alone + bad + gz(b"none") + alone))
    assert [h and h["x-page-id"] for _, _, h, _, _ in found] == [*"01234", "9", "0", None, "2", None, "9"]
    assert all((h is None) == bool(reason) for _, _, h, _, reason in found)
    spans = list(dict.fromkeys(x[:2] for x in found))
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[0] == (0, len(whole))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    out = warc.read(spark, [f"file://{tmp_path}/a.warc.gz"]).collect()
    assert [(r["kind"], r["page_id"], r["payload"]) for r in out] == [("record", i, b"body %d \x1f\x8b\x08" % i) for i in range(5)]


# ---- models ----------------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=600):
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "abdefg" for b in ("en", "or", "ti", "la") for c in ("s", "n", "rt", "")]
    bad = {"en": ["grok", "vile"], "fr": ["mauxvis", "mauxlor"]}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        toxic = rng.random() < 0.3
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad[lang]) + rng.choice(["", ".", "!"])
        docs.append((i, " ".join(w), lang, "s", 1, 9.0)), labels.append((i, 1, int(toxic)))
    docs += [(n, None, None, None, 1, 9.0), (n + 1, "", "xx", "s", 1, 9.0), (0, docs[0][1], "en", "s", 1, 9.0)]
    labels += [(n, None, None), (1, 1, labels[1][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, toxic int, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_toxicity_held_out(spark):
    docs, labels, rows, marks = toxic_corpus(spark)
    model = toxicity.train(docs, labels, usable=~queries.held_out())
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    got, y = {r["doc_id"]: r["score"] for r in out}, dict((i, t) for i, _, t in marks if t is not None)
    held = [i for i in y if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(y[i]) for i in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert got[600] == got[601] and 0 <= got[600] < toxicity.THRESHOLD
    assert set(model.thresholds) <= {"en", "fr"} and all(0 < t < 1 for t in model.thresholds.values())
    with_all = toxicity.score(docs, model, keep=docs.columns[:4])
    assert with_all.columns == ["doc_id", "text", "lang", "source", "score"]


def test_toxicity_without_labels_of_both_kinds(spark):
    docs, labels, _, _ = toxic_corpus(spark, 30)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    model = toxicity.train(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_keeps_all_other_rows_beside_a_long_text(spark, monkeypatch):
    docs, labels, rows, marks = toxic_corpus(spark)
    first = min((i for i, _, t in marks if t is not None), key=lambda i: (zlib.crc32(str(i).encode()), i))
    monkeypatch.setattr(toxicity, "MOST_CHARS", 2 * sum(len(r[1] or "") for r in rows))
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("enort "), toxicity.MOST_CHARS)).otherwise(F.col("text")))
    fitted = []
    fit = toxicity.Model.fit
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, texts, y: (fitted.append((texts, y)), fit(self, texts, y)))
    model = toxicity.train(long, labels)
    texts, y = fitted[0]
    assert model.constant is None and sum(map(len, texts)) <= toxicity.MOST_CHARS
    assert len(texts) >= 480 and {r[1] for r in rows[:600] if r[0] != first} >= {t for t in texts if len(t) < 2000} and 0 < y.mean() < 1
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in marks if t is not None) / len(marks) > 0.95


def test_toxicity_samples_labels_that_have_a_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_POSITIVE", 50), monkeypatch.setattr(toxicity, "MOST_NEGATIVE", 50)
    docs, labels, _, _ = toxic_corpus(spark)
    absent = spark.range(10_000, 30_000).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic")
    fitted = []
    fit = toxicity.Model.fit
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, texts, y: (fitted.append(y), fit(self, texts, y)))
    assert toxicity.train(docs, labels.unionByName(absent)).constant is None and 70 <= len(fitted[0]) <= 100


def test_toxicity_thresholds_are_of_all_labelled_rows(spark, monkeypatch):
    """The sample is small and half toxic, the table is not; a rare language has few labels."""
    monkeypatch.setattr(toxicity, "MOST_POSITIVE", 60), monkeypatch.setattr(toxicity, "MOST_NEGATIVE", 60)
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        lang = "zz" if i % 300 < 2 else rng.choice(["en", "fr"])
        toxic = int(i % 300 == 0 if lang == "zz" else rng.random() < 0.08)
        vile = rng.random() < (0.85 if toxic else 0.05 if lang == "en" else 0.1)
        rows.append((i, " ".join(["vile"] * vile + [f"w{rng.randrange(40)}" for _ in range(15)]), lang, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    out = toxicity.score(docs, model, keep=["lang", "toxic"]).withColumn("limit", toxicity.threshold_of(model, F.col("lang"))).toPandas()
    assert set(model.thresholds) == {"en", "fr", "zz"}
    f1 = lambda t, said: 2 * (said & (t["toxic"] == 1)).sum() / (said.sum() + t["toxic"].sum())
    for t, at in [(out, toxicity.THRESHOLD), *[(g, g["limit"]) for _, g in out.groupby("lang")]]:
        assert f1(t, t["score"] >= at) >= max(f1(t, t["score"] >= c) for c in t["score"].unique()) - 0.01


def test_longest_text():
    for lengths, most in (([5, 1, 9], 15), ([5, 1, 9], 12), ([5, 1, 9], 4), ([0, 0], 3), ([], 3), ([50], 10)):
        n = toxicity.longest_text(lengths, most)
        assert sum(min(x, n) for x in lengths) <= most
        assert n >= max(lengths, default=0) or sum(min(x, n + 1) for x in lengths) > most


def test_convolution_equals_plain_loops():
    m = toxicity.Model(1)
    rng = np.random.default_rng(3)
    for b in m.bias.values():
        b[:] = rng.normal(0, 0.2, len(b))
    texts = ["a bb, ccc dddd eeeee", "", "one", "x y", "(Word) word"]
    index, at, names = toxicity.tokens(pa.array(texts))
    own, grams, counts = toxicity.word_rows(names)
    e = m.vectors(own, grams, counts)
    got, places = m.pooled(e, index, at, where=True)
    stops = np.cumsum(counts)
    for i in range(len(texts)):
        words = index[at[i] : at[i + 1]]
        vec = [m.table[own[w]] + (m.table[grams[stops[w] - counts[w] : stops[w]]].mean(axis=0) if counts[w] else 0) for w in words]
        want = []
        for width, taps in m.taps.items():
            values = [sum(vec[p + k] @ taps[k] for k in range(width)) + m.bias[width] for p in range(len(words) - width + 1)]
            want.append(np.maximum(np.max(values, axis=0), 0) if values else np.zeros(taps.shape[2]))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-5)


def test_best_threshold():
    assert 0.4 < toxicity.best_threshold(np.array([0.9, 0.8, 0.4, 0.1]), np.array([1.0, 1, 0, 0])) < 0.8


def lm_corpus(spark, n=400):
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 60}" for j in range(3)] for i in range(60)}
    texts = []
    for _ in range(n):
        w = [f"w{rng.randrange(60)}"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        texts.append(" ".join(w))
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, " \n", texts[0]])], "doc_id long, text string, key string").repartition(4)


def test_pseudo_likelihood(spark):
    texts, docs = lm_corpus(spark)
    scorer = lm.train(docs, rounds=6, batch_size=32)
    out = {r["doc_id"]: r for r in lm.score(docs, scorer).collect()}
    n = len(texts)
    assert (out[n]["n_tokens"], out[n]["log_likelihood"], out[n]["mean_log_prob"]) == (0, 0.0, None) and out[n + 1]["n_tokens"] == 0
    assert out[n + 2]["log_likelihood"] == pytest.approx(out[0]["log_likelihood"])
    # against plain loops
    v, w = scorer.v, scorer.net.w
    b, _ = lm.buckets(pa.array([texts[0]]))
    total = 0.0
    for i in range(len(b)):
        h = w["hid"].astype(float)
        for p, d in enumerate((-2, -1, 1, 2)):
            j = i + d
            h = h + w["emb"][v.ids[b[j]] if 0 <= j < len(b) else lm.BORDER].astype(float) @ w["into"][p]
        z = np.tanh(h) @ w["out"] + w["bias"]
        total += z[v.classes[b[i]]] - z.max() - np.log(np.exp(z - z.max()).sum()) + v.within[b[i]]
    assert out[0]["log_likelihood"] == pytest.approx(total, abs=0.01)  # in single precision
    # both sides help: better than counts alone, and than the same words in random order
    counts = np.bincount(lm.buckets(pa.array([" ".join(texts)]))[0], minlength=lm.BUCKETS) + lm.SMOOTH
    unigram = np.log(counts / counts.sum())
    assert sum(out[i]["log_likelihood"] for i in range(n)) > sum(unigram[lm.buckets(pa.array([t]))[0]].sum() for t in texts) + n
    mixed = texts[0].split()
    random.Random(1).shuffle(mixed)
    again = lm.score(spark.createDataFrame([(0, " ".join(mixed))], "doc_id long, text string"), scorer).first()
    assert again["log_likelihood"] < out[0]["log_likelihood"]


def test_pseudo_likelihood_probabilities_sum_to_one(spark):
    _, docs = lm_corpus(spark, 20)
    v = lm.train(docs, rounds=1).v
    assert np.allclose(np.bincount(v.classes, np.exp(v.within), lm.CLASSES)[np.unique(v.classes)], 1)
    assert lm.score(docs.limit(0), lm.train(docs.limit(0))).collect() == []


def test_pseudo_likelihood_trains_on_every_word(spark):
    texts, docs = lm_corpus(spark, 30)
    bucket, at = lm.buckets(pa.array([*texts, "", "a"]))
    for rounds in (1, lm.ROUNDS, 6):
        assert sorted(np.concatenate([lm.targets(bucket, at, turn, rounds) for turn in range(rounds)])) == list(range(len(bucket)))
    assert lm.train(docs).trained == 31 * 60


def test_pseudo_likelihood_step_follows_the_gradient():
    rng = np.random.default_rng(7)
    net = lm.Network(np.zeros(lm.CLASSES, np.float32))
    net.w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in net.w.items()}
    around, target = rng.integers(0, 6, (40, 2 * lm.SIDE)), rng.integers(0, lm.CLASSES, 40)
    around[:3] = lm.BORDER

    def loss(w):
        h = np.tanh(sum(w["emb"][around[:, p]] @ w["into"][p] for p in range(2 * lm.SIDE)) + w["hid"])
        z = h @ w["out"] + w["bias"]
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(40), target]).mean())

    old = {k: v.copy() for k, v in net.w.items()}
    net.step(around, target, {k: np.full(v.shape, 1e12) for k, v in net.w.items()})
    for k, v in old.items():
        move = (net.w[k] - v) * 1e6 / -lm.RATE
        for i in [tuple(rng.integers(0, s) for s in v.shape) if k != "emb" else (int(rng.choice([*range(6), lm.BORDER])), int(rng.integers(0, lm.DIM))) for _ in range(6)]:
            up, down = ({**old, k: (c := v.copy(), c.__setitem__(i, c[i] + d))[0]} for d in (1e-5, -1e-5))
            assert move[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-6)


def test_pseudo_likelihood_of_a_very_long_text(spark):
    _, docs = lm_corpus(spark, 20)
    long = spark.createDataFrame([(5000, "w1 w2 " * 400_000)], "doc_id long, text string")
    scorer = lm.train(docs.select("doc_id", "text").unionByName(long))
    row = lm.score(long, scorer).first()
    assert row["n_tokens"] == 800_000 and -8 < row["mean_log_prob"] < 0


def test_pseudo_likelihood_beats_counts_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scorer = lm.train(docs)
    got = lm.score(docs, scorer).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    words = [w for (t,) in docs.select("text").collect() for w in WORDS.findall(t or "")]
    count = Counter(words)
    unigram = sum(n * np.log(n / len(words)) for n in count.values()) / len(words)
    unigram += scorer.words.known  # the share that unknown words have
    print("mean log-probability of a word:", got[0] / got[1], "by the counts of this very corpus:", unigram)
    assert got[1] == len(words) and got[0] / got[1] > unigram


def test_pseudo_likelihood_knows_words_apart_in_a_bucket(spark, monkeypatch):
    texts, docs = lm_corpus(spark, 60)
    of = lambda w: int(lm.buckets(pa.array([w]))[0][0])
    names = [f"j{i}" for i in range(300_000)]
    same = np.array(names)[lm.buckets(pa.array([" ".join(names)]))[0] == of("w7")].tolist()
    rare, junk = same[:2]
    corpus = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, f"{rare} w1")], "doc_id long, text string"))
    asked = spark.createDataFrame([(i, f"w3 {w} w9") for i, w in enumerate(("w7", rare, junk))], "doc_id long, text string")
    count = Counter(" ".join([*texts, texts[0], f"{rare} w1"]).split())
    unknown = (sum(n == 1 for n in count.values()) + 1) / (sum(count.values()) + 2)
    in_bucket = sum(n for w, n in count.items() if of(w) == of("w7"))
    share = [(1 - unknown) * count["w7"] / in_bucket, (1 - unknown) / in_bucket, unknown]
    got = []
    for most in (lm.FREQUENT, 10):
        monkeypatch.setattr(lm, "FREQUENT", most)
        scorer = lm.train(corpus)
        assert scorer.words.table.count() == len(count) and len(scorer.words.words) <= min(most, len(count)) and (most < 100 or len(scorer.words.words) == len(count))
        got.append([r["log_likelihood"] for r in lm.score(asked, scorer).orderBy("doc_id").collect()])
    # the network sees the same bucket, so only the shares of the bucket differ
    assert got[0] == pytest.approx(got[1]) and np.diff(got[0]) == pytest.approx(np.diff(np.log(share)))


# ---- registry and pipeline -------------------------------------------------------------------------------------------


def test_oracles(spark, data):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, data)
        found = con.execute(sql)
        cols = [d[0] for d in found.description]
        assert sorted(cols) == sorted(df.columns)
        key = next(i for i, c in enumerate(cols) if c in ("doc_id", "page_id"))
        want = {r[key]: r for r in found.fetchall()}
        got = df.collect()
        assert len(got) == len(want) > 0
        for r in got:
            assert [r[c] for c in cols] == pytest.approx(list(want[r[cols[key]]]), nan_ok=True)


def test_curriculum_takes_what_the_schedule_holds(spark, data, monkeypatch):
    written = {}
    monkeypatch.setattr(mixing, "save", lambda df, name, save=mixing.save: written.setdefault(name, save(df, name)))
    rows = {r["doc_id"]: r for r in queries.op3_mix_curriculum(spark, data).collect()}
    plan = written["mix-schedule"].orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()
    at = [r["position"] for r in plan]
    assert at == sorted(at) and len(at) > 0 and all(0 <= t <= 1 for t in at)
    names = {r["row"]: r["doc_id"] for r in written["mix-rows"].select("row", "doc.doc_id").collect()}
    left = {i: r["taken"] for i, r in rows.items()}
    for r in plan:
        left[names[r["row"]]] -= r["size"]
        assert r["position"] == rows[names[r["row"]]]["first_position" if r["copy"] == 0 else "last_position"]
    assert set(left.values()) == {0}


def test_curriculum_of_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "a b c", "s"), (2, None, "s"), (2, None, "s"), (3, "", None), (4, "a " * 50, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = lambda df: Counter((r["doc"]["doc_id"], r["source"], r["size"], r["before"], r["taken"]) for r in df.collect())
    assert counted(mixing.curriculum(docs)) == counted(mixing.mix(docs)) and mixing.curriculum(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    scored, model = queries.toxicity_scores(spark, data, docs, keep=["doc_id", "lang"])
    kept = corpus_pipeline.drop_toxic(spark, docs, data).cache()
    scores = {r["doc_id"]: (r["score"], r["lang"]) for r in scored.collect()}
    assert scores == {r["doc_id"]: (pytest.approx(r["score"]), r["lang"]) for r in toxicity.score(docs, model, keep=["doc_id", "lang"]).collect()}
    limit = lambda lang: model.thresholds.get(lang, toxicity.THRESHOLD)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, (s, lang) in scores.items() if s < limit(lang)}
    single = corpus_pipeline.drop_near_copies(spark, kept, data).cache()
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.join(kept).collect()}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(groups.values())
    mixed = corpus_pipeline.mix_sources(spark, single, data).cache()
    taken = {r["doc_id"]: r["n"] for r in mixing.mix(single).select("doc.doc_id", F.size("positions").alias("n")).collect() if r["n"]}
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == taken
    rows = corpus_pipeline.pack(spark, mixed, data).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == taken
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "mixing", "packing"]


def test_pipeline_on_odd_tables(spark, data, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "word " * 5000, "de", None, 25000)]
    # columns beyond those of documents may have any name
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, doc string, kept_id long, _text string"
    rows = [(*r, 1.0, 2, "d", 3, "t") for r in rows]
    for k, part in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) > 0) == bool(part)
