"""Every registered query of the engine against its DuckDB SQL, and the stream against the batch."""

import collections

import duckdb
import pytest

from kinfold.config import ResolutionConfig
from kinfold.functions.text import jaro_winkler_one
from kinfold.operators import probabilistic, resolve
from kinfold.plans import catalog, pipeline
from kinfold.plans.pipeline import Hub, backfill
from kinfold.sources.synthetic import OrdersConnector
from kinfold.store import Store
from kinfold.streaming import sync

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, data, oracle, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) if name in catalog.ORACLES else df.count()
    if name not in catalog.ORACLES:
        assert got > 0
        return
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
    assert got == want


def test_some_accounts_are_omitted(spark, data):
    assert {r["accounts_omitted"] for r in catalog.QUERIES["search_omitted_fields"](spark, data).collect()} == {0, 1}


def test_known_totals(spark, data):
    links = catalog.QUERIES["identity_links_full"](spark, data)
    counts = {r["match_key"]: r["count"] for r in links.groupBy("match_key").count().collect()}
    assert counts == {"ssn_hash": 495, "npi": 252, "upin": 68, "name_dob": 544, "new": 141}
    assert links.select("identity_id").distinct().count() == 379


def test_backfill_store_and_sync(spark, data, tmp_path):
    store = Store(spark, f"file://{tmp_path}/hub")
    source = OrdersConnector(spark, data)
    hub = backfill(spark, source, built_at="2024-01-01", store=store)
    assert hub.profiles.count() == hub.identities.count()
    assert hub.links.count() == hub.staged.count() == hub.links.join(hub.identities, "identity_id", "left_semi").count()
    before = len(store.versions("links"))
    sync.sync(store, source)  # nothing has changed since
    assert len(store.versions("links")) == before


def test_stream_applies_a_batch_once(spark, data, tmp_path):
    source = OrdersConnector(spark, data)
    store = Store(spark, f"file://{tmp_path}/hub")
    people = source.people()
    folder = f"file://{tmp_path}/people"
    people.where("stg_person_id >= 1000").coalesce(1).write.parquet(folder)

    class Early(OrdersConnector):
        def people(self, low=None, high=None, since=None):
            return super().people(low, 999, since)

    backfill(spark, Early(spark, data), built_at="2024-01-01", store=store)
    arriving = spark.readStream.schema(people.schema).parquet(folder)
    sync.stream(arriving, store, f"file://{tmp_path}/check").awaitTermination()
    hub = Hub.load(store)
    n = hub.links.count()
    assert n == people.count() and hub.links.select("stg_person_id").distinct().count() == n
    assert hub.profiles.count() == hub.profiles.select("identity_id").distinct().count()


def test_probabilistic_queries_ask_for_all_people(spark, data):
    """Candidates, exclusions, gate, score and band of every person, against plain loops over all pairs."""
    hub = catalog._hub(spark, data)
    people = {r["stg_person_id"]: r for r in hub.staged.collect()}
    identity = {r["identity_id"]: r for r in hub.identities.collect()}
    of = {r["stg_person_id"]: r["identity_id"] for r in hub.links.collect()}
    places, excluded = collections.defaultdict(set), {r["identity_id"] for r in hub.exclusions.collect() if r["registry"] is not None}
    key = lambda v: (v or "").strip().lower() or None
    norm = lambda v: " ".join((v or "").replace(".", " ").split()).lower() or None
    for r in hub.addresses.collect():
        places[r["identity_id"]].add((key(r["address1"]), r["zip"]))
    blocks = collections.defaultdict(list)
    for i, r in people.items():
        if r["block_key"] is not None:
            blocks[r["block_key"]].append(i)
    pairs = {(i, of[o]) for b in blocks.values() if len(b) <= catalog.CONFIG.block_cap for i in b for o in b if o != i}
    w, filters, scores = catalog.CONFIG.weights, {}, {}
    for i, k in pairs:
        p, q = people[i], identity[k]
        mine, theirs = p["date_of_birth"], q["canonical_dob"]
        years = mine is not None and theirs is not None and mine.year != theirs.year
        npis = (p["npi"] or 0) > 0 and (q["npi"] or 0) > 0 and p["npi"] != q["npi"]
        names = [(norm(p[f"{c}_name"]), norm(q[f"canonical_{c}"])) for c in ("first", "last", "middle")]
        (m, n), suffixes = names[2], (norm(p["name_suffix"]), norm(q["canonical_suffix"]))
        middle = not m or not n or (m[0] == n[0] if 1 in (len(m), len(n)) else m == n)
        gate = all(a is not None and a == b for a, b in names[:2]) and middle and (None in suffixes or suffixes[0] == suffixes[1]) and not years
        filters[i, k] = (int(years or npis), int(gate))
        if years or npis or not gate:
            continue
        full = [" ".join(v for v in x if v is not None).lower().encode() for x in ((p["last_name"], p["first_name"]), (q["canonical_last"], q["canonical_first"]))]
        dob = 0.0 if mine is None or theirs is None else w.dob if mine == theirs else w.dob / 2
        at = {(key(a["address1"]), a["zip"]) for a in p["addresses"] if a["zip"] is not None}
        same, zips = any(a in places[k] for a in at if a[0]), {a[1] for a in at} & {z for _, z in places[k]}
        scores[i, k] = round(min(jaro_winkler_one(*full) * w.name + dob + w.address * same + w.zip * bool(zips) + w.exclusion * (k in excluded), 1.0), 4)
    found = catalog.block_candidates(spark, data).collect()
    assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs
    assert {(r["stg_person_id"], r["identity_id"]): (r["barred"], r["gate"]) for r in catalog.hard_no_filter(spark, data).collect()} == filters
    out = {(r["stg_person_id"], r["identity_id"]): (r["score"], r["band"]) for r in catalog.score_bands(spark, data).collect()}
    assert {k: v for k, (v, _) in out.items()} == pytest.approx(scores)
    assert all(b == ("auto_match" if v >= 0.92 else "review" if v >= 0.75 else "no_match") for v, b in out.values())
    assert {b for _, b in out.values()} == {"auto_match", "review", "no_match"}
    assert {i % 5 == 0 for i, _ in out} == {True, False} and {b for b, _ in filters.values()} == {0, 1}


@pytest.mark.parametrize(("name", "key"), [("hard_no_filter", "block"), ("score_bands", "first_name")])
def test_pairs_are_made_last_and_never_moved(spark, data, name, key):
    """Pairs are by far the most rows: both sides bring all that is asked of them, and the score's pairs meet by name."""
    lines = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert key in lines[join] and not any("Exchange" in x or "Aggregate" in x for x in lines[:join])


def test_scores_stage_and_save_only_what_they_read(spark, data, monkeypatch):
    """The scores alone, without the hub of the session: the same rows, of people without children that no score reads, in
    one saved step a tier and without Python."""
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected, saved = rows(catalog.score_bands(spark, data)), []

    def kept(df, name, save=resolve.save):
        saved.append((name, df.columns))
        return save(df, name)

    monkeypatch.setattr(catalog, "_HUBS", {})
    monkeypatch.setattr(resolve, "save", kept)
    monkeypatch.setattr(pipeline, "save", kept)
    out = catalog.score_bands(spark, data)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == expected
    assert [n for n, _ in saved] == ["staged", "blocked", "people", *["identities"] * 4, "links", "identities"]
    assert not {"aliases", "licenses", "identifiers"} & {*saved[0][1]}


def test_bounds_reach_the_scan_of_dealt_orders(spark, data):
    """Orders are dealt out before they are made into people, and only those of the bounds."""
    plan = OrdersConnector(spark, data).people(10, 99)._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("REPARTITION_BY_COL"):]
    assert "GreaterThanOrEqual(o_orderkey,10)" in dealt and "LessThanOrEqual(o_orderkey,99)" in dealt


def test_people_of_declined_blocks_are_not_dealt_by_block(spark, data):
    """Blocks over the cap are left out before people are moved, so those of a common surname never meet in one task."""
    people, config = catalog._hub(spark, data, "staged").staged.select("stg_person_id", "block_key"), ResolutionConfig(block_cap=9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fit = probabilistic.fitting(people, people, config)
        plan = fit._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("hashpartitioning(block_key") == 1 and "SortMergeJoin" not in plan
    rows = people.collect()
    sizes = collections.Counter(r["block_key"] for r in rows)
    kept = sorted(r["stg_person_id"] for r in rows if r["block_key"] is not None and sizes[r["block_key"]] <= 9)
    assert sorted(r["stg_person_id"] for r in fit.collect()) == kept and 0 < len(kept) < len(rows)


@pytest.fixture(scope="module")
def crowd(data, tmp_path_factory):
    """Tables of five customers with one surname and birth year: more of their orders are in one block than the cap has."""
    folder, con = tmp_path_factory.mktemp("crowd"), duckdb.connect()
    who = f"({[c for c in range(1, 200_000, 97) if c * 37 % 18_000 < 365][:5]})[1 + {{}} % 5]"
    for t, new in (("orders", f"o_orderkey + k * 1500 AS o_orderkey, {who.format('o_orderkey')} AS o_custkey"), ("customer", f"{who.format('c_custkey')} AS c_custkey"), ("events", "event_id + k * 1000 AS event_id")):
        of = f"SELECT x.* REPLACE ({new}) FROM '{data}/{t}.parquet' x, range({1 if t == 'customer' else 2}) r(k)"
        con.execute(f"COPY ({of}{' WHERE c_custkey < 5' if t == 'customer' else ''}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["hard_no_filter", "score_bands"])
@pytest.mark.parametrize("part", [2048, 50])
def test_people_of_large_blocks_are_asked_for(spark, crowd, monkeypatch, name, part):
    """All people of a block over the cap have their candidates, as in the SQL, each once however they are dealt."""
    folder, con = crowd
    monkeypatch.setattr(probabilistic, "PART", part)
    blocks = collections.defaultdict(set)
    for r in catalog._hub(spark, folder, "staged").staged.where("block_key IS NOT NULL").select("block_key", "stg_person_id").collect():
        blocks[r[0]].add(r[1])
    large = max(blocks.values(), key=len)
    assert len(large) > catalog.CONFIG.block_cap
    df = catalog.QUERIES[name](spark, folder)
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    got = collections.Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got == collections.Counter(found.fetchall())
    assert large <= {r[names.index("stg_person_id")] for r in got}
