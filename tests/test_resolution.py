"""Micro-fixtures of staging, resolution, merging and matching."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.operators import dedup, enrich, guard, materialize, probabilistic, resolve, rollup, search, survivorship
from kinfold.plans.pipeline import Hub
from kinfold.sources.base import children
from kinfold.sources.people import stage
from kinfold.store import Store, insert_ignore, upsert
from kinfold.streaming import sync

CONFIG = ResolutionConfig()
COLUMNS = ("id", "employeelist_id", "first_name", "middle_name", "last_name", "name_suffix", "date_of_birth", "ssn_hash", "ssn_last_four", "npi", "upin", "address1", "city", "state", "zip", "certification_number", "certification_state", "certification_board", "maiden_name", "business", "terminated", "date_modified")
INFO = "employee_id long, name string, value string"


def people(spark, *rows, info=()):
    """Staged people from dicts."""
    schema = ", ".join(f"{c} {'long' if c in ('id', 'employeelist_id', 'npi') else 'string'}" for c in COLUMNS)
    employees = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], schema)
    lists = spark.createDataFrame([(1, 100), (2, 0)], "id int, account_id long")
    return stage(employees, lists, spark.createDataFrame(list(info), INFO))


def run(spark, *rows, info=(), config=CONFIG):
    staged = people(spark, *rows, info=info)
    return staged, resolve.resolve(staged, config)


def of(found):
    return {r["stg_person_id"]: (r["identity_id"], r["match_key"]) for r in found.links.collect()}


def merged(spark, staged, found):
    parts = [getattr(enrich, n)(staged, found.links) for n in ("licenses", "identifiers")]
    return dedup.merge_all(found.identities, *parts, found.blocked)


def person(i, first="ann", last="lee", dob="1970-01-02", **more):
    return {"id": i, "first_name": first, "last_name": last, "date_of_birth": dob, **more}


def test_staging_children(spark):
    row = person(1, npi=0, maiden_name=" may ", business="b1", address1="1 st", certification_number="C1", certification_state="NY", employeelist_id=1)
    info = [(1, "dea_number", "D1"), (1, "dea_number", "D0"), (1, "csl_number", "L1"), (1, "csl_state", "NJ"), (1, "alt_business3", " "), (1, "mmis_number", "M1")]
    staged = people(spark, row, person(2), info=info)
    assert [(r["npi"], r["account_id"]) for r in staged.orderBy("stg_person_id").collect()] == [(None, 100), (None, None)]
    rows = lambda n: sorted(map(tuple, children(staged, n).collect()), key=str)
    assert rows("aliases") == [(1, "business", "b1", None), (1, "maiden", None, "may")]
    assert rows("licenses") == [(1, "C1", "NY", None, None, 1), (1, "L1", "NJ", None, "csl", 0)]
    assert rows("identifiers") == [(1, "dea", "D1"), (1, "mmis", "M1")]
    assert rows("addresses") == [(1, "primary", "1 st", None, None, None, None, 1)]


def test_filler_ssn_is_blocked_and_three_people_are_not(spark):
    staged = people(spark, *[person(i, first=f"f{i}", ssn_hash="fill") for i in range(4)], *[person(10 + i, first=f"g{i}", ssn_hash="cap") for i in range(3)], person(20, first="z", ssn_hash=" "))
    assert [r["key_ssn"] for r in guard.blocklist(staged, CONFIG).collect()] == ["fill"]
    got = of(resolve.resolve(staged, CONFIG))
    assert len({got[i][0] for i in range(4)}) == 4 and len({got[10 + i][0] for i in range(3)}) == 1


def test_placeholders_are_blocked_with_a_key(spark):
    from kinfold.functions.text import ssn_candidates

    h = ssn_candidates("000-00-0000", "k")[1]
    config = ResolutionConfig(ssn_key="k")
    got = of(resolve.resolve(people(spark, person(1, ssn_hash=h), person(2, first="bob", ssn_hash=h)), config))
    assert got[1][0] != got[2][0]


def test_tier_order_and_smallest_id(spark):
    _, found = run(spark, person(1, first="a", ssn_hash="s"), person(2, first="b", npi=5), person(3, first="c", ssn_hash="s", npi=5))
    got = of(found)
    assert got[3] == (got[1][0], "ssn_hash") and got[2][0] == got[1][0]


def test_keys_filled_between_tiers(spark):
    _, found = run(spark, person(1, first="a", ssn_hash="s"), person(2, first="b", ssn_hash="S ", npi=7), person(3, first="c", npi=7))
    assert len({v[0] for v in of(found).values()}) == 1


def test_names_ignore_case_and_need_all_parts(spark):
    _, found = run(spark, person(1), person(2, first="ANN", last="Lee "), person(3, dob=None), person(4, dob=None))
    got = of(found)
    assert got[1][0] == got[2][0] and got[1][1] == "name_dob"
    assert got[3][1] == got[4][1] == "new" and got[3][0] != got[4][0]


def test_lost_key(spark):
    staged, found = run(spark, person(1, npi=1), person(2, npi=2), person(3, first="c", dob="1980-01-01", npi=2))
    out = merged(spark, staged, found)
    # 1 and 2 merge by name; the survivor keeps npi 1; 3 was linked with 2 before
    assert out.identities.count() == 1
    staged, found = run(spark, person(1, npi=1, ssn_hash="x"), person(2, npi=2, ssn_hash="x"), person(3, first="c", dob="1980-01-01", npi=2))
    assert len({v[0] for v in of(found).values()}) == 2 and merged(spark, staged, found).identities.count() == 2


def test_license_without_board_and_chain(spark):
    lic = {"certification_number": "C9", "certification_state": "NY"}
    staged, found = run(spark, person(1, first="a", dob=None, **lic), person(2, first="b", dob=None, **lic), person(3, first="c", dob=None), info=[(2, "dea_number", "D"), (3, "dea_number", "D")])
    out = merged(spark, staged, found)
    first = of(found)[1][0]
    assert [r["identity_id"] for r in out.identities.collect()] == [first]
    assert {r["survivor"] for r in out.log.collect()} == {first} and out.log.count() == 2
    licenses = dedup.repoint(enrich.licenses(staged, found.links), out.log, dedup.LICENSE_KEY)
    assert licenses.count() == 1


def test_survivors_take_what_they_lack(spark):
    staged, found = run(spark, person(1, npi=3, upin=None), person(2, upin="u2"), person(3, upin="u3", npi=4))
    row = merged(spark, staged, found).identities.first()
    assert (row["npi"], row["upin"]) == (3, "u2") or row["upin"] in ("u2", "u3")


def test_dedup_does_not_depend_on_partitions(spark):
    rows = [person(i, first=f"f{i % 7}", dob=None if i % 3 else "1970-01-01", upin=f"u{i % 5}" if i % 2 else None, npi=i % 4 or None) for i in range(40)]
    staged, found = run(spark, *rows)
    again = resolve.resolve(staged.repartition(7), CONFIG)
    assert of(found) == of(again)
    a, b = merged(spark, staged, found), merged(spark, staged.repartition(3), again)
    assert sorted(map(tuple, a.log.collect())) == sorted(map(tuple, b.log.collect()))
    assert all(r["loser"] > r["survivor"] for r in a.log.collect())


def paired(spark, p, i, same_address=True, excluded=True):
    staged = people(spark, {**p, "id": 2}, {**i, "id": 1, "address1": "1 ST", "zip": "00001"})
    links = resolve.resolve(staged.where("stg_person_id = 1"), CONFIG)
    places = enrich.addresses(staged, links.links)
    bad = spark.createDataFrame([(links.identities.first()["identity_id"], "EX")] if excluded else [], "identity_id long, registry string")
    return probabilistic.match(staged.where("stg_person_id = 2"), staged, links.links, links.identities, places, bad, CONFIG).collect()


def test_probabilistic_bands(spark):
    here = {"address1": "1 st", "zip": "00001"}
    got = paired(spark, person(2, dob="1970-05-05", **here), person(1))
    assert [(float(r["score"]), r["band"]) for r in got] == [(0.82, "review")]
    got = paired(spark, person(2, dob=None, **here), person(1, dob=None))
    assert [(float(r["score"]), r["band"]) for r in got] == [(0.72, "no_match")]
    assert paired(spark, person(2, dob="1971-01-01", **here), person(1)) == []
    assert paired(spark, person(2, dob="1970-05-05", npi=5, **here), person(1, npi=6)) == []
    dotted = paired(spark, person(2, last="St. John", **here), person(1, last="St John"))
    assert len(dotted) == 1 and dotted[0]["band"] == "review" and float(dotted[0]["score"]) > 0.9


def test_block_cap(spark):
    rows = [person(i, first=f"f{i}", dob="1970-01-01") for i in range(6)]
    staged = people(spark, *rows)
    found = resolve.resolve(staged, CONFIG)
    n = lambda cap: probabilistic.candidates(staged, staged, found.links, ResolutionConfig(block_cap=cap)).count()
    assert n(6) == 30 and n(5) == 0


def systems(spark):
    return spark.createDataFrame([(1, "local_employees", 50), (2, "verified", 10), (3, "other", 97)], "system_id int, system_code string, reliability_rank int")


def test_survivorship_order(spark):
    given = ((1, "u1", "2020"), (2, "u2", "2021"), (3, " ", "2022"), (4, "u4", "2019"), (5, "u5", "2022"))
    staged = people(spark, *[person(i, upin=u, ssn_hash="s", date_modified=f"{y}-01-01") for i, u, y in given])
    staged = staged.withColumn("system_id", F.when(F.col("stg_person_id") == 4, 2).when(F.col("stg_person_id") == 5, 3).otherwise(1))
    found = resolve.resolve(staged, CONFIG)
    rows = survivorship.candidates(staged, found.links, systems(spark), CONFIG)
    upin = lambda without: [r["value"] for r in survivorship.candidates(staged, found.links.where(~F.col("stg_person_id").isin(*without)), systems(spark), CONFIG).where("rn = 1 AND field = 'upin'").collect()]
    assert upin([9]) == ["u4"]  # the verified system outranks newer ones
    assert upin([4]) == ["u2"]  # newest of the listed system, blanks do not count; 100 - 97 ranks after it
    audit = survivorship.audit(rows).where("field = 'upin'").first()
    assert (audit["winning_value"], audit["rule"]) == ("u4", "authority[verified] + recency")
    assert survivorship.provenance(rows).where("field = 'upin' AND is_winner").count() == 1
    done = survivorship.apply(found.identities, rows, found.links).where("upin = 'u4'").first()
    assert done["record_count"] == 5


def test_rollups(spark):
    staged, found = run(spark, person(1), person(2, first="bob", dob=None))
    c = spark.createDataFrame([(i, 1, "R", "s", code, 1, 1, dt.date(2020, 1, i), None) for i, code in ((1, 20), (2, 85), (3, None), (4, 10))], "id long, employee_id long, registry string, match_summary_status string, match_summary_status_code int, match_is_valid int, current int, date_resolved date, expiry_date date")
    ids = lambda config: sorted(r[0] for r in rollup.credentials(c, found.links, config).select("credential_match_id").collect())
    assert ids(CONFIG) == [1, 3] and ids(ResolutionConfig(keep_null_codes=False)) == [1]
    m = spark.createDataFrame([(7, 1, 5, 1, 0), (8, 2, 6, None, 1)], "id long, employee_id long, exclusion_record_id long, is_ssn_match int, is_npi_match int")
    records = spark.createDataFrame([(5, "EX5")], "id long, exclusion_list_prefix string")
    first = rollup.exclusions(m, records, found.links)
    assert sorted((r["match_id"], r["registry"]) for r in first.collect()) == [(7, "EX5"), (8, None)]
    judged = first.withColumn("link_state", F.when(F.col("match_id") == 7, "rejected").otherwise(F.col("link_state")))
    again = rollup.exclusions(m, records, found.links, judged)
    assert {r["match_id"]: r["link_state"] for r in again.collect()} == {7: "rejected", 8: "candidate"}
    held = rollup.credentials(c, found.links, CONFIG)
    later = c.withColumn("match_summary_status_code", F.lit(100))
    assert rollup.drop_excluded(held, later, CONFIG).count() == 0


def hub_of(spark, staged):
    found = resolve.resolve(staged, CONFIG)
    parts = {n: getattr(enrich, n)(staged, found.links) for n in ("licenses", "addresses", "identifiers")}
    c = spark.createDataFrame([], "id long, employee_id long, registry string, match_summary_status string, match_summary_status_code int, match_is_valid int, current int, date_resolved date, expiry_date date")
    m = spark.createDataFrame([], "id long, employee_id long, exclusion_record_id long, is_ssn_match int, is_npi_match int")
    r = spark.createDataFrame([], "id long, exclusion_list_prefix string")
    return Hub(systems(spark), staged, found.links, found.identities, found.blocked, **parts, credentials=rollup.credentials(c, found.links, CONFIG), exclusions=rollup.exclusions(m, r, found.links))


def profiles_of(hub, ids=None):
    return materialize.profile(hub.identities, hub.staged, hub.links, hub.systems, hub.licenses, hub.addresses, hub.identifiers, hub.credentials, hub.exclusions, built_at="2024-01-01", ids=ids)


def test_profile_without_children_and_json_nulls(spark):
    hub = hub_of(spark, people(spark, {"id": 1}, person(2, address1="1 st", employeelist_id=2)))
    rows = {r["record_count"]: r for r in profiles_of(hub).where("last_name IS NULL").collect()}
    assert rows[1]["licenses"] == [] and rows[1]["account_count"] == 0 and rows[1]["has_active_exclusion"] is False
    text = profiles_of(hub).where("last_name = 'lee'").select(materialize.as_json("addresses").alias("a"), materialize.as_json("accounts").alias("n"), materialize.as_json("source_records").alias("s")).first()
    assert text["a"] == '[{"type":"primary","address1":"1 st","address2":null,"city":null,"state":null,"zip":null}]' and text["n"] == "[]" and '"account_id":null' in text["s"]


def test_alias_index_and_search(spark):
    hub = hub_of(spark, people(spark, person(1, maiden_name="ray", business=" "), person(2, first="bob", last="ray"), person(3, first="cy", last="ray"), person(4, first="BOB", last="Ray")))
    index = materialize.alias_index(hub.staged, hub.links)
    assert [(r["name"], r["part"]) for r in index.collect()] == [("ray", "last")]
    cover = materialize.alias_coverage(index, hub.staged, hub.links).first()
    assert cover["indexed"] == cover["expected"] == 1
    profiles = profiles_of(hub)
    page = search.search(profiles, index, "RAY")
    assert page.total == 3 and page.last_page == 1
    rows = page.rows.collect()
    assert [r["record_count"] for r in rows] == [2, 1, 1] and rows[1]["identity_id"] < rows[2]["identity_id"] and "ssn_hash" not in rows[0]
    assert {r["first_name"].lower() for r in search.search(profiles, index, "ray", "bob").rows.collect()} == {"bob", "ann"}
    seen = [r["identity_id"] for p in (1, 2, 3) for r in search.search(profiles, index, "ray", page=p, per_page=1).rows.collect()]
    assert seen == [r["identity_id"] for r in rows]
    for bad in ({"last_name": ""}, {"last_name": "x" * 101}, {"last_name": "x", "page": 0}, {"last_name": "x", "per_page": 101}):
        with pytest.raises(ValueError):
            search.search(profiles, index, **bad)
    small = search.guarded(profiles, ResolutionConfig(most_json_bytes=60)).where("record_count = 2").first()
    assert "source_records" in small["omitted_fields"] and small["source_records"] is None and small["licenses"] == []


def test_search_takes_all_identities_with_an_alias(spark):
    profiles = spark.range(2100).selectExpr("id AS identity_id", "id AS record_count", "'ann' AS first_name", "'lee' AS last_name")
    aliases = spark.range(2100).selectExpr("' Ray' AS name", "id AS identity_id", "'last' AS part")
    found = search.hits(profiles, aliases, "ray", None)
    assert found.count() == 2100 and found.agg({"record_count": "max"}).first()[0] == 2099


def test_credential_search(spark):
    hub = hub_of(spark, people(spark, person(1), person(2, first="bob")))
    i = {r["canonical_first"]: r["identity_id"] for r in hub.identities.collect()}
    rows = [(1, i["ann"], "R", 20, dt.date(2020, 1, 1), None), (2, i["ann"], "R", 30, dt.date(2021, 1, 1), dt.date(2021, 2, 1)), (3, i["ann"], "R", 0, dt.date(2023, 1, 1), None), (4, i["bob"], "R", 20, None, None)]
    c = spark.createDataFrame(rows, "credential_match_id long, identity_id long, registry string, match_summary_status_code int, date_resolved date, expiry_date date")
    r = spark.createDataFrame([(i["ann"], "credential", "1", "approved", 1)], "identity_id long, domain string, target_key string, decision string, is_current int")
    found, notes = search.credential_search(hub.identities, None, c, "R", "Ann", "LEE", "2022-01-01", ssn="123", resolutions=r)
    row = found.first()
    assert (row["credential_match_id"], row["prior_resolution"]) == (1, "approved") and notes["identities"] == 1 and notes["ssn_unavailable"]
    found, _ = search.credential_search(hub.identities, None, c, "R", "ann", "lee", "2021-01-15")
    assert found.first()["credential_match_id"] == 2
    found, _ = search.credential_search(hub.identities, None, c, "R", "ann", "lee", "2021-01-15", config=ResolutionConfig(most_links=1))
    assert found.first()["refused"] and found.first()["credential_match_id"] is None
    with pytest.raises(ValueError):
        search.credential_search(hub.identities, None, c, "", "ann", "lee", "2021-01-15")


def test_sync_binds_reviews_and_is_idempotent(spark):
    here = {"address1": "1 st", "zip": "00001"}
    hub = hub_of(spark, people(spark, person(1, npi=9, date_modified="2020-01-01", **here), person(5, first="eve", date_modified="2020-01-01")))
    first = {r["stg_person_id"]: r["identity_id"] for r in hub.links.collect()}
    hub.exclusions = spark.createDataFrame([(7, first[1], 1, "EX", 0, 0, 0, 0, 0, "candidate")], hub.exclusions.schema)
    batch = people(spark, person(2, first="x", npi=9, date_modified="2021-01-01"), person(3, dob="1970-09-09", date_modified="2021-01-01", **here), person(4, first="new", dob=None, date_modified="2021-01-01"), person(5, first="eva", date_modified="2021-01-01"))
    after, log = sync.apply_batch(hub, batch, 1, config=CONFIG)
    got = {r["stg_person_id"]: (r["identity_id"], r["match_state"]) for r in after.links.collect()}
    assert got[2] == (first[1], "auto_match") and got[3] == (first[1], "review") and got[5][0] == first[5]
    assert got[4][0] not in first.values() and got[4][0] > max(first.values())
    assert [(r["stg_person_id"], r["action"]) for r in log.collect()] == [(3, "relink")]
    assert after.profiles.where(F.col("identity_id") == first[1]).first()["record_count"] == 3
    assert after.identities.where(F.col("identity_id") == first[5]).first()["canonical_first"] == "eva"
    again, _ = sync.apply_batch(after, batch, 2, config=CONFIG)
    assert {r["stg_person_id"]: r["identity_id"] for r in again.links.collect()} == {k: v[0] for k, v in got.items()}
    assert sorted(map(str, again.profiles.drop("profile_built_at").collect())) == sorted(map(str, after.profiles.drop("profile_built_at").collect()))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/hub")
    assert not store.exists("t")
    rows = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "id int, k string, v string")
    store.write("t", rows)
    store.write("t", store.read("t").unionByName(rows))
    assert store.versions("t") == [1, 2] and store.read("t").count() == 4
    new = spark.createDataFrame([(3, None, "c"), (2, "k", "d"), (4, "n", "e"), (4, "n", "e")], rows.schema)
    assert sorted(r["v"] for r in insert_ignore(rows, new, ["k"]).collect()) == ["a", "b", "c", "e"]
    assert sorted(r["v"] for r in upsert(rows, new, ["k"]).collect()) == ["c", "d", "e"]


def test_single_records_match_by_license_before_the_name(spark):
    staged, found = run(spark, person(1, certification_number="C1", certification_state="NY"), person(2, first="zoe", certification_number="C2"), person(3, first="bob", dob="1980-01-01"))
    held = enrich.licenses(staged, found.links)
    new = people(spark, person(11, first="bob", dob="1980-01-01", certification_number="C1", certification_state="NY"), person(12, first="x", dob=None, certification_number="C2"), person(13, first="bob", dob="1980-01-01"), person(14, first="y", certification_number="C1", certification_state="NJ"))
    again = resolve.resolve(new, CONFIG, found.identities, found.links, 1, found.blocked, create=False, order=resolve.ROW_ORDER, licenses=held)
    got, first = of(again), of(found)
    assert got[11] == (first[1][0], "license_state") and got[12] == (first[2][0], "license_state") and got[13] == (first[3][0], "name_dob") and 14 not in got


def test_only_active_identities_take_part(spark):
    staged, found = run(spark, person(1, npi=5), person(2, first="b", dob="1980-01-01", upin="u"))
    gone = found.identities.withColumn("status", F.when(F.col("npi") == 5, "retired").otherwise(F.col("status")))
    again = of(resolve.resolve(people(spark, person(11, npi=5), person(12, first="c", upin="U")), CONFIG, gone, found.links, 1, found.blocked))
    assert again[11][0] != again[1][0] and again[12][0] == again[2][0]
    twice = gone.withColumn("npi", F.lit(7).cast("long"))
    out = dedup.merge_all(twice, enrich.licenses(staged, found.links), enrich.identifiers(staged, found.links), found.blocked)
    assert out.identities.count() == 2 and out.log.count() == 0


def test_pins_stay(spark):
    staged, found = run(spark, person(1, address1="a st"), person(2, first="b", address1="b st"))
    first = of(found)
    pins = spark.createDataFrame([(1, "employees", 2, first[1][0])], "system_id int, source_table string, source_id long, identity_id long")
    links = resolve.pin(found.links, pins)
    assert {r["stg_person_id"]: (r["identity_id"], r["is_pinned"]) for r in links.collect()} == {1: (first[1][0], 0), 2: (first[1][0], 1)}
    assert [r["address1"] for r in enrich.addresses(staged, links).collect()] == ["a st"]
    assert links.columns == found.links.columns


def test_long_chains_of_shared_licenses(spark):
    rows = [(i, f"L{i // 2}" if k else f"M{(i + 1) // 2}", None, None) for i in range(90) for k in (0, 1)]
    child = spark.createDataFrame(rows, "identity_id long, license_number string, certification_state string, certification_board string")
    out = dedup.by_child(child, list(dedup.LICENSE_KEY), most_rounds=20).collect()
    assert {r["loser"]: r["survivor"] for r in out} == {i: 0 for i in range(1, 90)}


def test_staging_resumes_at_its_cursors(spark, tmp_path):
    from kinfold.plans.pipeline import clear_stage_cursors, staged_in_ranges

    asked = []

    class Source:
        system_code, reliability_rank = "x", 50

        def people(self, low=None, high=None, since=None):
            asked.append((low, high))
            if high == 3 and len(asked) < 3:
                raise OSError("the source is away")
            return people(spark, *[person(i) for i in range(1, 4)]).where(F.col("stg_person_id").between(low, high))

    store, ranges = Store(spark, f"file://{tmp_path}"), [(1, 1), (2, 3)]
    with pytest.raises(OSError):
        staged_in_ranges(spark, Source(), store, ranges)
    assert staged_in_ranges(spark, Source(), store, ranges).staged.count() == 3 and asked == [(1, 1), (2, 3), (2, 3)]
    clear_stage_cursors(store)
    assert store.read("cursors").count() == 0


def test_registry_keeps_ids(spark):
    from kinfold.sources.base import systems

    made = lambda code, rank: type("C", (), {"system_code": code, "reliability_rank": rank})()
    held = systems(spark, [made("b", 1)])
    assert sorted(map(tuple, systems(spark, [made("a", 2), made("b", 9)], held).collect())) == [(1, "b", 1), (2, "a", 2)]


def test_store_keeps_two_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for i in range(4):
        store.write("t", spark.range(i)), store.write("watermark", spark.range(i))
    store.vacuum()
    assert store.versions("t") == [3, 4] and store.versions("watermark") == [1, 2, 3, 4] and store.read("t").count() == 3


def test_shards_are_those_of_crc32(spark):
    import zlib

    from kinfold.functions.text import shard_of

    rows = spark.createDataFrame([(v,) for v in ("", "a", "é|x", "123456789")], "v string")
    assert all(r["s"] == zlib.crc32(r["v"].encode()) % 7 for r in rows.select("v", shard_of(F.col("v"), 7).alias("s")).collect())
