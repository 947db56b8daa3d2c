"""Registered queries of the engine over the synthetic source, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.operators import dedup, enrich, materialize, probabilistic, resolve, rollup, search, survivorship
from kinfold.plans import pipeline
from kinfold.sources import synthetic
from kinfold.sources.base import children
from kinfold.sources.people import pivot_info
from kinfold.streaming import sync

CONFIG = ResolutionConfig()
SINCE, TODAY = "1997-01-01", "1997-06-01"
_HUBS: dict[tuple[str, str, str], pipeline.Hub] = {}


def _hub(spark: SparkSession, folder: str, upto: str = "rolled") -> pipeline.Hub:
    """The hub over a folder up to a step; saved steps are shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, folder, upto)
    if key not in _HUBS:
        source = synthetic.OrdersConnector(spark, folder)
        if upto == "staged":
            _HUBS[key] = pipeline.staged(spark, source)
        elif upto == "resolved":
            _HUBS[key] = pipeline.resolved(_hub(spark, folder, "staged"), CONFIG)
        elif upto == "enriched":
            _HUBS[key] = pipeline.enriched(_hub(spark, folder, "resolved"))
        elif upto == "rolled":
            _HUBS[key] = pipeline.rolled_up(_hub(spark, folder, "enriched"), source, CONFIG)
        elif upto == "merged":
            _HUBS[key] = pipeline.rolled_up(pipeline.merged(_hub(spark, folder, "enriched")), source, CONFIG)
        else:
            _HUBS[key] = pipeline.finalized(_hub(spark, folder, "merged"), CONFIG, "2024-01-01")
    return _HUBS[key]


def _matched(spark: SparkSession, folder: str) -> pipeline.Hub:
    """The resolved hub for a query that reads no aliases, licences and identifiers: that of the session if it has staged
    whole people, else one of people staged without these."""
    app = spark.sparkContext.applicationId
    if (app, folder, "staged") in _HUBS:
        return _hub(spark, folder, "resolved")
    key = (app, folder, "matched")
    if key not in _HUBS:
        _HUBS[key] = pipeline.resolved(pipeline.staged(spark, synthetic.OrdersConnector(spark, folder), ("aliases", "licenses", "identifiers")), CONFIG)
    return _HUBS[key]


def _day(c: str) -> str:
    return f"CAST(CAST({c} AS DATE) AS STRING) AS {c}"


# ---- queries ---------------------------------------------------------------------------------------------------------


def stage_person(spark, d):
    return _hub(spark, d, "staged").staged.selectExpr("stg_person_id", "account_id", "first_name", "middle_name", "last_name", _day("date_of_birth"), "ssn_hash", "ssn_last_four", "npi", "upin", "terminated", _day("source_modified"))


def stage_alias_unpivot(spark, d):
    return children(_hub(spark, d, "staged").staged, "aliases")


def stage_address_unpivot(spark, d):
    return children(_hub(spark, d, "staged").staged, "addresses").select("stg_person_id", "address_type", "address1", "city", "state", "zip", "is_primary")


def stage_license_unpivot(spark, d):
    return children(_hub(spark, d, "staged").staged, "licenses")


def eav_pivot_identifiers(spark, d):
    info = pivot_info(synthetic.OrdersConnector(spark, d)._sql(synthetic.INFO))
    return info.select("employee_id", F.element_at("info", "dea_number").alias("dea_number"), F.element_at("info", "mmis_number").alias("mmis_number"), F.element_at("info", "csl_number").alias("csl_number"), F.size("info").cast("long").alias("n_values"))


def ssn_blocklist(spark, d):
    return _hub(spark, d, "resolved").blocked.select("key_ssn", "people")


def _tier(tier: str) -> Callable:
    def query(spark, d):
        return _hub(spark, d, "resolved").links.where(F.col("match_key") == tier).select("stg_person_id", "identity_id")

    return query


def identity_links_full(spark, d):
    return _hub(spark, d, "resolved").links.select("stg_person_id", "identity_id", "match_key", F.col("match_score").cast("double").alias("match_score"))


def identity_keys(spark, d):
    return _hub(spark, d, "resolved").identities.selectExpr("identity_id", "ssn_hash", "npi", "upin", _day("canonical_dob"), "canonical_first", "canonical_middle", "canonical_last")


def enrich_license(spark, d):
    return _hub(spark, d, "enriched").licenses.select("identity_id", "license_number", "certification_state", "certification_board", "license_type", "link_id")


def enrich_address(spark, d):
    return _hub(spark, d, "enriched").addresses.select("identity_id", "address1", "city", "state", "zip", "is_primary", "link_id")


def enrich_identifier(spark, d):
    return _hub(spark, d, "enriched").identifiers


def dedup_by_upin(spark, d):
    hub = _hub(spark, d, "enriched")
    return dedup.by_column(resolve.identity_keys(hub.identities, hub.blocked), "key_upin")


def dedup_by_name_dob(spark, d):
    hub = _hub(spark, d, "enriched")
    return dedup.by_column(resolve.identity_keys(hub.identities, hub.blocked), "key_name")


def dedup_by_license(spark, d):
    return dedup.by_child(_hub(spark, d, "enriched").licenses, list(dedup.LICENSE_KEY))


def dedup_fixed_point(spark, d):
    return _hub(spark, d, "merged").merge_log


def rollup_credentials(spark, d):
    return _hub(spark, d).credentials.select("credential_match_id", "identity_id", "registry", "match_summary_status_code", "link_state")


def rollup_exclusions(spark, d):
    return _hub(spark, d).exclusions.select("match_id", "identity_id", "registry", "is_ssn_match", "is_npi_match", "link_state")


def _candidates(spark, d):
    hub = _hub(spark, d, "resolved")
    return survivorship.candidates(hub.staged, hub.links, hub.systems, CONFIG)


def survivorship_winner(spark, d):
    return _candidates(spark, d).where("rn = 1").select("identity_id", "field", "value", "link_id")


def attribute_provenance(spark, d):
    return survivorship.provenance(_candidates(spark, d)).select("identity_id", "field", "value", "link_id", F.col("is_winner").cast("int").alias("is_winner"))


def survivorship_audit(spark, d):
    return survivorship.audit(_candidates(spark, d))


def _profiles(spark, d):
    hub = _hub(spark, d)
    return pipeline.rebuild_profiles(hub, "2024-01-01")


def profile_counts_flags(spark, d):
    counts = [f"{c}_count" for c in ("license", "identifier", "address", "credential", "exclusion", "board_action", "resolution", "record", "account", "system")]
    return _profiles(spark, d).select("identity_id", *counts, F.col("has_active_exclusion").cast("int").alias("has_active_exclusion"))


def profile_primary_address(spark, d):
    return materialize.primary_address(_hub(spark, d, "enriched").addresses)


def profile_terminated_ssn4(spark, d):
    hub = _hub(spark, d, "resolved")
    return materialize.latest(hub.staged, hub.links)


def profile_nested_json(spark, d):
    return _profiles(spark, d).select("identity_id", *[materialize.as_json(c).alias(c) for c in ("licenses", "identifiers", "exclusions", "accounts", "aliases")])


def wide_profile(spark, d):
    return _hub(spark, d, "final").profiles


def alias_index(spark, d):
    hub = _hub(spark, d, "resolved")
    return materialize.alias_index(hub.staged, hub.links)


def alias_coverage(spark, d):
    hub = _hub(spark, d, "resolved")
    return materialize.alias_coverage(alias_index(spark, d), hub.staged, hub.links)


def identity_search_page(spark, d):
    page = search.search(_profiles(spark, d), alias_index(spark, d), "LIE", page=1, per_page=25, config=CONFIG)
    return page.rows.select("identity_id", "record_count", "first_name", "last_name")


def search_omitted_fields(spark, d):
    small = ResolutionConfig(most_json_bytes=4)  # any account at all
    return search.guarded(_profiles(spark, d), small).select("identity_id", F.array_contains("omitted_fields", "accounts").cast("int").alias("accounts_omitted"), F.col("accounts").isNull().cast("int").alias("accounts_null"))


def credential_search_best(spark, d):
    rows = search.best_credentials(_hub(spark, d).credentials, TODAY, CONFIG)
    return rows.selectExpr("identity_id", "registry", "credential_match_id", "links", _day("date_resolved"))


def block_candidates(spark, d):
    hub = _hub(spark, d, "resolved")
    return probabilistic.candidates(hub.staged, hub.staged, hub.links, CONFIG)


def hard_no_filter(spark, d):
    """All people with the candidates of their blocks."""
    hub = _hub(spark, d, "resolved")
    pairs = probabilistic.paired(hub.staged, hub.staged, hub.links, hub.identities)
    return pairs.select("stg_person_id", "identity_id", probabilistic.hard_no().cast("int").alias("barred"), probabilistic.gate().cast("int").alias("gate"))


def score_bands(spark, d):
    hub, source = _matched(spark, d), synthetic.OrdersConnector(spark, d)
    exclusions = rollup.exclusions(source.exclusions(), source.exclusion_records(), hub.links)
    pairs = probabilistic.passed(hub.staged, hub.staged, hub.links, hub.identities, enrich.places(hub.staged, hub.links), exclusions)
    value = probabilistic.score(CONFIG)
    return pairs.select("stg_person_id", "identity_id", value.alias("score"), probabilistic.band(value, CONFIG).alias("band"))


def incremental_since_watermark(spark, d):
    return sync.changed(_hub(spark, d, "staged").staged, SINCE).selectExpr("stg_person_id", _day("source_modified"))


def incremental_batch(spark, d):
    """Records of after the watermark applied to a hub that was built of those before it."""
    source = synthetic.OrdersConnector(spark, d)
    staged = _hub(spark, d, "staged")
    old = staged.staged.where(F.col("source_modified") <= F.lit(SINCE).cast("timestamp"))
    hub = pipeline.rolled_up(pipeline.enriched(pipeline.resolved(pipeline.Hub(staged.systems, old), CONFIG)), source, CONFIG)
    hub, _ = sync.apply_batch(hub, sync.changed(staged.staged, SINCE), 1, source, CONFIG)
    return hub.links.select("stg_person_id", "identity_id", "match_key", "match_state")


def resolution_quality(spark, d):
    """Pairs of records of one identity, of one person, and of both: the counts of precision and recall."""
    rows = _hub(spark, d, "resolved").links.join(synthetic.OrdersConnector(spark, d).truth(), "stg_person_id")
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")
    both = rows.groupBy("identity_id", "truth_person").agg(F.count(F.lit(1)).alias("n"))
    kinds = [(both, "both"), (both.groupBy("identity_id").agg(F.sum("n").alias("n")), "linked"), (both.groupBy("truth_person").agg(F.sum("n").alias("n")), "true")]
    out = [t.agg(pairs.alias("pairs")).select(F.lit(k).alias("kind"), "pairs") for t, k in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


def links_per_identity(spark, d):
    return _hub(spark, d, "resolved").links.groupBy("identity_id").agg(F.count(F.lit(1)).alias("links"), F.min("stg_person_id").alias("first_record"))


# ---- SQL -------------------------------------------------------------------------------------------------------------

_TABLES = {t: t for t in ("orders", "customer", "lineitem", "events")}
SOURCE = (
    "WITH employees AS MATERIALIZED ({}), lists AS ({}), info AS ({}), credential_matches AS ({}), matches AS ({}), records AS ({}),".format(
        *[s.format(**_TABLES) for s in (synthetic.EMPLOYEES, synthetic.LISTS, synthetic.INFO, synthetic.CREDENTIALS, synthetic.EXCLUSIONS, synthetic.RECORDS)]
    )
    + """
stg AS MATERIALIZED (SELECT e.id AS stg_person_id, CAST(l.account_id AS BIGINT) AS account_id, first_name, middle_name, last_name, CAST(date_of_birth AS DATE) AS date_of_birth,
  ssn_hash, ssn_last_four, CASE WHEN npi > 0 THEN npi END AS npi, upin, terminated, CAST(date_modified AS TIMESTAMP) AS source_modified
  FROM employees e LEFT JOIN lists l ON l.id = e.employeelist_id),
alias AS (
  SELECT id AS stg_person_id, 'maiden' AS alias_type, CAST(NULL AS STRING) AS first_name, maiden_name AS last_name FROM employees WHERE maiden_name IS NOT NULL
  UNION ALL SELECT id, 'alt', alt_first_name, alt_last_name FROM employees WHERE alt_first_name IS NOT NULL
  UNION ALL SELECT id, 'business', trim(business), NULL FROM employees WHERE business IS NOT NULL
  UNION ALL SELECT employee_id, 'business', trim(value), NULL FROM info WHERE name LIKE 'alt_business%' AND trim(value) <> ''),
address AS (
  SELECT id AS stg_person_id, 'primary' AS address_type, address1, city, state, zip, 1 AS is_primary FROM employees
  UNION ALL SELECT id, 'alt_1', alt_address1_1, NULL, NULL, NULL, 0 FROM employees WHERE alt_address1_1 IS NOT NULL),
license AS (
  SELECT id AS stg_person_id, certification_number AS license_number, certification_state, certification_board, license_type, 1 AS is_primary FROM employees WHERE certification_number IS NOT NULL
  UNION ALL SELECT n.employee_id, n.value, s.value, NULL, 'csl', 0 FROM info n LEFT JOIN info s ON s.employee_id = n.employee_id AND s.name = 'csl_state' WHERE n.name = 'csl_number'),
identifier AS (SELECT employee_id AS stg_person_id, CASE WHEN name = 'dea_number' THEN 'dea' ELSE 'mmis' END AS id_type, trim(value) AS id_value FROM info WHERE name IN ('dea_number', 'mmis_number')),
blocked AS MATERIALIZED (SELECT lower(trim(ssn_hash)) AS key_ssn, count(DISTINCT concat_ws('|', lower(trim(last_name)), lower(trim(first_name)), CAST(date_of_birth AS STRING))) AS people
  FROM stg WHERE ssn_hash IS NOT NULL GROUP BY 1 HAVING people > 3)"""
)


def _keys(first: str, last: str, dob: str) -> str:
    return (
        "CASE WHEN lower(trim(ssn_hash)) NOT IN (SELECT key_ssn FROM blocked) THEN lower(trim(ssn_hash)) END AS key_ssn, CAST(npi AS STRING) AS key_npi, lower(trim(upin)) AS key_upin, "
        f"CASE WHEN {first} IS NOT NULL AND {last} IS NOT NULL AND {dob} IS NOT NULL THEN concat_ws('|', lower(trim({last})), lower(trim({first})), CAST({dob} AS STRING)) END AS key_name"
    )


def _resolution() -> str:
    """The tiers as one chain of common tables, ending in `link` and `identity`."""
    filled = resolve.FILLED.items()
    fills = [(c, s) for c, s in filled if c != "dea_number"]
    out = [SOURCE, f"person AS MATERIALIZED (SELECT *, {_keys('first_name', 'last_name', 'date_of_birth')} FROM stg)"]
    none = "SELECT CAST(NULL AS BIGINT) AS stg_person_id, CAST(NULL AS BIGINT) AS identity_id, '' AS match_key, CAST(0 AS DOUBLE) AS match_score WHERE false"
    out.append(f"link0 AS ({none})")
    out.append(f"id0 AS (SELECT CAST(NULL AS BIGINT) AS identity_id, {', '.join(f'{s} AS {c}' for c, s in fills)} FROM stg WHERE false)")
    i = 0
    for ordinal, (tier, key) in enumerate(resolve.KEYED.items()):
        if tier == "dea_number":
            continue
        p, i = i, i + 1
        new = f"stg_person_id + {ordinal * resolve.SPAN}"
        out += [
            f"open{i} AS MATERIALIZED (SELECT * FROM person WHERE stg_person_id NOT IN (SELECT stg_person_id FROM link{p}))",
            f"known{i} AS MATERIALIZED (SELECT {key}, min(identity_id) AS identity_id FROM (SELECT identity_id, {_keys('canonical_first', 'canonical_last', 'canonical_dob')} FROM id{p}) WHERE {key} IS NOT NULL GROUP BY {key})",
            f"found{i} AS MATERIALIZED (SELECT {key}, min(stg_person_id) AS stg_person_id FROM open{i} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM known{i}) GROUP BY {key})",
            f"look{i} AS (SELECT * FROM known{i} UNION ALL SELECT {key}, {new} FROM found{i})",
            f"link{i} AS MATERIALIZED (SELECT * FROM link{p} UNION ALL SELECT o.stg_person_id, k.identity_id, '{tier}', CAST({CONFIG.confidence(tier)} AS DOUBLE) FROM open{i} o JOIN look{i} k ON o.{key} = k.{key})",
            f"all{i} AS (SELECT * FROM id{p} UNION ALL SELECT s.{new}, {', '.join(f's.{s}' for _, s in fills)} FROM found{i} f JOIN stg s ON s.stg_person_id = f.stg_person_id)",
            f"most{i} AS (SELECT l.identity_id, {', '.join(f'max({s}) AS m_{c}' for c, s in fills)} FROM link{i} l JOIN stg s ON s.stg_person_id = l.stg_person_id GROUP BY l.identity_id)",
            f"id{i} AS MATERIALIZED (SELECT a.identity_id, {', '.join(f'coalesce(a.{c}, m.m_{c}) AS {c}' for c, _ in fills)} FROM all{i} a LEFT JOIN most{i} m ON m.identity_id = a.identity_id)",
        ]
    base = 5 * resolve.SPAN
    out += [
        f"alone AS MATERIALIZED (SELECT * FROM person WHERE stg_person_id NOT IN (SELECT stg_person_id FROM link{i}))",
        f"link AS MATERIALIZED (SELECT * FROM link{i} UNION ALL SELECT stg_person_id, stg_person_id + {base}, 'new', CAST(1 AS DOUBLE) FROM alone)",
        f"identity AS MATERIALIZED (SELECT * FROM id{i} UNION ALL SELECT stg_person_id + {base}, {', '.join(s for _, s in fills)} FROM alone)",
        "rlicense AS (SELECT identity_id, license_number, certification_state, certification_board, max(license_type) AS license_type, min(stg_person_id) AS link_id FROM link JOIN license USING (stg_person_id) GROUP BY ALL)",
        "raddress AS (SELECT identity_id, address1, city, state, zip, max(is_primary) AS is_primary, min(stg_person_id) AS link_id FROM link JOIN address USING (stg_person_id) GROUP BY identity_id, address1, city, state, zip)",
        "ridentifier AS (SELECT identity_id, id_type, id_value, min(stg_person_id) AS link_id FROM link JOIN identifier USING (stg_person_id) GROUP BY identity_id, id_type, id_value)",
        "rcredential AS (SELECT c.id AS credential_match_id, l.identity_id, c.registry, c.match_summary_status_code, c.date_resolved, c.expiry_date, 'confirmed' AS link_state FROM credential_matches c JOIN link l ON l.stg_person_id = c.employee_id WHERE c.match_summary_status_code IS NULL OR c.match_summary_status_code NOT IN (10, 100, 85, 80))",
        "rexclusion AS (SELECT m.id AS match_id, l.identity_id, r.exclusion_list_prefix AS registry, m.is_ssn_match, m.is_npi_match, 'candidate' AS link_state FROM matches m JOIN link l ON l.stg_person_id = m.employee_id LEFT JOIN records r ON r.id = m.exclusion_record_id)",
        "value AS (" + " UNION ALL ".join(f"SELECT l.identity_id, '{f}' AS field, CAST(s.{f} AS STRING) AS value, l.stg_person_id AS link_id, s.source_modified FROM link l JOIN stg s USING (stg_person_id) WHERE s.{f} IS NOT NULL AND trim(CAST(s.{f} AS STRING)) <> ''" for f in ("first_name", "middle_name", "last_name", "date_of_birth", "ssn_hash", "npi", "upin")) + ")",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY identity_id, field ORDER BY source_modified DESC NULLS LAST, link_id) AS rn FROM value)",
        "ialias AS (SELECT DISTINCT l.identity_id, a.alias_type, a.first_name, a.last_name FROM link l JOIN alias a USING (stg_person_id))",
        "aindex AS (SELECT DISTINCT trim(last_name) AS name, identity_id, 'last' AS part FROM ialias WHERE trim(last_name) <> '' UNION SELECT DISTINCT trim(first_name), identity_id, 'first' FROM ialias WHERE trim(first_name) <> '')",
    ]
    return ",\n".join(out) + "\n"


def _soundex(c: str) -> str:
    """SQL for the American Soundex of the letters of a name."""
    letters = f"upper(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"
    codes = f"translate(left({letters}, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE left({letters}, 1) || left(regexp_replace(substr({codes}, 2), '[07]', '', 'g') || '000', 3) END"


def _norm(c: str) -> str:
    return f"nullif(trim(lower(regexp_replace({c}, '[.\\s]+', ' ', 'g'))), '')"


def _probabilistic(cap: int | None = None) -> str:
    """Blocks, pairs, filters and scores as common tables after those of the resolution, for blocks of any size or within a
    cap. Names that pass the gate are equal here, where both similarities are 1."""
    w = CONFIG.weights
    fits, join = ("", "") if cap is None else (f"\nfits AS (SELECT block FROM blk GROUP BY block HAVING count(*) <= {cap}),", " JOIN fits USING (block)")
    names = ", ".join(f"{_norm(f's.{c}_name')} AS p_{c}, {_norm(f'i.canonical_{c}')} AS i_{c}" for c in ("first", "middle", "last"))
    return _RES + f""",
blk AS MATERIALIZED (SELECT stg_person_id, {_soundex("last_name")} || '|' || coalesce(left(CAST(date_of_birth AS STRING), 4), '____') AS block FROM stg WHERE last_name IS NOT NULL),{fits}
pairs AS MATERIALIZED (SELECT DISTINCT a.stg_person_id, l.identity_id FROM blk a{join} JOIN blk b ON b.block = a.block AND b.stg_person_id <> a.stg_person_id JOIN link l ON l.stg_person_id = b.stg_person_id),
sides AS MATERIALIZED (SELECT p.stg_person_id, p.identity_id, {names}, s.date_of_birth AS p_dob, i.canonical_dob AS i_dob, s.npi AS p_npi, i.npi AS i_npi,
  lower(concat_ws(' ', s.last_name, s.first_name)) AS p_name, lower(concat_ws(' ', i.canonical_last, i.canonical_first)) AS i_name
  FROM pairs p JOIN stg s ON s.stg_person_id = p.stg_person_id JOIN identity i ON i.identity_id = p.identity_id),
filters AS MATERIALIZED (SELECT *, CAST(coalesce(year(p_dob) <> year(i_dob), false) OR coalesce(p_npi > 0 AND i_npi > 0 AND p_npi <> i_npi, false) AS INT) AS barred,
  CAST(coalesce(p_first = i_first, false) AND coalesce(p_last = i_last, false) AND (p_dob IS NULL OR i_dob IS NULL OR year(p_dob) = year(i_dob))
  AND (p_middle IS NULL OR i_middle IS NULL OR CASE WHEN length(p_middle) = 1 OR length(i_middle) = 1 THEN left(p_middle, 1) = left(i_middle, 1) ELSE p_middle = i_middle END) AS INT) AS gate FROM sides),
places AS MATERIALIZED (SELECT p.stg_person_id, p.identity_id, max(CAST(coalesce(lower(trim(a.address1)) = lower(trim(r.address1)), false) AS INT)) AS same FROM pairs p JOIN address a ON a.stg_person_id = p.stg_person_id JOIN raddress r ON r.identity_id = p.identity_id AND r.zip = a.zip GROUP BY ALL),
scores AS (SELECT f.stg_person_id, f.identity_id, round(least(jaro_winkler_similarity(p_name, i_name) * {w.name}::DOUBLE
  + CASE WHEN p_dob = i_dob THEN {w.dob}::DOUBLE WHEN year(p_dob) = year(i_dob) THEN {w.dob / 2}::DOUBLE ELSE 0 END + CASE WHEN places.same = 1 THEN {w.address}::DOUBLE ELSE 0 END
  + CASE WHEN places.same IS NOT NULL THEN {w.zip}::DOUBLE ELSE 0 END + CASE WHEN f.identity_id IN (SELECT identity_id FROM rexclusion WHERE registry IS NOT NULL) THEN {w.exclusion}::DOUBLE ELSE 0 END, 1.0::DOUBLE), 4) AS score
  FROM filters f LEFT JOIN places ON places.stg_person_id = f.stg_person_id AND places.identity_id = f.identity_id WHERE barred = 0 AND gate = 1)
"""


def _nested(name: str, rows: str, fields: dict[str, str]) -> str:
    """SQL for identity_id and the sorted rows of an identity as JSON."""
    item = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    order = ", ".join(f"{v} NULLS FIRST" for v in fields.values() if v not in ("CAST(NULL AS STRING)", "false"))
    return f"(SELECT identity_id, CAST(to_json(list({{{item}}} ORDER BY {order})) AS STRING) AS {name} FROM {rows} GROUP BY identity_id) USING (identity_id)"


_RES = _resolution()
_PASS_B, _PASS_B_CAPPED = _probabilistic(), _probabilistic(CONFIG.block_cap)
_FLAGGED = {f: f"coalesce(m.{f} = 1, false)" for f in ("is_ssn_match", "is_npi_match", "is_canonical_name_match", "is_license_number_match")}
_NESTED = {
    "licenses": _nested("licenses", "rlicense", {"number": "license_number", "state": "certification_state", "board": "certification_board", "type": "license_type", "registry": "CAST(NULL AS STRING)", "verified": "false"}),
    "identifiers": _nested("identifiers", "ridentifier", {"type": "id_type", "value": "id_value"}),
    "exclusions": _nested("exclusions", "rexclusion x JOIN matches m ON m.id = x.match_id", {"match_id": "x.match_id", "registry": "x.registry", **_FLAGGED, "link_state": "x.link_state"}),
    "accounts": "(SELECT identity_id, CAST(to_json(list(DISTINCT account_id ORDER BY account_id)) AS STRING) AS accounts FROM link JOIN stg USING (stg_person_id) WHERE account_id <> 0 GROUP BY identity_id) USING (identity_id)",
    "aliases": _nested("aliases", "ialias", {"type": "alias_type", "first": "first_name", "last": "last_name"}),
}
_DOB = "CAST(CAST({0} AS DATE) AS STRING) AS {0}"
_COUNT = lambda t, c, w="": f"(SELECT identity_id, count(*) AS n FROM {t} {w} GROUP BY identity_id) {c}"

ORACLES: dict[str, str] = {
    "stage_person": SOURCE + f" SELECT stg_person_id, account_id, first_name, middle_name, last_name, {_DOB.format('date_of_birth')}, ssn_hash, ssn_last_four, npi, upin, terminated, {_DOB.format('source_modified')} FROM stg",
    "stage_alias_unpivot": SOURCE + " SELECT * FROM alias",
    "stage_address_unpivot": SOURCE + " SELECT * FROM address",
    "stage_license_unpivot": SOURCE + " SELECT * FROM license",
    "eav_pivot_identifiers": SOURCE + " SELECT employee_id, max(CASE WHEN name = 'dea_number' THEN trim(value) END) AS dea_number, max(CASE WHEN name = 'mmis_number' THEN trim(value) END) AS mmis_number, max(CASE WHEN name = 'csl_number' THEN trim(value) END) AS csl_number, count(*) AS n_values FROM info WHERE trim(value) <> '' GROUP BY employee_id",
    "ssn_blocklist": SOURCE + " SELECT key_ssn, people FROM blocked",
    **{f"tier_{t}_link": _RES + f" SELECT stg_person_id, identity_id FROM link WHERE match_key = '{t}'" for t in ("ssn_hash", "npi", "upin", "name_dob")},
    "residual_identity": _RES + " SELECT stg_person_id, identity_id FROM link WHERE match_key = 'new'",
    "identity_links_full": _RES + " SELECT stg_person_id, identity_id, match_key, match_score FROM link",
    "links_per_identity": _RES + " SELECT identity_id, count(*) AS links, min(stg_person_id) AS first_record FROM link GROUP BY identity_id",
    "identity_keys": _RES + f" SELECT identity_id, ssn_hash, npi, upin, {_DOB.format('canonical_dob')}, canonical_first, canonical_middle, canonical_last FROM identity",
    "enrich_license": _RES + " SELECT * FROM rlicense",
    "enrich_address": _RES + " SELECT * FROM raddress",
    "enrich_identifier": _RES + " SELECT * FROM ridentifier",
    **{
        f"dedup_by_{n}": _RES + f", k AS (SELECT identity_id, {_keys('canonical_first', 'canonical_last', 'canonical_dob')} FROM identity) SELECT k.identity_id AS loser, m.survivor FROM k JOIN (SELECT {c}, min(identity_id) AS survivor FROM k WHERE {c} IS NOT NULL GROUP BY {c}) m ON m.{c} = k.{c} WHERE k.identity_id <> m.survivor"
        for n, c in (("upin", "key_upin"), ("name_dob", "key_name"))
    },
    "rollup_credentials": _RES + " SELECT credential_match_id, identity_id, registry, match_summary_status_code, link_state FROM rcredential",
    "rollup_exclusions": _RES + " SELECT * FROM rexclusion",
    "survivorship_winner": _RES + " SELECT identity_id, field, value, link_id FROM ranked WHERE rn = 1",
    "attribute_provenance": _RES + " SELECT identity_id, field, left(value, 255) AS value, link_id, CAST(rn = 1 AS INT) AS is_winner FROM ranked",
    "survivorship_audit": _RES + " SELECT identity_id, field, left(value, 500) AS winning_value, link_id AS winning_link_id, 'authority[local_employees] + recency' AS rule FROM ranked WHERE rn = 1",
    "profile_counts_flags": _RES
    + " SELECT i.identity_id, coalesce(a.n, 0) AS license_count, coalesce(b.n, 0) AS identifier_count, coalesce(c.n, 0) AS address_count, coalesce(d.n, 0) AS credential_count, coalesce(e.n, 0) AS exclusion_count, CAST(0 AS BIGINT) AS board_action_count, CAST(0 AS BIGINT) AS resolution_count, f.n AS record_count, coalesce(g.n, 0) AS account_count, CAST(1 AS BIGINT) AS system_count, CASE WHEN e.n > 0 THEN 1 ELSE 0 END AS has_active_exclusion FROM identity i"
    + "".join(f" LEFT JOIN {_COUNT(t, x)} ON {x}.identity_id = i.identity_id" for t, x in (("rlicense", "a"), ("ridentifier", "b"), ("raddress", "c"), ("rcredential", "d"), ("rexclusion", "e"), ("link", "f")))
    + " LEFT JOIN (SELECT identity_id, count(DISTINCT account_id) AS n FROM link JOIN stg USING (stg_person_id) WHERE account_id <> 0 GROUP BY identity_id) g ON g.identity_id = i.identity_id",
    "profile_primary_address": _RES + " SELECT identity_id, address1, city, state, zip FROM (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY is_primary DESC, link_id, address1 NULLS FIRST, zip NULLS FIRST) AS r FROM raddress) WHERE r = 1",
    "profile_terminated_ssn4": _RES + " SELECT identity_id, arg_max(terminated, struct_pack(m := source_modified, s := stg_person_id)) AS terminated, arg_min(ssn_last_four, stg_person_id) FILTER (WHERE ssn_last_four IS NOT NULL) AS ssn_last_four FROM link JOIN stg USING (stg_person_id) GROUP BY identity_id",
    "alias_index": _RES + " SELECT * FROM aindex",
    "alias_coverage": _RES + " SELECT (SELECT count(DISTINCT identity_id) FROM aindex WHERE part = 'last') AS indexed, (SELECT count(DISTINCT identity_id) FROM ialias WHERE trim(last_name) <> '') AS expected",
    "identity_search_page": _RES + ", n AS (SELECT identity_id, count(*) AS record_count FROM link GROUP BY identity_id) SELECT identity_id, record_count, canonical_first AS first_name, canonical_last AS last_name FROM identity JOIN n USING (identity_id) WHERE lower(trim(canonical_last)) = 'lie' OR identity_id IN (SELECT identity_id FROM aindex WHERE lower(trim(name)) = 'lie') ORDER BY record_count DESC, identity_id LIMIT 25",
    "search_omitted_fields": _RES + f" SELECT identity_id, CAST(coalesce(strlen(accounts), 2) > 4 AS INT) AS accounts_omitted, CAST(coalesce(strlen(accounts), 2) > 4 AS INT) AS accounts_null FROM identity LEFT JOIN {_NESTED['accounts']}",
    "profile_nested_json": _RES + f" SELECT identity_id, {', '.join(f"coalesce({c}, '[]') AS {c}" for c in _NESTED)} FROM identity" + "".join(f" LEFT JOIN {q}" for q in _NESTED.values()),
    "block_candidates": _PASS_B_CAPPED + " SELECT * FROM pairs",
    "hard_no_filter": _PASS_B + " SELECT stg_person_id, identity_id, barred, gate FROM filters",
    "score_bands": _PASS_B + f" SELECT stg_person_id, identity_id, score, CASE WHEN score >= {CONFIG.auto_merge_at} THEN 'auto_match' WHEN score >= {CONFIG.review_floor} THEN 'review' ELSE 'no_match' END AS band FROM scores",
    "dedup_by_license": _RES.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", lk AS MATERIALIZED (SELECT DISTINCT identity_id, struct_pack(n := license_number, s := certification_state, b := certification_board)::STRING AS k FROM rlicense), pair AS MATERIALIZED (SELECT DISTINCT a.identity_id AS a, b.identity_id AS b FROM lk a JOIN lk b ON a.k = b.k WHERE a.identity_id <> b.identity_id), reach AS (SELECT DISTINCT a, a AS b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b) SELECT a AS loser, min(b) AS survivor FROM reach GROUP BY a HAVING a <> min(b)",
    "credential_search_best": _RES + f", q AS (SELECT *, row_number() OVER (PARTITION BY identity_id, registry ORDER BY date_resolved DESC NULLS LAST, credential_match_id DESC) AS r, count(*) OVER (PARTITION BY identity_id, registry) AS links FROM rcredential WHERE match_summary_status_code IN (20, 30, 40, 45, 65, 70, 80, 85, 90) AND (expiry_date IS NULL OR expiry_date >= DATE '{TODAY}')) SELECT identity_id, registry, credential_match_id, links, {_DOB.format('date_resolved')} FROM q WHERE r = 1",
    "incremental_since_watermark": SOURCE + f" SELECT stg_person_id, {_DOB.format('source_modified')} FROM stg WHERE source_modified > TIMESTAMP '{SINCE}'",
    "resolution_quality": _RES + ", b AS (SELECT identity_id, truth_person, count(*) AS n FROM link JOIN employees e ON e.id = stg_person_id GROUP BY ALL) SELECT 'both' AS kind, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM b UNION ALL SELECT 'linked', CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM b GROUP BY identity_id) UNION ALL SELECT 'true', CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM b GROUP BY truth_person)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (stage_person, stage_alias_unpivot, stage_address_unpivot, stage_license_unpivot, eav_pivot_identifiers, ssn_blocklist)},
    **{f"tier_{t}_link": _tier(t) for t in ("ssn_hash", "npi", "upin", "name_dob")},
    "residual_identity": _tier("new"),
    **{
        f.__name__: f
        for f in (
            identity_links_full, links_per_identity, identity_keys, enrich_license, enrich_address, enrich_identifier, dedup_by_upin, dedup_by_name_dob, dedup_by_license, dedup_fixed_point,
            rollup_credentials, rollup_exclusions, survivorship_winner, attribute_provenance, survivorship_audit, profile_counts_flags, profile_primary_address, profile_terminated_ssn4, profile_nested_json,
            wide_profile, alias_index, alias_coverage, identity_search_page, search_omitted_fields, credential_search_best, block_candidates, hard_no_filter, score_bands, incremental_since_watermark,
            incremental_batch, resolution_quality,
        )
    },
}
