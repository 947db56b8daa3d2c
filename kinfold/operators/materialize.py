"""The wide profile of each identity and the index of alias names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.rollup import FLAGS
from kinfold.sources.base import children

BOARD = "identity_id long, registry string, action_type string, action_date date, resolution_date date"
RESOLUTION = "identity_id long, domain string, target_key string, decision string, resolved_by string, resolved_at timestamp, is_auto_resolvable int, is_current int"


def _flag(c: str) -> Column:
    """True for 1, false for anything else, null too."""
    return F.coalesce(F.col(c).cast("int") == 1, F.lit(False))


def _listed(rows: DataFrame, name: str, fields: dict[str, Column], count: str | None, more: dict[str, Column] | None = None) -> DataFrame:
    """identity_id, `name` (sorted array of structs), its count and more aggregates."""
    item = F.struct(*[c.alias(n) for n, c in fields.items()])
    aggs = [F.array_sort(F.collect_list(item)).alias(name)]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    return rows.groupBy("identity_id").agg(*aggs, *[c.alias(n) for n, c in (more or {}).items()])


def primary_address(addresses: DataFrame) -> DataFrame:
    """The address flagged primary, else any; of several the one that the smallest link brought."""
    first = W.partitionBy("identity_id").orderBy(F.col("is_primary").desc(), "link_id", F.col("address1").asc_nulls_first(), F.col("zip").asc_nulls_first())
    return addresses.withColumn("r", F.row_number().over(first)).where("r = 1").select("identity_id", "address1", "city", "state", "zip")


def latest(staged: DataFrame, links: DataFrame) -> DataFrame:
    """terminated (of the newest record) and ssn_last_four (of the first record that has one)."""
    rows = links.select("identity_id", "stg_person_id").join(staged.select("stg_person_id", "terminated", "source_modified", "ssn_last_four"), "stg_person_id")
    newest = F.max_by("terminated", F.struct(F.col("source_modified").isNotNull(), "source_modified", "stg_person_id"))
    first = F.min(F.when(F.col("ssn_last_four").isNotNull(), F.struct("stg_person_id", "ssn_last_four")))["ssn_last_four"]
    return rows.groupBy("identity_id").agg(newest.alias("terminated"), first.alias("ssn_last_four"))


def identity_aliases(staged: DataFrame, links: DataFrame) -> DataFrame:
    rows = links.select("identity_id", "stg_person_id").join(children(staged, "aliases"), "stg_person_id")
    return rows.select("identity_id", "alias_type", "first_name", "last_name").distinct()


def uuid_of(identity_id: Column) -> Column:
    """A stable UUID-shaped name of an identity."""
    h = F.md5(F.concat(F.lit("identity:"), identity_id.cast("string")).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def profile(identities: DataFrame, staged: DataFrame, links: DataFrame, systems: DataFrame, licenses: DataFrame, addresses: DataFrame, identifiers: DataFrame, credentials: DataFrame, exclusions: DataFrame, boards: DataFrame | None = None, resolutions: DataFrame | None = None, built_at: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """One row for each identity (of those in `ids`, if given). Every part is aggregated by identity_id before it is joined,
    so the joins need no shuffle beyond the parts' own."""
    spark = identities.sparkSession
    boards = boards if boards is not None else spark.createDataFrame([], BOARD)
    resolutions = resolutions if resolutions is not None else spark.createDataFrame([], RESOLUTION)
    if ids is not None:
        identities, links, licenses, addresses, identifiers, credentials, exclusions, boards, resolutions = (
            t.join(ids.select("identity_id").distinct(), "identity_id", "left_semi") for t in (identities, links, licenses, addresses, identifiers, credentials, exclusions, boards, resolutions)
        )
    col, text = F.col, lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = links.join(systems.select("system_id", "system_code"), "system_id", "left").withColumn("system_code", F.coalesce("system_code", col("system_id").cast("string")))
    real = F.nullif(col("account_id"), F.lit(0))
    parts = [
        _listed(licenses, "licenses", {"number": col("license_number"), "state": col("certification_state"), "board": col("certification_board"), "type": col("license_type"), "registry": col("registry"), "verified": _flag("is_verified")}, "license_count"),
        _listed(identifiers.select("identity_id", "id_type", "id_value").distinct(), "identifiers", {"type": col("id_type"), "value": col("id_value")}, "identifier_count", {"dea_identifier": F.max(F.when(col("id_type") == "dea", col("id_value")))}),
        _listed(addresses, "addresses", {"type": F.when(col("is_primary") == 1, F.lit("primary")).otherwise("alt"), **{c: col(c) for c in ("address1", "address2", "city", "state", "zip")}}, "address_count"),
        primary_address(addresses),
        _listed(credentials, "credentials", {"credential_match_id": col("credential_match_id"), "registry": col("registry"), "status": col("match_summary_status"), "status_code": col("match_summary_status_code"), "valid": _flag("match_is_valid"), "current": _flag("is_current"), "link_state": col("link_state")}, "credential_count"),
        _listed(exclusions, "exclusions", {"match_id": col("match_id"), "registry": col("registry"), **{f: _flag(f) for f in FLAGS if f != "is_upin_match"}, "link_state": col("link_state")}, "exclusion_count", {"has_active_exclusion": F.max(col("link_state") != "rejected")}),
        _listed(boards, "board_actions", {"registry": col("registry"), "action_type": col("action_type"), "action_date": text("action_date"), "resolution_date": text("resolution_date")}, "board_action_count", {"has_active_board_action": F.max(col("resolution_date").isNull())}),
        _listed(resolutions.where("is_current = 1"), "resolutions", {"domain": col("domain"), "target_key": col("target_key"), "decision": col("decision"), "resolved_by": col("resolved_by"), "resolved_at": text("resolved_at"), "auto_resolvable": _flag("is_auto_resolvable")}, "resolution_count"),
        _listed(named, "source_records", {"system_code": col("system_code"), "source_table": col("source_table"), "source_id": col("source_id"), "account_id": real}, "record_count", {"system_count": F.countDistinct("system_id"), "accounts": F.array_sort(F.collect_set(real))}).withColumn("account_count", F.size("accounts").cast("long")),
        _listed(identity_aliases(staged, links), "aliases", {"type": col("alias_type"), "first": col("first_name"), "last": col("last_name")}, None),
        latest(staged, links),
    ]
    wide = reduce(lambda a, b: a.join(b, "identity_id", "left"), parts, identities.drop("record_count"))
    lists = ("licenses", "identifiers", "addresses", "credentials", "exclusions", "board_actions", "resolutions", "source_records", "accounts", "aliases")
    kinds = {f.name: f.dataType for f in wide.schema.fields}
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return wide.select(
        "identity_id", uuid_of(col("identity_id")).alias("identity_uuid"),
        col("canonical_first").alias("first_name"), col("canonical_middle").alias("middle_name"), col("canonical_last").alias("last_name"), col("canonical_suffix").alias("suffix"), col("canonical_dob").alias("date_of_birth"),
        "ssn_hash", "ssn_last_four", "npi", "upin", F.coalesce(F.nullif(col("dea_number"), F.lit("")), col("dea_identifier")).alias("dea_number"),
        "address1", "city", "state", "zip", "terminated", "confidence",
        *[zero(f"{c}_count").alias(f"{c}_count") for c in ("identifier", "address", "license", "record", "account", "system", "credential", "exclusion", "board_action", "resolution")],
        no("has_active_exclusion").alias("has_active_exclusion"), no("has_active_board_action").alias("has_active_board_action"),
        *[empty(c).alias(c) for c in lists],
        F.lit(built_at).cast("timestamp").alias("profile_built_at"),
    )


def as_json(c: str) -> Column:
    """A nested column as JSON with its null fields."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def alias_index(staged: DataFrame, links: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """name, identity_id, part (last or first) of all alias names, optionally of an id range."""
    if low is not None:
        links = links.where(F.col("identity_id") >= low)
    if high is not None:
        links = links.where(F.col("identity_id") < high)
    rows = identity_aliases(staged, links)
    part = lambda c, p: rows.select(F.trim(c).alias("name"), "identity_id", F.lit(p).alias("part"))
    return part("last_name", "last").unionByName(part("first_name", "first")).where("name IS NOT NULL AND name <> ''").distinct()


def alias_coverage(index: DataFrame, staged: DataFrame, links: DataFrame) -> DataFrame:
    """One row: identities with a surname in the index, and with one among their aliases; equal if the index is current."""
    held = index.where("part = 'last'").select(F.col("identity_id").alias("held"), F.lit(None).cast("long").alias("due"))
    due = identity_aliases(staged, links).where("trim(last_name) <> ''").select(F.lit(None).cast("long").alias("held"), F.col("identity_id").alias("due"))
    return held.unionByName(due).agg(F.countDistinct("held").alias("indexed"), F.countDistinct("due").alias("expected"))
