"""Serving: name search over profiles, and the one qualifying credential of an identity."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.config import JSON_COLUMNS, ResolutionConfig
from kinfold.functions.text import match_key, ssn_candidates, ssn_unavailable_reason
from kinfold.operators.materialize import as_json


@dataclass
class Page:
    rows: DataFrame
    total: int
    page: int
    per_page: int

    @property
    def last_page(self) -> int:
        return max(1, -(-self.total // self.per_page))


def check_request(last_name: str, first_name: str | None, page: int, per_page: int) -> None:
    if not isinstance(last_name, str) or not last_name.strip() or len(last_name) > 100:
        raise ValueError("last_name is required and has 100 characters at most")
    if first_name is not None and len(first_name) > 100:
        raise ValueError("first_name has 100 characters at most")
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= per_page <= 100:
        raise ValueError("per_page is from 1 to 100")


def hits(profiles: DataFrame, aliases: DataFrame, last_name: str, first_name: str | None) -> DataFrame:
    """identity_id, record_count of identities of that name, or with an alias (of either part) equal to the last name; the
    first name is not asked of aliases. All identities with the alias count, as the page is chosen by records, not by ids.
    Two index lookups, no scan of nested columns."""
    wanted = F.lit(last_name.strip().lower())
    canonical = match_key(F.col("last_name")) == wanted
    if first_name:
        canonical = canonical & (match_key(F.col("first_name")) == F.lit(first_name.strip().lower()))
    by_alias = aliases.where(match_key(F.col("name")) == wanted).select("identity_id")
    narrow = profiles.select("identity_id", "record_count", canonical.alias("hit"))
    named = narrow.where("hit").select("identity_id", "record_count")
    return named.unionByName(narrow.join(by_alias, "identity_id", "left_semi").select("identity_id", "record_count")).distinct()


def guarded(profiles: DataFrame, config: ResolutionConfig) -> DataFrame:
    """Nested columns above the size limit become null and are named in omitted_fields."""
    large = {c: F.octet_length(as_json(c)) > config.most_json_bytes for c in JSON_COLUMNS}
    named = F.array_compact(F.array(*[F.when(large[c], F.lit(c)) for c in JSON_COLUMNS]))
    return profiles.withColumn("omitted_fields", named).withColumns({c: F.when(~F.array_contains("omitted_fields", c), F.col(c)) for c in JSON_COLUMNS})


def response(profiles: DataFrame) -> DataFrame:
    """What a caller sees: never the SSN hash."""
    parts = {c: F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("0")) for c in ("address1", "city", "state", "zip")}
    address = F.map_filter(F.create_map(*[x for c, v in parts.items() for x in (F.lit(c), v)]), lambda _, v: v.isNotNull())
    more = ["omitted_fields"] if "omitted_fields" in profiles.columns else []
    lists = [c for c in ("aliases", "licenses", "addresses", "accounts", "source_records", "credentials", "exclusions")]
    return profiles.select(
        "identity_id", "identity_uuid", "first_name", "middle_name", "last_name", "date_of_birth", "ssn_last_four", F.nullif("npi", F.lit(0)).alias("npi"), "upin", "dea_number",
        address.alias("primary_address"), F.coalesce(F.col("terminated") == 1, F.lit(False)).alias("terminated"), F.col("confidence").cast("double").alias("confidence"),
        "record_count", "account_count", "system_count", *lists, "has_active_exclusion", "resolutions", F.col("profile_built_at").alias("last_updated"), *more,
    )


def search(profiles: DataFrame, aliases: DataFrame, last_name: str, first_name: str | None = None, page: int = 1, per_page: int = 25, config: ResolutionConfig | None = None) -> Page:
    """One page, most records first, then smallest id. Narrow rows are sorted; only the page's profiles are read in full."""
    config = config or ResolutionConfig()
    check_request(last_name, first_name, page, per_page)
    found = hits(profiles, aliases, last_name, first_name)
    chosen = found.orderBy(F.desc("record_count"), "identity_id").offset((page - 1) * per_page).limit(per_page)
    # per_page rows at most
    rows = profiles.join(F.broadcast(chosen.select("identity_id")), "identity_id", "left_semi")
    rows = response(guarded(rows, config)).orderBy(F.desc("record_count"), "identity_id")
    return Page(rows, found.count(), page, per_page)


def qualifying(credentials: DataFrame, today: str | Column, config: ResolutionConfig) -> DataFrame:
    """Credential links with a qualifying status that have not expired."""
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    return credentials.where(F.col("match_summary_status_code").isin(*config.qualifying_codes) & (F.col("expiry_date").isNull() | (F.col("expiry_date") >= day)))


def best_credentials(credentials: DataFrame, today: str | Column, config: ResolutionConfig) -> DataFrame:
    """For each identity and registry: the latest qualifying link, the number of them, and whether there are too many to
    answer (then without a link)."""
    rows = qualifying(credentials, today, config)
    latest = F.max(F.struct(F.col("date_resolved").isNotNull(), "date_resolved", "credential_match_id"))
    best = rows.groupBy("identity_id", "registry").agg(latest.alias("b"), F.count(F.lit(1)).alias("links"))
    refused = (F.col("links") > config.most_links) & F.lit(config.most_links > 0)
    return best.select("identity_id", "registry", F.when(~refused, F.col("b.credential_match_id")).alias("credential_match_id"), F.when(~refused, F.col("b.date_resolved")).alias("date_resolved"), "links", refused.alias("refused"))


def credential_search(identities: DataFrame, aliases: DataFrame, credentials: DataFrame, registry: str, first_name: str, last_name: str, today: str, licenses: DataFrame | None = None, license_number: str | None = None, license_type: str | None = None, date_of_birth: str | None = None, ssn: str | None = None, resolutions: DataFrame | None = None, config: ResolutionConfig | None = None) -> tuple[DataFrame, dict]:
    """The latest qualifying credential of a person for a registry, one row at most, with notes: how many identities fit,
    whether an SSN could be used, and the current resolution of the credential if there is one."""
    config = config or ResolutionConfig()
    if not (registry and first_name and last_name):
        raise ValueError("registry, first_name and last_name are required")
    who = (match_key(F.col("canonical_last")) == last_name.strip().lower()) & (match_key(F.col("canonical_first")) == first_name.strip().lower())
    notes: dict = {"ssn_unavailable": None}
    if date_of_birth:
        who = who & (F.col("canonical_dob") == F.lit(date_of_birth).cast("date"))
    if ssn:
        notes["ssn_unavailable"] = ssn_unavailable_reason(config.ssn_key)
        if config.ssn_key:
            who = who & F.lower("ssn_hash").isin(*ssn_candidates(ssn, config.ssn_key))
    found = identities.where(who).select("identity_id")
    if licenses is not None and (license_number or license_type):
        fits = F.lit(True)
        if license_number:
            fits = fits & (match_key(F.col("license_number")) == license_number.strip().lower())
        if license_type:
            fits = fits & (match_key(F.col("license_type")) == license_type.strip().lower())
        found = found.join(licenses.where(fits), "identity_id", "left_semi")
    notes["identities"] = found.count()
    if notes["identities"] > 1:
        warnings.warn(f"{notes['identities']} identities fit the search", stacklevel=2)
    best = best_credentials(credentials.where(F.col("registry") == registry).join(found, "identity_id", "left_semi"), today, config)
    if resolutions is not None:
        prior = resolutions.where("domain = 'credential' AND is_current = 1").select("identity_id", F.col("target_key").alias("_key"), F.col("decision").alias("prior_resolution"))
        best = best.join(prior, (best["identity_id"] == prior["identity_id"]) & (best["credential_match_id"].cast("string") == F.col("_key")), "left").drop(prior["identity_id"]).drop("_key")
    order = [F.col("date_resolved").desc_nulls_last(), F.desc("credential_match_id")]
    first = F.row_number().over(W.partitionBy("registry").orderBy(*order))
    return best.withColumn("r", first).where("r = 1").drop("r"), notes
