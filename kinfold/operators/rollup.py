"""Credential and exclusion facts of source records, carried to identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.store import upsert

FLAGS = ("is_ssn_match", "is_npi_match", "is_canonical_name_match", "is_upin_match", "is_license_number_match")


def _links(links: DataFrame, system_id: int, source_table: str) -> DataFrame:
    return links.where((F.col("system_id") == system_id) & (F.col("source_table") == source_table)).select(F.col("source_id").alias("employee_id"), "identity_id")


def credentials(matches: DataFrame, links: DataFrame, config: ResolutionConfig, system_id: int = 1, source_table: str = "employees") -> DataFrame:
    """credential_match_id, identity_id and status of matches whose code is not excluded, confirmed."""
    code = F.col("match_summary_status_code")
    keep = ~code.isin(*config.rollup_excluded_codes)
    keep = F.coalesce(keep, F.lit(config.keep_null_codes))
    rows = matches.where(keep).join(_links(links, system_id, source_table), "employee_id")
    return rows.select(F.col("id").alias("credential_match_id"), "identity_id", "registry", "match_summary_status", "match_summary_status_code", "match_is_valid", F.col("current").alias("is_current"), "date_resolved", "expiry_date", F.lit("confirmed").alias("link_state"))


def exclusions(matches: DataFrame, records: DataFrame, links: DataFrame, before: DataFrame | None = None, system_id: int = 1, source_table: str = "employees") -> DataFrame:
    """match_id, identity_id, registry and flags, as candidates. With `before`, a state that a person has set stays."""
    rows = matches.join(_links(links, system_id, source_table), "employee_id").join(records.select(F.col("id").alias("record_id"), F.col("exclusion_list_prefix").alias("registry")), F.col("exclusion_record_id") == F.col("record_id"), "left")
    rows = rows.select(F.col("id").alias("match_id"), "identity_id", "exclusion_record_id", "registry", *[F.col(f) if f in matches.columns else F.lit(None).cast("int").alias(f) for f in FLAGS], F.lit("candidate").alias("link_state"))
    return rows if before is None else upsert(before, rows, ["match_id"], keep=["link_state"])


def drop_excluded(held: DataFrame, matches: DataFrame, config: ResolutionConfig) -> DataFrame:
    """Credential links without those whose status is now an excluded one."""
    gone = matches.where(F.col("match_summary_status_code").isin(*config.rollup_excluded_codes)).select(F.col("id").alias("credential_match_id"))
    return held.join(gone, "credential_match_id", "left_anti")
