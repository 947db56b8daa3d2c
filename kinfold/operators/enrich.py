"""Licences, addresses and identifiers of identities, one row for each natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.base import children


def _of_identity(staged: DataFrame, links: DataFrame, name: str) -> DataFrame:
    return children(staged, name).join(links.select("stg_person_id", "identity_id", "link_id", "is_pinned").where("is_pinned = 0"), "stg_person_id")


def licenses(staged: DataFrame, links: DataFrame) -> DataFrame:
    """By (identity, number, state, board), nulls equal; other columns take their greatest value, the link the smallest."""
    key = ["identity_id", "license_number", "certification_state", "certification_board"]
    rows = _of_identity(staged, links, "licenses").groupBy(*key).agg(F.max("license_type").alias("license_type"), F.min("link_id").alias("link_id"))
    return rows.withColumns({"registry": F.lit(None).cast("string"), "is_verified": F.lit(0)})


def addresses(staged: DataFrame, links: DataFrame) -> DataFrame:
    key = ["identity_id", "address1", "city", "state", "zip"]
    return _of_identity(staged, links, "addresses").groupBy(*key).agg(F.max("address2").alias("address2"), F.max("is_primary").alias("is_primary"), F.min("link_id").alias("link_id"))


def places(staged: DataFrame, links: DataFrame) -> DataFrame:
    """identity_id, address1 and zip of all addresses, not made unique: for those who gather them by identity anyway."""
    return _of_identity(staged, links, "addresses").select("identity_id", "address1", "zip")


def identifiers(staged: DataFrame, links: DataFrame) -> DataFrame:
    return _of_identity(staged, links, "identifiers").groupBy("identity_id", "id_type", "id_value").agg(F.min("link_id").alias("link_id"))
