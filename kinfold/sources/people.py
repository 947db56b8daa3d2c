"""Projection of an employee-shaped source into staged people: one select, children as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import block_key, clean, clean_date, clean_timestamp

# Names of the additional-information rows that hold DEA numbers.
DEA_NAMES = ("dea_number", "alt_dea_number", *(f"alt_license_dea_number_{i}" for i in range(2, 7)))
BUSINESS_NAMES = tuple(f"alt_business{i}" for i in range(3, 10))
ALIAS_COLUMNS = (
    ("maiden", None, "maiden_name"), ("maiden", None, "alt_maiden_name_1"), ("maiden", None, "alt_maiden_name_2"),
    ("alt", "alt_first_name", "alt_last_name"), *[("alt", f"alt_first_name_{i}", f"alt_last_name_{i}") for i in range(2, 6)],
    ("business", "business", None), ("business", "alt_business1", None), ("business", "alt_business2", None),
)


ADDRESS = ("address1", "address2", "city", "state", "zip")
ALT_ADDRESS = ("alt_address1_1", "alt_address2_1", "alt_city_1", "alt_state_1", "alt_zip_1")
CERTIFICATION = ("certification_number", "certification_state", "certification_board", "license_type")
#: Columns that are cleaned and otherwise taken as they are.
PLAIN = (*ADDRESS, *ALT_ADDRESS, *CERTIFICATION, *[f"alt_{c}" for c in CERTIFICATION], *[c for _, f, n in ALIAS_COLUMNS for c in (f, n) if c])


def pivot_info(info: DataFrame) -> DataFrame:
    """employee_id, info: a map of cleaned values by name. Of several rows of a name the greatest value stands; blanks
    are dropped."""
    one = info.select("employee_id", "name", clean(F.col("value")).alias("value")).where("value IS NOT NULL AND name IS NOT NULL")
    one = one.groupBy("employee_id", "name").agg(F.max("value").alias("value"))
    return one.groupBy("employee_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("info"))


def _kept(rows: list[Column], keep) -> Column:
    return F.filter(F.array(*rows), keep)


def stage(employees: DataFrame, lists: DataFrame, info: DataFrame, system_id: int = 1, source_table: str = "employees") -> DataFrame:
    """Staged people. Columns that the source lacks count as null."""
    given = ("first_name", "middle_name", "last_name", "name_suffix", "ssn_hash", "ssn_last_four", "npi", "upin", *PLAIN)
    have = [c for c in dict.fromkeys(given) if c in employees.columns]
    raw = lambda c: F.col(c).cast("string") if c in employees.columns else F.lit(None).cast("string")
    # values are cleaned once, here; what the source lacks adds nothing to the plan
    cleaned = employees.select(
        F.col("id").cast("long").alias("id"), F.col("employeelist_id") if "employeelist_id" in employees.columns else F.lit(None).cast("int").alias("employeelist_id"),
        *[clean(F.col(c)).alias(c) for c in have], raw("last_name").alias("_last"), raw("date_of_birth").alias("_dob"), raw("terminated").alias("_terminated"), raw("date_modified").alias("_modified"),
    )
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in have else none
    got = lambda name: F.element_at(F.col("info"), F.lit(name))
    number = lambda c: F.when(col(c).try_cast("long") > 0, col(c).try_cast("long"))

    alias = lambda kind, first, last: F.struct(F.lit(kind).alias("alias_type"), first.alias("first_name"), last.alias("last_name"))
    aliases = [alias(k, col(f), col(n)) for k, f, n in ALIAS_COLUMNS if f in have or n in have] + [alias("business", got(n), none) for n in BUSINESS_NAMES]

    def address(kind: str, names: tuple[str, ...]) -> Column:
        parts = [col(c).alias(n) for n, c in zip(("address1", "address2", "city", "state", "zip"), names, strict=True)]
        return F.struct(F.lit(kind).alias("address_type"), *parts, F.lit(int(kind == "primary")).alias("is_primary"))

    addresses = [address(kind, names) for kind, names in (("primary", ADDRESS), ("alt_1", ALT_ADDRESS)) if kind == "primary" or {*names} & {*have}]

    def licence(number_: Column, state: Column, board: Column, kind: Column, primary: int) -> Column:
        return F.struct(number_.alias("license_number"), state.alias("certification_state"), board.alias("certification_board"), kind.alias("license_type"), F.lit(primary).alias("is_primary"))

    licenses = [licence(*[col(f"{p}{c}") for c in ("certification_number", "certification_state", "certification_board", "license_type")], int(not p)) for p in ("", "alt_") if f"{p}certification_number" in have]
    licenses += [licence(got(f"{p}csl_number"), got(f"{p}csl_state"), none, F.lit("csl"), 0) for p in ("", "alt_")]
    for i in range(2, 7):
        licenses.append(licence(*[got(f"alt_license_cert_{c}_{i}") for c in ("number", "state", "board")], got(f"alt_license_type_{i}"), 0))
        licenses.append(licence(got(f"alt_license_csl_number_{i}"), got(f"alt_license_csl_state_{i}"), none, F.lit("csl"), 0))
    identifier = lambda kind, name: F.struct(F.lit(kind).alias("id_type"), got(name).alias("id_value"))
    identifiers = [identifier("dea", n) for n in DEA_NAMES] + [identifier("mmis", "mmis_number")]

    joined = cleaned.join(pivot_info(info).withColumnRenamed("employee_id", "info_id"), F.col("id") == F.col("info_id"), "left")
    # a row for each list of employees; small, but its size is not known here, so the planner decides
    joined = joined.join(lists.select(F.col("id").alias("list_id"), "account_id"), F.col("employeelist_id") == F.col("list_id"), "left")
    return joined.select(
        F.col("id").alias("stg_person_id"),
        F.lit(system_id).alias("system_id"),
        F.lit(source_table).alias("source_table"),
        F.col("id").alias("source_id"),
        F.col("account_id").cast("long").alias("account_id"),
        *[col(c).alias(c) for c in ("first_name", "middle_name", "last_name", "name_suffix")],
        clean_date(F.col("_dob")).alias("date_of_birth"),
        col("ssn_hash").alias("ssn_hash"),
        col("ssn_last_four").alias("ssn_last_four"),
        number("npi").alias("npi"),
        col("upin").alias("upin"),
        none.alias("dea_number"),
        block_key(F.col("_last"), F.col("_dob")).alias("block_key"),
        F.coalesce(F.col("_terminated").try_cast("int"), F.lit(0)).alias("terminated"),
        clean_timestamp(F.col("_modified")).alias("source_modified"),
        _kept(aliases, lambda x: x["first_name"].isNotNull() | x["last_name"].isNotNull()).alias("aliases"),
        _kept(addresses, lambda x: x["address1"].isNotNull() | x["city"].isNotNull()).alias("addresses"),
        _kept(licenses, lambda x: x["license_number"].isNotNull()).alias("licenses"),
        _kept(identifiers, lambda x: x["id_value"].isNotNull()).alias("identifiers"),
    )
