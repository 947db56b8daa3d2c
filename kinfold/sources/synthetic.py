"""A people source made of order tables: each order is a record of an employee, the customer is the true person.

The SQL reads the same in Spark and DuckDB; `{orders}` and the like stand for the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.people import stage

DIGITS = "translate(CAST({} AS STRING), '0123456789', 'aeioubcdlm')"


def _word(letter: str, number: str) -> str:
    return f"concat('{letter}', {DIGITS.format(number)})"


EMPLOYEES = f"""
SELECT o_orderkey AS id, CAST(o_custkey % 40 + 1 AS INT) AS employeelist_id, CAST(o_custkey AS BIGINT) AS truth_person,
  CASE WHEN o_orderkey % 7 = 0 THEN upper({_word("f", "o_custkey % 53")}) ELSE {_word("f", "o_custkey % 53")} END AS first_name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'q' END AS middle_name,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_word("l", "o_custkey % 97")} END AS last_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE DATE '1950-01-01' + CAST(o_custkey * 37 % 18000 AS INT) END AS date_of_birth,
  CASE WHEN o_orderkey % 101 = 0 THEN md5('000000000') WHEN o_orderkey % 3 = 0 THEN md5(CAST(o_custkey AS STRING)) END AS ssn_hash,
  CASE WHEN o_orderkey % 3 = 0 THEN right(concat('000', CAST(o_custkey AS STRING)), 4) END AS ssn_last_four,
  CASE WHEN o_orderkey % 4 = 0 THEN 1000000000 + o_custkey ELSE 0 END AS npi,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('U', CAST(o_custkey AS STRING)) END AS upin,
  concat(CAST(o_custkey % 900 + 1 AS STRING), ' main st') AS address1, concat('city', CAST(c_nationkey AS STRING)) AS city,
  CASE WHEN o_orderkey % 9 = 0 THEN 'NY' END AS state, right(concat('0000', CAST(o_custkey % 700 AS STRING)), 5) AS zip,
  CASE WHEN o_orderkey % 19 = 0 THEN concat(CAST(o_custkey % 77 AS STRING), ' side st') END AS alt_address1_1,
  CASE WHEN o_orderkey % 13 = 0 THEN {_word("m", "o_custkey % 31")} END AS maiden_name,
  CASE WHEN o_orderkey % 17 = 0 THEN {_word("f", "o_custkey % 11")} END AS alt_first_name,
  CASE WHEN o_orderkey % 17 = 0 THEN {_word("l", "o_custkey % 23")} END AS alt_last_name,
  CASE WHEN o_orderkey % 29 = 0 THEN concat(' ', {_word("b", "o_custkey % 19")}, ' ') END AS business,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('C', CAST(o_custkey AS STRING)) END AS certification_number,
  concat('S', CAST(c_nationkey AS STRING)) AS certification_state,
  CASE WHEN o_orderkey % 12 = 0 THEN 'board' END AS certification_board, CASE WHEN o_orderkey % 18 = 0 THEN 'md' END AS license_type,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS terminated, o_orderdate AS date_modified
FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey
"""
LISTS = "SELECT DISTINCT CAST(c_custkey % 40 + 1 AS INT) AS id, CASE WHEN (c_custkey % 40) % 10 = 0 THEN 0 ELSE (c_custkey % 40) % 13 + 100 END AS account_id FROM {customer}"
INFO = """
SELECT o_orderkey AS employee_id, 'dea_number' AS name, concat('D', CAST(o_custkey AS STRING)) AS value FROM {orders} WHERE o_orderkey % 23 = 0
UNION ALL SELECT o_orderkey, 'mmis_number', concat(' M', CAST(o_custkey AS STRING), ' ') FROM {orders} WHERE o_orderkey % 31 = 0
UNION ALL SELECT o_orderkey, 'csl_number', concat('L', CAST(o_custkey AS STRING)) FROM {orders} WHERE o_orderkey % 37 = 0
UNION ALL SELECT o_orderkey, 'csl_state', 'NJ' FROM {orders} WHERE o_orderkey % 37 = 0
UNION ALL SELECT o_orderkey, 'alt_business3', concat('biz', CAST(o_custkey % 5 AS STRING)) FROM {orders} WHERE o_orderkey % 41 = 0
UNION ALL SELECT o_orderkey, 'alt_business4', '  ' FROM {orders} WHERE o_orderkey % 41 = 0
"""
CREDENTIALS = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS employee_id, concat('REG', CAST(min(l_suppkey) % 7 AS STRING)) AS registry,
  CASE CAST(min(l_quantity) AS INT) % 10 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 45 WHEN 5 THEN 65 WHEN 6 THEN 80 WHEN 7 THEN 85 WHEN 8 THEN 100 ELSE NULL END AS match_summary_status_code,
  min(l_linestatus) AS match_summary_status, CASE WHEN min(l_returnflag) = 'A' THEN 1 ELSE 0 END AS match_is_valid,
  CASE WHEN min(l_linestatus) = 'O' THEN 1 ELSE 0 END AS current, max(l_shipdate) AS date_resolved,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(max(l_shipdate) AS DATE) + 365 END AS expiry_date
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
EXCLUSIONS = """
SELECT event_id AS id, event_id AS employee_id, user_id % 120 AS exclusion_record_id, CASE WHEN value > 150 THEN 1 ELSE 0 END AS is_ssn_match,
  CASE WHEN value < 50 THEN 1 ELSE 0 END AS is_npi_match, CASE WHEN event_type = 'error' THEN 1 END AS is_canonical_name_match,
  0 AS is_upin_match, CAST(NULL AS INT) AS is_license_number_match
FROM {events} WHERE event_type IN ('error', 'purchase')
"""
RECORDS = "SELECT DISTINCT user_id % 120 AS id, concat('EX', CAST((user_id % 120) % 5 AS STRING)) AS exclusion_list_prefix FROM {events} WHERE user_id % 120 < 110"


class OrdersConnector:
    """The synthetic source over a folder of tables."""

    system_code, reliability_rank, source_table = "local_employees", 50, "employees"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _sql(self, text: str, **how) -> DataFrame:
        named = {t: how.get(t, lambda rows: rows)(self.spark.read.parquet(f"{self.folder}/{t}.parquet")) for t in ("orders", "customer", "lineitem", "events") if f"{{{t}}}" in text}
        return self.spark.sql(text, **named)

    @cached_property
    def employees(self) -> DataFrame:
        """Few files make few tasks, so orders are dealt by id before anything is made of them; the joins by id need no other shuffle."""
        return self._sql(EMPLOYEES, orders=lambda t: t.repartition("o_orderkey"))

    def people(self, low: int | None = None, high: int | None = None, since=None) -> DataFrame:
        """Staged people, of an id range or changed after `since` (strictly); the bounds reach the scan."""
        rows = self.employees
        if low is not None:
            rows = rows.where(F.col("id") >= low)
        if high is not None:
            rows = rows.where(F.col("id") <= high)
        if since is not None:
            rows = rows.where(F.col("date_modified") > F.lit(since).cast("timestamp"))
        return stage(rows, self._sql(LISTS), self._sql(INFO))

    def credentials(self) -> DataFrame:
        return self._sql(CREDENTIALS)

    def exclusions(self) -> DataFrame:
        return self._sql(EXCLUSIONS)

    def exclusion_records(self) -> DataFrame:
        return self._sql(RECORDS)

    def truth(self) -> DataFrame:
        return self.employees.select(F.col("id").alias("stg_person_id"), "truth_person")
