"""A connector over the tables of an employee database, wherever Spark reads them from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.people import stage

#: Columns that the dependent facts need; others are not read.
CREDENTIAL_COLUMNS = ("id", "employee_id", "registry", "match_summary_status", "match_summary_status_code", "match_is_valid", "current", "date_resolved", "expiry_date")
MATCH_COLUMNS = ("id", "employee_id", "exclusion_record_id", "is_ssn_match", "is_npi_match", "is_canonical_name_match", "is_upin_match", "is_license_number_match")
RECORD_COLUMNS = ("id", "exclusion_list_prefix")


def parquet_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def jdbc_reader(spark: SparkSession, url: str, key: str = "id", low: int = 0, high: int = 20_000_000, partitions: int = 64, fetch: int = 10_000, **options: str) -> Callable[[str], DataFrame]:
    """Tables over JDBC, read in ranges of their key at once; filters and columns are pushed to the database."""

    def read(table: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
        if table not in ("employeelists", "employee_additional_info"):
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
        return reader.load()

    return read


class TableConnector:
    """People and their facts from `employees`, `employeelists`, `employee_additional_info`, `credential_matches`, `matches`
    and `exclusion_records`. A table's missing columns count as null."""

    def __init__(self, read: Callable[[str], DataFrame], system_code: str, reliability_rank: int = 50, system_id: int = 1, source_table: str = "employees", excluded_codes: tuple[int, ...] = ()):
        self.read, self.system_code, self.reliability_rank = read, system_code, reliability_rank
        self.system_id, self.source_table, self.excluded_codes = system_id, source_table, excluded_codes

    def _columns(self, table: str, columns: tuple[str, ...]) -> DataFrame:
        rows = self.read(table)
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])

    def people(self, low: int | None = None, high: int | None = None, since=None) -> DataFrame:
        rows = self.read("employees")
        if low is not None:
            rows = rows.where(F.col("id") >= low)
        if high is not None:
            rows = rows.where(F.col("id") <= high)
        if since is not None:
            rows = rows.where(F.col("date_modified") > F.lit(since))
        info = self.read("employee_additional_info").where("value <> ''")
        return stage(rows, self.read("employeelists"), info, self.system_id, self.source_table)

    def credentials(self) -> DataFrame:
        """Narrowed to the columns needed and, where it can be pushed to the source, to codes that count."""
        rows = self._columns("credential_matches", CREDENTIAL_COLUMNS)
        rows = rows.withColumns({"match_summary_status_code": F.col("match_summary_status_code").cast("int"), "expiry_date": F.col("expiry_date").cast("date")})
        if self.excluded_codes:
            code = F.col("match_summary_status_code")
            rows = rows.where(code.isNull() | ~code.isin(*self.excluded_codes))
        return rows

    def exclusions(self) -> DataFrame:
        rows = self._columns("matches", MATCH_COLUMNS)
        return rows.withColumns({c: F.col(c).cast("int") for c in MATCH_COLUMNS if c.startswith("is_")})

    def exclusion_records(self) -> DataFrame:
        return self._columns("exclusion_records", RECORD_COLUMNS)
