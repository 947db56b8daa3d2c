"""What a source must give: canonical people with their children as arrays, and dependent facts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILDREN = ("aliases", "addresses", "licenses", "identifiers")


class Connector(Protocol):
    """A source of people. `people` gives one row per source record in the canonical shape of `sources.people.stage`."""

    system_code: str
    reliability_rank: int

    def people(self, low: int | None = None, high: int | None = None, since=None) -> DataFrame: ...

    def credentials(self) -> DataFrame: ...

    def exclusions(self) -> DataFrame: ...


def children(staged: DataFrame, name: str) -> DataFrame:
    """One child collection as rows with the person's id."""
    return staged.select("stg_person_id", F.inline(name))


def systems(spark, connectors: list[Connector], held: DataFrame | None = None) -> DataFrame:
    """Registry of source systems, a row for each: those of `held` stay as they are, and new codes get the next ids in the
    order of the connectors."""
    rows = [tuple(r) for r in held.select("system_id", "system_code", "reliability_rank").collect()] if held is not None else []
    for c in connectors:
        if c.system_code not in {r[1] for r in rows}:
            rows.append((max((r[0] for r in rows), default=0) + 1, c.system_code, c.reliability_rank))
    return spark.createDataFrame(rows, "system_id int, system_code string, reliability_rank int")
