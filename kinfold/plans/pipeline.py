"""The batch pipeline: stage, resolve, enrich, merge, roll up, choose survivors, materialize."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.operators import dedup, enrich, materialize, resolve, rollup, survivorship
from kinfold.sources.base import systems
from kinfold.store import Store, save


@dataclass
class Hub:
    """The tables of the hub. What a step has not filled is null."""

    systems: DataFrame
    staged: DataFrame
    links: DataFrame | None = None
    identities: DataFrame | None = None
    blocked: DataFrame | None = None
    licenses: DataFrame | None = None
    addresses: DataFrame | None = None
    identifiers: DataFrame | None = None
    credentials: DataFrame | None = None
    exclusions: DataFrame | None = None
    boards: DataFrame | None = None
    resolutions: DataFrame | None = None
    merge_log: DataFrame | None = None
    attributes: DataFrame | None = None
    audit: DataFrame | None = None
    profiles: DataFrame | None = None
    aliases: DataFrame | None = None

    def write(self, store: Store) -> None:
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                store.write(f.name, df)

    @classmethod
    def load(cls, store: Store) -> Hub:
        return cls(**{f.name: store.read(f.name) for f in fields(cls) if store.exists(f.name)})


def staged(spark: SparkSession, connector, without: Sequence[str] = ()) -> Hub:
    """The staged source; columns that no later step reads can be left out."""
    return Hub(systems(spark, [connector]), save(connector.people().drop(*without), "staged"))


def staged_in_ranges(spark: SparkSession, connector, store: Store, ranges: list[tuple[int, int]]) -> Hub:
    """The staged source, id range by id range (low and high included), each with a cursor `stg:low-high` once it is written:
    a run after a broken one goes on with the ranges that are missing."""
    for low, high in ranges:
        name = f"stg:{low}-{high}"
        done = store.read("cursors") if store.exists("cursors") else spark.createDataFrame([], "name string")
        if done.where(F.col("name") == name).isEmpty():
            connector.people(low, high).write.mode("overwrite").parquet(f"{store.root}/staged_ranges/{low}-{high}")
            store.write("cursors", done.unionByName(spark.createDataFrame([(name,)], "name string")))
    return Hub(systems(spark, [connector], store.read("systems") if store.exists("systems") else None), spark.read.parquet(*[f"{store.root}/staged_ranges/{low}-{high}" for low, high in ranges]))


def clear_stage_cursors(store: Store) -> None:
    """Forget what has been staged, so that the next run stages all ranges afresh."""
    if store.exists("cursors"):
        store.write("cursors", store.read("cursors").where(~F.col("name").startswith("stg:")))


def resolved(hub: Hub, config: ResolutionConfig) -> Hub:
    config.warnings()
    found = resolve.resolve(hub.staged, config)
    return replace(hub, links=save(found.links, "links"), identities=save(found.identities, "identities"), blocked=found.blocked)


def enriched(hub: Hub) -> Hub:
    parts = {n: save(getattr(enrich, n)(hub.staged, hub.links), n) for n in ("licenses", "addresses", "identifiers")}
    return replace(hub, **parts)


def merged(hub: Hub) -> Hub:
    out = dedup.merge_all(hub.identities, hub.licenses, hub.identifiers, hub.blocked)
    into = out.log
    return replace(
        hub, identities=out.identities, merge_log=into, links=save(dedup.repoint(hub.links, into), "links"), licenses=save(dedup.repoint(hub.licenses, into, dedup.LICENSE_KEY), "licenses"),
        addresses=save(dedup.repoint(hub.addresses, into, dedup.ADDRESS_KEY), "addresses"), identifiers=save(dedup.repoint(hub.identifiers, into, dedup.IDENTIFIER_KEY), "identifiers"),
    )


def rolled_up(hub: Hub, connector, config: ResolutionConfig) -> Hub:
    return replace(
        hub, credentials=save(rollup.credentials(connector.credentials(), hub.links, config), "credentials"),
        exclusions=save(rollup.exclusions(connector.exclusions(), connector.exclusion_records(), hub.links, hub.exclusions), "exclusions"),
    )


def finalized(hub: Hub, config: ResolutionConfig, built_at: str | None = None) -> Hub:
    found = save(survivorship.candidates(hub.staged, hub.links, hub.systems, config), "candidates")
    own = [c for c in hub.identities.columns if c != "record_count"]
    identities = save(survivorship.apply(hub.identities.select(*own), found, hub.links), "identities")
    hub = replace(hub, identities=identities, attributes=survivorship.provenance(found), audit=survivorship.audit(found))
    return replace(hub, profiles=rebuild_profiles(hub, built_at), aliases=materialize.alias_index(hub.staged, hub.links))


def rebuild_profiles(hub: Hub, built_at: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Profiles of all identities or of some, without choosing survivors again."""
    return materialize.profile(hub.identities, hub.staged, hub.links, hub.systems, hub.licenses, hub.addresses, hub.identifiers, hub.credentials, hub.exclusions, hub.boards, hub.resolutions, built_at, ids)


def backfill(spark: SparkSession, connector, config: ResolutionConfig | None = None, built_at: str | None = None, store: Store | None = None) -> Hub:
    """Everything from the source to profiles; with `store`, written as new snapshots, with the watermark of what was read."""
    config = config or ResolutionConfig()
    hub = finalized(rolled_up(merged(enriched(resolved(staged(spark, connector), config))), connector, config), config, built_at)
    if store is not None:
        hub.write(store)
        store.write("watermark", hub.staged.agg(F.max("source_modified").alias("high_water")))
        hub = Hub.load(store)
    return hub
