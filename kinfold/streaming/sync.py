"""Incremental resolution: changed source records, batch by batch or as a stream.

A batch links new people to the hub's identities by the deterministic tiers in the order for single records, then by probabilistic matching, and makes
identities for those left by the tiers among themselves. Changed people keep their links; their staged row and children are replaced. Profiles of
touched identities are rebuilt. Batches of ids keep older identities' ids the smaller ones.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.operators import enrich, materialize, probabilistic, resolve, rollup, survivorship
from kinfold.plans.pipeline import Hub, rebuild_profiles
from kinfold.store import Store, delete_keys, newest, save


def changed(people: DataFrame, high_water) -> DataFrame:
    """Staged records modified after the watermark, strictly."""
    return people.where(F.col("source_modified") > F.lit(high_water).cast("timestamp"))


def apply_batch(hub: Hub, people: DataFrame, batch: int, connector=None, config: ResolutionConfig | None = None, built_at: str | None = None) -> tuple[Hub, DataFrame]:
    """The hub after a batch of staged people, and the log of matches to review. Of several rows of a record the newest
    counts. Applying a batch again changes nothing."""
    config = config or ResolutionConfig()
    people = save(newest(people, ["stg_person_id"], [F.col("source_modified").desc_nulls_last()]), "batch")
    staged = save(delete_keys(hub.staged, people, ["stg_person_id"]).unionByName(people), "staged")
    new = people.join(hub.links.select("stg_person_id"), "stg_person_id", "left_anti")
    own = [c for c in hub.identities.columns if c != "record_count"]
    known = hub.identities.select(*own)
    first = resolve.resolve(new, config, known, hub.links, batch, hub.blocked, create=False, order=resolve.ROW_ORDER, licenses=hub.licenses)
    links, identities = save(first.links, "links"), save(first.identities, "identities")
    open_ = save(new.join(links.select("stg_person_id"), "stg_person_id", "left_anti"), "open")
    matched = save(probabilistic.match(open_, staged, links, identities, hub.addresses, hub.exclusions, config), "matched")
    bound = open_.join(matched.where("band <> 'no_match'").select("stg_person_id", "identity_id", "score", "band"), "stg_person_id")
    bound = save(bound.select(
        F.col("stg_person_id").alias("link_id"), "identity_id", "system_id", "source_table", "source_id", "account_id", "stg_person_id", F.lit("probabilistic").alias("match_method"),
        F.lit("pass_b").alias("match_key"), F.col("score").alias("match_score"), F.col("band").alias("match_state"), F.lit(0).alias("is_pinned"),
    ), "bound")
    # automatic matches bring their keys; matches to review do not
    identities = save(resolve.fill_keys(identities, bound.where("match_state = 'auto_match'"), people), "identities")
    rest = resolve.resolve(new, config, identities, save(links.unionByName(bound), "links"), batch, hub.blocked)
    links, identities = save(rest.links, "links"), save(rest.identities, "identities")
    touched = save(links.join(people.select("stg_person_id"), "stg_person_id", "left_semi").select("identity_id").distinct(), "touched")
    of = links.join(touched, "identity_id", "left_semi")
    part = replace(hub, staged=staged, links=links, identities=identities)
    for name in ("licenses", "addresses", "identifiers"):
        now = getattr(enrich, name)(staged, of)
        kept = delete_keys(getattr(hub, name), touched, ["identity_id"])
        part = replace(part, **{name: save(kept.unionByName(now.select(*kept.columns)), name)})
    if connector is not None:
        part = replace(part, credentials=save(rollup.drop_excluded(rollup.credentials(connector.credentials(), links, config), connector.credentials(), config), "credentials"))
        part = replace(part, exclusions=save(rollup.exclusions(connector.exclusions(), connector.exclusion_records(), links, hub.exclusions), "exclusions"))
    found = survivorship.candidates(staged.join(of.select("stg_person_id"), "stg_person_id", "left_semi"), of, hub.systems, config)
    winners = survivorship.apply(identities.join(touched, "identity_id", "left_semi"), found, of)
    rest = delete_keys(survivorship.apply(identities, found.limit(0), links), touched, ["identity_id"])
    part = replace(part, identities=save(rest.unionByName(winners), "identities"))
    rebuilt = rebuild_profiles(part, built_at, touched)
    profiles = delete_keys(hub.profiles, touched, ["identity_id"]).unionByName(rebuilt) if hub.profiles is not None else rebuilt
    names = materialize.alias_index(staged, of)
    aliases = delete_keys(hub.aliases, touched, ["identity_id"]).unionByName(names) if hub.aliases is not None else names
    log = matched.where("band = 'review'").select("stg_person_id", "identity_id", F.lit("relink").alias("action"), "score")
    return replace(part, profiles=save(profiles, "profiles"), aliases=save(aliases, "aliases")), save(log, "log")


def sync(store: Store, connector, config: ResolutionConfig | None = None, built_at: str | None = None) -> Hub:
    """One poll: what the source changed since the watermark is applied, and the watermark moves on."""
    high = store.read("watermark").first()[0]
    people = connector.people(since=high)  # the bound reaches the scan
    top = people.agg(F.max("source_modified")).first()[0]
    hub = Hub.load(store)
    if top is None:
        return hub
    hub, log = apply_batch(hub, people, len(store.versions("watermark")), connector, config, built_at)
    hub.write(store)
    store.write("resolution_log", log)
    store.write("watermark", log.sparkSession.createDataFrame([(top,)], "high_water timestamp"))
    store.vacuum()
    return Hub.load(store)


def stream(people: DataFrame, store: Store, checkpoint: str, connector=None, config: ResolutionConfig | None = None):
    """A streaming query over staged people that applies each micro-batch to the hub in `store`. A batch number that has
    been applied is skipped, so a restart does not apply it twice."""

    def one(batch: DataFrame, number: int) -> None:
        done = {r[0] for r in store.read("stream_batches").collect()} if store.exists("stream_batches") else set()
        if number in done or batch.isEmpty():
            return
        hub, log = apply_batch(Hub.load(store), batch, 1000 + number, connector, config)
        hub.write(store)
        store.write("resolution_log", log)
        store.write("stream_batches", batch.sparkSession.createDataFrame([(n,) for n in sorted(done | {number})], "number long"))

    return people.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
