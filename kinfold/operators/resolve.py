"""Deterministic resolution of staged people to identities, tier by tier.

Each tier joins unlinked people to identities by one key, makes an identity for each key that none has yet, and then
fills empty keys of identities from the people linked to them, so that later tiers see them. An identity's id is its
tier's ordinal (and batch) times 2^40 plus its founder's id: earlier tiers get smaller ids, reruns the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import TIER_NAMES, ResolutionConfig
from kinfold.functions.text import match_key
from kinfold.operators.guard import blocklist
from kinfold.store import save

SPAN = 1 << 40
KEYED = {"ssn_hash": "key_ssn", "npi": "key_npi", "upin": "key_upin", "dea_number": "key_dea", "name_dob": "key_name"}
#: Identity columns with the staged columns that fill them.
FILLED = {"ssn_hash": "ssn_hash", "npi": "npi", "upin": "upin", "dea_number": "dea_number", "canonical_dob": "date_of_birth", "canonical_first": "first_name", "canonical_middle": "middle_name", "canonical_last": "last_name"}
IDENTITY = ("identity_id", *FILLED, "canonical_suffix", "confidence", "status")
LICENSE = "license_state"
#: Order of the tiers for records that come one by one: licence and state count before the name.
ROW_ORDER = ("ssn_hash", "npi", "dea_number", "upin", LICENSE, "name_dob")


@dataclass
class Resolved:
    links: DataFrame
    identities: DataFrame
    blocked: DataFrame


def key_columns(first: str, last: str, dob: str) -> dict[str, Column]:
    """Match keys; the name key needs all three parts."""
    parts = [match_key(F.col(last)), match_key(F.col(first)), F.col(dob).cast("string")]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return {
        "key_ssn": match_key(F.col("ssn_hash")),
        "key_npi": F.when(F.col("npi") > 0, F.col("npi").cast("string")),
        "key_upin": match_key(F.col("upin")),
        "key_dea": match_key(F.col("dea_number")),
        "key_name": F.when(whole, F.concat_ws("|", *parts)),
    }


def staged_keys(staged: DataFrame, blocked: DataFrame) -> DataFrame:
    """Staged scalars with match keys; blocked hashes are no keys."""
    return _unblocked(staged.drop("aliases", "addresses", "licenses", "identifiers").withColumns(key_columns("first_name", "last_name", "date_of_birth")), blocked)


def identity_keys(identities: DataFrame, blocked: DataFrame) -> DataFrame:
    return _unblocked(identities.withColumns(key_columns("canonical_first", "canonical_last", "canonical_dob")), blocked)


def holders(identities: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Each value of a key with the smallest active identity that has it."""
    rows = identities.where("status = 'active'").select("identity_id", key_columns("canonical_first", "canonical_last", "canonical_dob")[key].alias(key))
    rows = _unblocked(rows, blocked) if key == "key_ssn" else rows
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("identity_id").alias("identity_id"))


def _unblocked(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    bad = blocked.select(F.col("key_ssn").alias("_bad"))
    return rows.join(bad, rows["key_ssn"] == F.col("_bad"), "left").withColumn("key_ssn", F.when(F.col("_bad").isNull(), F.col("key_ssn"))).drop("_bad")


def _identity(rows: DataFrame, identity_id: Column, confidence: float) -> DataFrame:
    return rows.select(identity_id.alias("identity_id"), *[F.col(s).alias(c) for c, s in FILLED.items()], F.col("name_suffix").alias("canonical_suffix"), F.lit(confidence).cast("decimal(5,4)").alias("confidence"), F.lit("active").alias("status"))


def _link(rows: DataFrame, tier: str, config: ResolutionConfig) -> DataFrame:
    return rows.select(
        F.col("stg_person_id").alias("link_id"), "identity_id", "system_id", "source_table", "source_id", "account_id", "stg_person_id",
        F.lit("deterministic").alias("match_method"), F.lit(tier).alias("match_key"), F.lit(config.confidence(tier)).cast("decimal(5,4)").alias("match_score"),
        F.lit("auto_match").alias("match_state"), F.lit(0).alias("is_pinned"),
    )


def fill_keys(identities: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """Empty key and name columns of active identities get the greatest value of the people linked to them."""
    most = links.select("identity_id", "stg_person_id").join(people, "stg_person_id").groupBy("identity_id").agg(*[F.max(s).alias(f"_{c}") for c, s in FILLED.items()])
    joined = identities.join(most, "identity_id", "left")
    return joined.select("identity_id", *[F.coalesce(F.col(c), F.when(F.col("status") == "active", F.col(f"_{c}"))).alias(c) for c in FILLED], "canonical_suffix", "confidence", "status")


def with_founded(held: DataFrame, here: DataFrame, known: DataFrame, key: str, base: int, confidence: float) -> DataFrame:
    """`held` after all people of `here` are linked by `key`: an identity for each value that none of `known` has, founded by
    its smallest person, and empty columns filled as `fill_keys` does. A value's people are brought together once."""
    first = F.struct("stg_person_id", *FILLED.values(), "name_suffix")
    groups = here.groupBy(key).agg(F.min(first).alias("first"), *[F.max(s).alias(f"_{c}") for c, s in FILLED.items()]).join(known, key, "left")
    new = F.col("identity_id").isNull()
    groups = groups.select(
        F.coalesce("identity_id", F.col("first.stg_person_id") + F.lit(base)).alias("identity_id"), *[F.coalesce(F.when(new, F.col(f"first.{s}")), F.col(f"_{c}")).alias(f"_{c}") for c, s in FILLED.items()],
        F.when(new, F.col("first.name_suffix")).alias("_suffix"), F.when(new, F.lit(confidence).cast("decimal(5,4)")).alias("_confidence"), F.when(new, F.lit("active")).alias("_status"),
    )
    return held.join(groups, "identity_id", "full_outer").select(
        "identity_id", *[F.coalesce(c, f"_{c}").alias(c) for c in FILLED], F.coalesce("canonical_suffix", "_suffix").alias("canonical_suffix"),
        F.coalesce("confidence", "_confidence").alias("confidence"), F.coalesce("status", "_status").alias("status"),
    )


def by_license(open_: DataFrame, staged: DataFrame, licenses: DataFrame, identities: DataFrame) -> DataFrame:
    """`open_` with identity_id: the smallest active identity that has a licence of the person, by number and state (none equals none)."""
    mine = staged.join(open_.select("stg_person_id"), "stg_person_id", "left_semi").select("stg_person_id", F.inline("licenses")).select("stg_person_id", "license_number", "certification_state")
    active = identities.where("status = 'active'").select("identity_id")
    held = licenses.join(active, "identity_id", "left_semi").groupBy("license_number", "certification_state").agg(F.min("identity_id").alias("identity_id"))
    held = held.withColumnsRenamed({"license_number": "_n", "certification_state": "_s"})
    same = (F.col("license_number") == F.col("_n")) & F.col("certification_state").eqNullSafe(F.col("_s"))
    found = mine.join(held, same).groupBy("stg_person_id").agg(F.min("identity_id").alias("identity_id"))
    return open_.join(found, "stg_person_id")


def pin(links: DataFrame, pins: DataFrame) -> DataFrame:
    """Links with those that a person has decided: `pins` (system_id, source_table, source_id, identity_id) set the identity
    of a source record's link, and keep it from enrichment."""
    key = ["system_id", "source_table", "source_id"]
    decided = pins.dropDuplicates(key).select(*key, F.col("identity_id").alias("_to"))
    return links.join(decided, key, "left").select(*[
        F.coalesce("_to", "identity_id").alias(c) if c == "identity_id" else F.when(F.col("_to").isNotNull(), F.lit(1)).otherwise(F.col(c)).alias(c) if c == "is_pinned" else F.col(c) for c in links.columns
    ])


def _asked(people: DataFrame, tiers: Sequence[str]) -> dict[str, bool]:
    """Whether any people have the key of a tier and none of the tiers before it."""
    open_, found = F.lit(True), []
    for t in tiers:
        found.append(F.coalesce(F.max(open_ & F.col(KEYED[t]).isNotNull()), F.lit(False)).alias(t))
        open_ = open_ & F.col(KEYED[t]).isNull()
    return people.agg(*found).first().asDict()


def resolve(staged: DataFrame, config: ResolutionConfig, identities: DataFrame | None = None, links: DataFrame | None = None, batch: int = 0, blocked: DataFrame | None = None, create: bool = True, order: Sequence[str] = tuple(KEYED), licenses: DataFrame | None = None) -> Resolved:
    """Links and identities for the staged people that have no link yet; those given stay. Without `create`, people are only
    linked to identities that there are. `order` has the tiers; that of licences looks them up in `licenses`."""
    blocked = save(blocked if blocked is not None else blocklist(staged, config), "blocked")
    people = staged_keys(staged, blocked)
    if links is not None:
        people = people.join(links.select("system_id", "source_table", "source_id"), ["system_id", "source_table", "source_id"], "left_anti")
    people = open_ = save(people, "people")
    made = _link(people.limit(0).withColumn("identity_id", F.lit(None).cast("long")), "new", config)
    held = identities.select(*IDENTITY) if identities is not None else _identity(people.limit(0), F.lit(None).cast("long"), 1.0)
    asked = _asked(people, [t for t in order if t != LICENSE]) if create else {}
    for tier in order:
        if tier == LICENSE:
            if licenses is not None:
                now = save(_link(by_license(open_, staged, licenses, held), tier, config), "links")
                made = made.unionByName(now)
                held = save(fill_keys(held, now, people), "identities")
                open_ = save(open_.join(now.select("stg_person_id"), "stg_person_id", "left_anti"), "open")
            continue
        ordinal, key = TIER_NAMES.index(tier), KEYED[tier]
        here = open_.where(F.col(key).isNotNull())
        if not asked[tier] if create else here.isEmpty():
            continue
        known = holders(held, blocked, key)
        if create:  # all who have the key are linked by it, so who stays open is known without a join, and links are made once all tiers are through
            held = save(with_founded(held, here, known, key, (batch * 16 + ordinal) * SPAN, config.confidence(tier)), "identities")
            made = made.unionByName(_link(here.join(holders(held, blocked, key), key), tier, config))
            open_ = open_.where(F.col(key).isNull())
            continue
        now = save(_link(here.join(known, key), tier, config), "links")
        made = made.unionByName(now)
        held = save(fill_keys(held, now, people), "identities")  # only identities linked in this tier can change
        open_ = save(open_.join(now.select("stg_person_id"), "stg_person_id", "left_anti"), "open")
    if create:
        alone = open_.withColumn("identity_id", F.col("stg_person_id") + F.lit((batch * 16 + TIER_NAMES.index("new")) * SPAN))
        held = held.unionByName(_identity(alone, F.col("identity_id"), config.confidence("new")))
        made = made.unionByName(_link(alone, "new", config))
    return Resolved(made if links is None else links.unionByName(made), held, blocked)
