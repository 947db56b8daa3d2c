"""Merging identities that share a key, to a fixed point.

An identity holds one value for each key and takes a merged one's values only where it has none, so a second value of a
merged person is lost for later matches, as in one-by-one merging. The smallest id of a group survives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.resolve import FILLED, identity_keys
from kinfold.store import save

COLUMN_KEYS = ("key_ssn", "key_npi", "key_upin", "key_dea")
LICENSE_KEY = ("license_number", "certification_state", "certification_board")
ADDRESS_KEY = ("address1", "city", "state", "zip")
IDENTIFIER_KEY = ("id_type", "id_value")


@dataclass
class Merged:
    identities: DataFrame
    #: Every merged identity with the one that it ended in.
    log: DataFrame
    rounds: int


def by_column(identities: DataFrame, key: str) -> DataFrame:
    """loser, survivor for identities that share a value of one key column (each has one value, so groups are apart)."""
    least = F.min("identity_id").over(W.partitionBy(key))
    rows = identities.where(F.col(key).isNotNull()).select("identity_id", least.alias("survivor"))
    return rows.where("identity_id <> survivor").select(F.col("identity_id").alias("loser"), "survivor")


def by_child(child: DataFrame, key: list[str], most_rounds: int = 50) -> DataFrame:
    """loser, survivor for identities that share a child row by `key` (nulls equal). Groups overlap, so the least id spreads
    over identities and keys; labels also take their own label's label, so rounds grow with the logarithm of a chain's length."""
    edges = save(child.select("identity_id", F.xxhash64(*[F.struct(*key)]).alias("k"), F.struct(*key).alias("value")).groupBy("identity_id", "k", "value").agg(F.lit(1).alias("one")), "edges")
    shared = edges.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    edges = save(edges.join(shared, "value").select("identity_id", "value", F.col("identity_id").alias("label")), "edges")
    for _ in range(most_rounds):
        least = edges.groupBy("value").agg(F.min("label").alias("m"))
        of = edges.join(least, "value").groupBy("identity_id").agg(F.min("m").alias("m"))
        jump = of.select(F.col("identity_id").alias("at"), F.col("m").alias("then"))
        of = of.join(jump, F.col("m") == F.col("at"), "left").select("identity_id", F.least("m", F.coalesce("then", "m")).alias("m"))
        now = save(edges.join(of, "identity_id").select("identity_id", "value", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")), "labels")
        moved = now.where("moved").limit(1).count()
        edges = now.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still spread after {most_rounds} rounds")
    return edges.groupBy(F.col("identity_id").alias("loser")).agg(F.min("label").alias("survivor")).where("loser <> survivor")


def apply(identities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Identities after a merge: survivors take values that they lack from the losers, smallest ids first."""
    new = identities.join(mapping, F.col("identity_id") == F.col("loser"), "left").withColumn("into", F.coalesce("survivor", "identity_id"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(F.col("identity_id").alias("i"), F.col(c).alias("v"))))["v"]
    own = lambda c: F.max(F.when(F.col("into") == F.col("identity_id"), F.col(c)))
    return new.groupBy("into").agg(*[first(c).alias(c) for c in FILLED], own("canonical_suffix").alias("canonical_suffix"), own("confidence").alias("confidence"), own("status").alias("status")).withColumnRenamed("into", "identity_id")


def repoint(rows: DataFrame, mapping: DataFrame, natural: tuple[str, ...] = ()) -> DataFrame:
    """Child rows of losers go to their survivors; of rows of equal natural keys the survivor's own stays, else the one of
    the smallest former identity."""
    moved = rows.join(mapping, F.col("identity_id") == F.col("loser"), "left").withColumn("_into", F.coalesce("survivor", "identity_id"))
    if natural:
        rank = F.row_number().over(W.partitionBy("_into", *natural).orderBy("identity_id"))
        moved = moved.withColumn("_r", rank).where("_r = 1")
    return moved.select(*[F.col("_into").alias(c) if c == "identity_id" else F.col(c) for c in rows.columns])


def merge_all(identities: DataFrame, licenses: DataFrame, identifiers: DataFrame, blocked: DataFrame, most_rounds: int = 30) -> Merged:
    """Merge by SSN hash, NPI, UPIN, DEA number, licence, identifier and name with date of birth, again and again until a
    round merges nothing. Only ids and keys move; children are repointed once, by the log."""
    still = identities.where("status <> 'active'")  # these are not merged
    active = identities.where("status = 'active'")
    now = save(active, "identities")
    lic = save(licenses.join(now, "identity_id", "left_semi").select("identity_id", *LICENSE_KEY).distinct(), "licenses")
    idt = save(identifiers.join(now, "identity_id", "left_semi").select("identity_id", *IDENTIFIER_KEY).distinct(), "identifiers")
    log = save(now.limit(0).select(F.col("identity_id").alias("loser"), F.col("identity_id").alias("survivor")), "log")
    for turn in range(1, most_rounds + 1):
        merged = 0
        for step in (*COLUMN_KEYS, "license", "identifier", "key_name"):
            if step == "license":
                mapping = by_child(lic, list(LICENSE_KEY))
            elif step == "identifier":
                mapping = by_child(idt, list(IDENTIFIER_KEY))
            else:
                mapping = by_column(identity_keys(now, blocked), step)
            mapping = save(mapping, "mapping")
            n = mapping.count()
            if not n:
                continue
            merged += n
            now = save(apply(now, mapping), "identities")
            lic, idt = save(repoint(lic, mapping).distinct(), "licenses"), save(repoint(idt, mapping).distinct(), "identifiers")
            then = log.alias("l").join(mapping.alias("m"), F.col("l.survivor") == F.col("m.loser"), "left").select("l.loser", F.coalesce("m.survivor", "l.survivor").alias("survivor"))
            log = save(then.unionByName(mapping), "log")
        if not merged:
            return Merged(now.unionByName(still.select(*now.columns)), log, turn)
    raise RuntimeError(f"identities still merge after {most_rounds} rounds")
