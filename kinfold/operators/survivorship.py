"""Which source's value of a field an identity shows, with the provenance of every candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.config import SURVIVING_FIELDS, ResolutionConfig

CANONICAL = {"first_name": "canonical_first", "middle_name": "canonical_middle", "last_name": "canonical_last", "name_suffix": "canonical_suffix", "date_of_birth": "canonical_dob"}


def authority_rank(system_code: Column, reliability: Column, config: ResolutionConfig) -> Column:
    """Place in the authority list; unlisted systems come after by reliability (100 less it, 50 if unknown)."""
    out = F.lit(100) - F.coalesce(reliability, F.lit(50))
    for i, code in reversed(list(enumerate(config.authority))):
        out = F.when(system_code == code, F.lit(i)).otherwise(out)
    return out.cast("int")


def candidates(staged: DataFrame, links: DataFrame, systems: DataFrame, config: ResolutionConfig) -> DataFrame:
    """A row for each non-blank value of a surviving field of a linked record, with its place `rn` (1: winner): authority,
    newest, smallest link. One shuffle for all fields."""
    ranked = systems.select("system_id", "system_code", authority_rank(F.col("system_code"), F.col("reliability_rank"), config).alias("authority"))
    rows = links.select("identity_id", "link_id", "stg_person_id", "system_id").join(staged.select("stg_person_id", "source_modified", *SURVIVING_FIELDS), "stg_person_id")
    rows = rows.join(ranked, "system_id", "left")
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in SURVIVING_FIELDS])
    rows = rows.select("identity_id", "link_id", "system_id", "system_code", F.coalesce("authority", F.lit(50)).alias("authority"), "source_modified", F.inline(F.filter(values, lambda v: v["value"].isNotNull() & (F.trim(v["value"]) != ""))))
    order = W.partitionBy("identity_id", "field").orderBy("authority", F.col("source_modified").desc_nulls_last(), "link_id")
    return rows.withColumn("rn", F.row_number().over(order))


def provenance(found: DataFrame) -> DataFrame:
    return found.select("identity_id", "field", F.substring("value", 1, 255).alias("value"), "link_id", "system_id", "source_modified", (F.col("rn") == 1).alias("is_winner"))


def audit(found: DataFrame) -> DataFrame:
    rule = F.concat(F.lit("authority["), F.coalesce("system_code", F.col("system_id").cast("string")), F.lit("] + recency"))
    return found.where("rn = 1").select("identity_id", "field", F.substring("value", 1, 500).alias("winning_value"), F.col("link_id").alias("winning_link_id"), rule.alias("rule"))


def winners(found: DataFrame) -> DataFrame:
    """identity_id and a column for each field."""
    pick = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in SURVIVING_FIELDS]
    return found.where("rn = 1").groupBy("identity_id").agg(*pick)


def apply(identities: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """Identities with winning values (their own where a field has no candidate) and record counts."""
    won = winners(found).withColumnsRenamed({f: f"w_{f}" for f in SURVIVING_FIELDS})
    joined = identities.join(won, "identity_id", "left").join(links.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n_links")), "identity_id", "left")
    kinds = dict(identities.dtypes)
    new = {}
    for f in SURVIVING_FIELDS:
        c = CANONICAL.get(f, f)
        new[c] = F.coalesce(F.col(f"w_{f}").cast(kinds[c]), F.col(c))
    return joined.withColumns(new).withColumn("record_count", F.coalesce("n_links", F.lit(0))).select(*identities.columns, "record_count")
