"""Guard against filler social security numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import ResolutionConfig
from kinfold.functions.text import match_key, placeholder_hashes


def blocklist(staged: DataFrame, config: ResolutionConfig) -> DataFrame:
    """key_ssn, people, reason of hashes that must not identify anyone: known placeholders, and those that more than
    `most_people_per_ssn` people carry.

    People are different (surname, first name, date of birth) triples; a null part is left out of the triple, so one
    person seen with and without a part counts more than once.
    """
    spark = staged.sparkSession
    triple = F.concat_ws("|", match_key(F.col("last_name")), match_key(F.col("first_name")), F.col("date_of_birth").cast("string"))
    keyed = staged.select(match_key(F.col("ssn_hash")).alias("key_ssn"), triple.alias("person")).where("key_ssn IS NOT NULL")
    people = keyed.groupBy("key_ssn").agg(F.countDistinct("person").alias("people"))
    many = people.where(F.col("people") > max(1, config.most_people_per_ssn)).withColumn("reason", F.lit("people"))
    known = placeholder_hashes(config.ssn_key, config.placeholders)
    if not known:
        return many
    listed = spark.createDataFrame([(h.lower(),) for h in known], "key_ssn string")
    listed = listed.join(people, "key_ssn", "left").select("key_ssn", F.coalesce("people", F.lit(0)).cast("long").alias("people"), F.lit("placeholder").alias("reason"))
    return listed.unionByName(many.join(listed, "key_ssn", "left_anti"))
