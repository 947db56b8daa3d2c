"""Corpus pipeline: documents through four of the training-data operators, each stage written and read by the next.

Every stage but the last takes and returns the columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import jaccard, mixing, packing, toxicity
from kinfold.llm.common import save
from kinfold.llm.queries import toxicity_scores
from kinfold.llm.tokens import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold calibrated for their language. A document without a language has the
    general threshold."""
    score = toxicity.free_name("_score", docs.columns)
    scored, model = toxicity_scores(spark, sf_dir, docs, keep=docs.columns, name=score)
    return scored.where(F.col(score) < toxicity.threshold_of(model, F.col("lang"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, and of rows repeated in full one. Documents
    without words are in no group and stay."""
    found = jaccard.join(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of their training positions."""
    return mixing.schedule(mixing.mix(docs)).select("doc.*").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_path())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The first stage learns a classifier and the last one packs by a seeded search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
