"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import ann, attribution, jaccard, lm, mixing, packing, records, sketch, toxicity, warc
from kinfold.llm.tokens import default_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_pack_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path())


def op3_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.by_line(table(spark, sf_dir, "documents"), default_path(), "majority")


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, warc.write(table(spark, sf_dir, "pages")))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(table(spark, sf_dir, "documents"), None, default_path())
    return records.read(spark, manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_scores(spark: SparkSession, sf_dir: str, docs: DataFrame, **how) -> tuple[DataFrame, toxicity.Model]:
    return toxicity.classify(docs, table(spark, sf_dir, "labels"), usable=~held_out(), **how)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = toxicity_scores(spark, sf_dir, table(spark, sf_dir, "documents"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_bottomk_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op10_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ann_forest": op1_ann_forest,
    "op2_pack_gga": op2_pack_gga,
    "op3_mix_curriculum": op3_mix_curriculum,
    "op4_token_attribution": op4_token_attribution,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_token_records": op6_token_records,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_bottomk_sketch": op9_bottomk_sketch,
    "op10_jaccard_trees": op10_jaccard_trees,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op3_mix_curriculum": mixing.SQL, "op5_warc_salvage": warc.SQL}
