"""A corpus pipeline over `documents`: language ID, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import langid, neardup, packing, queries, sufdedup, toxicity
from skyloom.llm.common import written

#: Languages of the labels are kept when the network is at least so sure, on the mean of all windows.
SURE = 0.4
#: Documents at or above this toxicity go.
TOXIC = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the network is sure of, go."""
    model = queries.language_model(docs)
    out = langid.identify(docs, model, lang_out="__lang_pred", score_out="__lang_score")
    return out.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= SURE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), score_out="__toxicity")
    return out.where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Rows with a null id all stay, and so
    do rows that repeat the id that stays with another text; of rows equal in all columns one stays."""
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated bytes; characters cut in two go. Documents that lose everything
    stay, with an empty text."""
    cut = sufdedup.remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("rid").alias("__rid"), F.col("kept").alias("__text")).dropDuplicates(["__id", "__rid"])
    rid = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.withColumn("__r", rid).join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__r") == F.col("__rid")), "left")
    text = F.when(F.col("__rid").isNotNull(), F.col("__text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, queries.vocabulary(queries.TOKENIZER), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Stages are models and sketches, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
