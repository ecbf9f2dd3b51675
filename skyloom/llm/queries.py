"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn, langid, license, media, neardup, packing, quality, spm, sufdedup, toxicity
from .common import crc_mod

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def language_model(docs: DataFrame) -> langid.ByteConvNet | None:
    return langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.CompressionClassifier | None:
    learn = crc_mod(F.col("doc_id"), 5) != 0
    return toxicity.train(table(spark, sf_dir, "labels").where(learn), table(spark, sf_dir, "documents").where(learn))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod(F.col("doc_id"), 4) != 2
    out = quality.score(docs, quality.train(table(spark, sf_dir, "labels").where(learn), docs.where(learn)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).drop("rid", "spans")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_language_id, op3_toxicity, op4_media_columns, op5_near_duplicates, op6_quality, op7_license_scan, op8_sampled_pieces, op9_exact_top_k, op10_suffix_dedup, pipeline)
}

# Each query's vectors as integers, its score against all others, the 20 best. Only in the small: it
# is quadratic in DuckDB as well.
_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op9_exact_top_k": _OP9}
