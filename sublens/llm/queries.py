"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from sublens.llm import op1_hmm, op2_bpe, op3_chosen_path, op4_token_counts, op5_quality, op6_secrets, op7_fingerprints, op8_neighbours, op9_language, op10_packing, op11_line_dedup, op12_filter_audit, op13_divergence
from sublens.llm.common import documents, remainder


@cache
def vocabulary_file(name: str) -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_hmm.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 5) == 1)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bpe.round_trip_digests(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_chosen_path.join(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_id", "n_links")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_counts.token_counts(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op5_quality.quality(documents(spark, sf_dir), labels, remainder(F.col("doc_id"), 3) == 1)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.secrets(documents(spark, sf_dir)).drop("found")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_fingerprints.edited_and_next(documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language.language_id(documents(spark, sf_dir), remainder(F.col("doc_id"), 4) == 2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))


def op11_line_dedup_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_line_dedup.digests(documents(spark, sf_dir))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup_digests": op11_line_dedup.ORACLE_SQL, "op12_filter_interactions": op12_filter_audit.ORACLE_SQL,
            "op13_source_divergence": op13_divergence.ORACLE_SQL}
