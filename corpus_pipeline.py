"""From raw documents to packed training sequences, one operator a stage.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and read
again as the next stage's `docs`.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from sublens.llm import op3_chosen_path, op5_quality, op6_secrets, op9_language, op10_packing
from sublens.llm.common import documents, remainder, written
from sublens.llm.queries import vocabulary_file

LEAST_LANGUAGE = 0.5  # posterior of the predicted language
LEAST_QUALITY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language.

    The model learns from the given documents that aren't held out (as the language ID query).
    Null and empty texts have no letter and go; copies share their text's fate, each row by
    itself; if nothing could be learned every row goes; an empty table stays empty.  Columns
    beyond those of documents pass through whatever their names."""
    teaching = docs.where(remainder(F.col("doc_id"), 4) != 2).select("lang", "text")
    model = op9_language.train(teaching)
    return _kept(docs, lambda rows, passing: op9_language.predict(rows, model, passing),
                 (F.col("lang_pred") != op9_language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier takes for low quality; it learns from labelled rows
    that aren't held out, of all documents.

    Null and empty texts are scored by the classifier's bias alone; without labels every row
    scores 0.5 and stays; copies share their text's fate; an empty table stays empty.  Columns
    beyond those of documents pass through whatever their names."""
    labels = op5_quality.known_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    teaching = documents(spark, sf_dir).where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text")
    model = op5_quality.train(teaching, labels)
    return _kept(docs, lambda rows, passing: op5_quality.predict(rows, model, passing), F.col("score") >= LEAST_QUALITY)


def _kept(docs: DataFrame, predict, condition: Column) -> DataFrame:
    """The rows of `docs` whose prediction meets the condition.  Each row travels as one struct, so
    that no column of it can clash with those of the prediction."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    passing = StructType([StructField("row", docs.schema)]).toDDL()
    return predict(rows, passing).where(condition).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the join links: the one with the smallest id.

    A null id counts as larger than all others.  Null texts, empty ones and those without words are
    copies of each other; of rows that agree in id and text the first by n_chars, lang and source
    stays; an empty table stays empty.  Columns beyond those of documents pass through whatever
    their names."""
    keep = op3_chosen_path.join(docs).where("first").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    place = F.row_number().over(Window.partitionBy("id_key", "text_hash").orderBy("row.n_chars", "row.lang", "row.source"))
    return rows.join(keep, ["id_key", "text_hash"], "left_semi").withColumn("place", place).where("place = 1").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found, in decoded layers too; n_chars follows the text.

    Null texts stay null, rows without a secret stay as they are, copies are masked alike; an empty
    table stays empty.  Other columns pass through."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            text = [None if t is None else op6_secrets.redacted(t) for t in batch.column("text").to_pylist()]
            n = [size if new == old else len(new) for size, new, old in zip(batch.column("n_chars").to_pylist(), text, batch.column("text").to_pylist())]
            put = {"text": pa.array(text, pa.string()), "n_chars": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([put.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=[f.name for f in batch.schema])
    return docs.mapInArrow(run, docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in sequences of at most 4096 tokens.

    A null or empty text is the end token alone; rows that repeat an id are packed each by itself;
    an empty table gives no rows.  Other columns are not read."""
    return op10_packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL: str | None = None  # learned models, joins by similarity and packing are not SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
