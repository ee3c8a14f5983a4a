"""Incremental, rerun-safe loading of the landing CSV files with Structured Streaming.

The published load copies whole CSV files and warns that a rerun duplicates the keyless
usage rows.  As a stream, each file is taken exactly once: the file source records the files of
every micro-batch in the checkpoint, and the sink writes each batch into a folder of its own and
then publishes it by one manifest entry (sublens.sources.warehouse).  A batch that died is written
anew by the rerun; one that is published already is left alone, so nothing is loaded twice or
half.  `trigger(availableNow=True)` makes the load a bounded job that processes what is there
and stops.

The stream reads lines, and every batch cuts them into records as the batch load does
(sublens.sources.records): in many tasks a file, quoted line breaks included.  Usage rows get
their row_id in the sink, from the batch, the file's place in it and the line, so a landed row
keeps its key in every read and after further loads.

Checkpoints live under the session's spark.checkpoint.dir (the shared folder a cluster names).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sublens.session import ensure_checkpoint_dir
from sublens.sources import warehouse
from sublens.sources.csv_io import KEYLESS, READ_OPTIONS
from sublens.sources.records import in_place, read_records
from sublens.sources.schemas import FILE_SCHEMAS, TABLE_NAMES, TABLE_SCHEMAS, enforce

BATCH_FILES = 1000  # most files of a batch (all are taken, in as many batches as it needs)
BATCH_NUMBERS = 1024  # file numbers a batch has for its usage files; 2^27 in all


def landing_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    """Streaming DataFrame over the lines of the CSV files in a folder, with their places."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", BATCH_FILES).text(source_dir)
    return in_place(lines)


def _land(name: str, target_dir: str):
    def write(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        if batch in warehouse.versions(spark, target_dir):
            return  # written whole before the checkpoint could say so
        rows = read_records(lines, FILE_SCHEMAS[name], READ_OPTIONS, batch * BATCH_NUMBERS if name == KEYLESS else None)
        folder = f"data/batch={batch}"
        enforce(rows, TABLE_SCHEMAS[name]).write.mode("overwrite").parquet(os.path.join(target_dir, folder))
        warehouse.publish(spark, target_dir, batch, [(name, "", folder)])
    return write


def read_landed(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The typed table of the batches that are published."""
    schema = TABLE_SCHEMAS[name]
    entries = warehouse.entries(spark, folder)
    if entries is None:
        return spark.createDataFrame([], schema)
    landed = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(os.path.join(folder, "data"))
    return enforce(landed.join(F.broadcast(entries.select(F.col("version").alias("batch"))), "batch", "left_semi"), schema)


def load_incrementally(spark: SparkSession, name: str, source_dir: str, target_dir: str,
                       checkpoint: str | None = None) -> None:
    """Append the not-yet-loaded CSV files of `source_dir` to the table in `target_dir`."""
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "landing", os.path.basename(target_dir))
    query = (landing_stream(spark, source_dir).writeStream.foreachBatch(_land(name, target_dir))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    query.awaitTermination()


def load_all_incrementally(spark: SparkSession, csv_folder: str, warehouse_dir: str) -> dict[str, str]:
    """Run the incremental load for the five tables; returns {table: table folder}."""
    out = {}
    for name in TABLE_NAMES:
        target = f"{warehouse_dir}/{name}"
        load_incrementally(spark, name, f"{csv_folder}/{name}.csv", target,
                           checkpoint=f"{warehouse_dir}/_checkpoints/{name}")
        out[name] = target
    return out
