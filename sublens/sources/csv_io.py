"""Headed CSV readers and writers for the five tables and the extracts.

Columns are mapped by position and the header line is skipped (enforceSchema), the typed
schema is the reader schema, and a malformed row fails the load (FAILFAST) instead of
silently becoming NULLs.  Quotes are doubled (RFC 4180), so free text with commas,
quotes and line breaks round-trips; surrounding spaces are kept on write.

Files whose values may hold line breaks, and the usage files, whose rows need a key that stays, are
read by sublens.sources.records in many tasks a file; the others by Spark's own line reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sublens.session import scratch_path
from sublens.sources import warehouse as versions
from sublens.sources.records import read_records, text_lines
from sublens.sources.schemas import FILE_SCHEMAS, TABLE_SCHEMAS, enforce
from sublens.sources.tables import Tables

READ_OPTIONS = {"header": "true", "mode": "FAILFAST", "escape": '"', "quote": '"', "enforceSchema": "true"}
MULTI_LINE = frozenset({"churn_events"})  # tables whose text columns may hold line breaks
KEYLESS = "feature_usage_raw"  # its rows get a key when they are loaded
WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
                 "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(**READ_OPTIONS).option("multiLine", multi_line).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def load_table(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> DataFrame:
    """Typed frame of one table from its headed CSV.  A usage row gets a row_id made of its
    file's number (in the order of the names) and its line: the same in every action and rerun over
    the same files.

    multi_line: whether a quoted value may hold line breaks; by default only for MULTI_LINE.
    Set it for accounts whose names hold line breaks."""
    if name == KEYLESS:
        return enforce(read_records(text_lines(spark, path), FILE_SCHEMAS[name], READ_OPTIONS, number_from=0), TABLE_SCHEMAS[name])
    if name in MULTI_LINE if multi_line is None else multi_line:
        return read_records(text_lines(spark, path), FILE_SCHEMAS[name], READ_OPTIONS)
    return read_csv(spark, path, FILE_SCHEMAS[name])


def export_tables(tables: Tables, folder: str) -> None:
    """Write the five tables as headed CSV files in file column order (usage without row_id)."""
    for name, df in tables.items():
        write_csv(enforce(df, FILE_SCHEMAS[name]), f"{folder}/{name}.csv")


def load_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(**{name: load_table(spark, name, f"{folder}/{name}.csv") for name in FILE_SCHEMAS})


def reload(spark: SparkSession, csv_folder: str, warehouse: str) -> Tables:
    """Load the CSV files into the Parquet warehouse, replacing what is there, so a rerun
    never duplicates the keyless usage rows.  Readers see the version before whole until the load
    is complete (sublens.sources.warehouse)."""
    versions.replace(spark, warehouse, load_tables(spark, csv_folder))
    return versions.current(spark, warehouse)


def add_late_file(spark: SparkSession, name: str, path: str, warehouse: str) -> Tables:
    """Add the rows of a late CSV file (or folder) to an event table of the warehouse: only their
    months are rewritten.  Usage files take the numbers after those in use, so row ids stay unique.
    A file must be added once: rows are not compared with those that are there."""
    rows = load_table(spark, name, path)
    if name == KEYLESS:
        used = versions.current(spark, warehouse).feature_usage_raw.agg(F.max(F.shiftright("row_id", 36))).first()[0]
        rows = enforce(read_records(text_lines(spark, path), FILE_SCHEMAS[name], READ_OPTIONS, number_from=0 if used is None else used + 1), TABLE_SCHEMAS[name])
    versions.add_late(spark, warehouse, name, rows)
    return versions.current(spark, warehouse)


def round_trip(spark: SparkSession, tables: Tables, name: str) -> DataFrame:
    """Write one table as CSV to a fresh shared scratch folder and read it back typed."""
    path = scratch_path(spark, f"csv-{name}")
    write_csv(enforce(getattr(tables, name), FILE_SCHEMAS[name]), path)
    return load_table(spark, name, path)


def freeze(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write an extract as headed CSV and read it back with its own schema."""
    path = scratch_path(spark, f"extract-{name}")
    write_csv(df, path)
    return read_csv(spark, path, df.schema, multi_line=True)
