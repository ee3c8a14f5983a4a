"""A Parquet warehouse of the five tables that changes as a whole, events by month.

Every load writes a folder of its own (`data/<version>-<random>`) and is published by one more file,
the manifest entry of its version: which folder holds each table, and for the event tables each
event month.  A job's only output file becomes visible by one rename, so a reader sees either the
old version or the new one, each whole; what a load that died had written is named by no entry and
never read.  A reader resolves the version once and keeps reading its files while later ones are
published.  A late file rewrites only the months of its rows (`add_late`): the new version names the
old folders for all others.  A read of some months lists only their folders.  `expire` deletes what
no kept version names.

One load runs at a time; a second one that publishes the same version fails.  An entry has at
most one row per table and calendar month, which is what the driver reads.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sublens.sources.schemas import TABLE_NAMES, TABLE_SCHEMAS, enforce
from sublens.sources.tables import Tables

ENTRY = "version long, table string, month string, folder string"
EVENT_DAY = {"feature_usage_raw": "usage_date", "support_tickets": "submitted_at", "churn_events": "churn_date"}
UNDATED = "none"  # month of events without a date

Named = list[tuple[str, str, str]]  # (table, month or '', folder)


def entries(spark: SparkSession, warehouse: str) -> DataFrame | None:
    """ENTRY rows of every version published, None before the first."""
    try:
        return spark.read.schema(ENTRY).json(os.path.join(warehouse, "manifest"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, warehouse: str) -> list[int]:
    """The versions published, the newest first."""
    found = entries(spark, warehouse)
    return [] if found is None else [r.version for r in found.select("version").distinct().orderBy(F.desc("version")).collect()]


def published(spark: SparkSession, warehouse: str, version: int) -> Named:
    """What a version names."""
    found = entries(spark, warehouse)
    rows = [] if found is None else found.where(F.col("version") == version).collect()
    if not rows:
        raise FileNotFoundError(f"{warehouse} has no version {version}")
    return sorted((r.table, r.month, r.folder) for r in rows)


def publish(spark: SparkSession, warehouse: str, version: int, named: Named) -> None:
    entry = spark.createDataFrame([(version, *n) for n in named], ENTRY).coalesce(1)
    entry.write.mode("error").json(os.path.join(warehouse, "manifest", f"entry={version:012d}"))


def _write(spark: SparkSession, warehouse: str, folder: str, name: str, rows: DataFrame) -> Named:
    path = os.path.join(warehouse, folder, name)
    if name not in EVENT_DAY:
        rows.write.mode("error").parquet(path)
        return [(name, "", f"{folder}/{name}")]
    month = F.coalesce(F.date_format(F.col(EVENT_DAY[name]).cast("date"), "yyyy-MM"), F.lit(UNDATED))
    # Rebalanced on the month: files of a useful size, and a month that holds most rows in several tasks.
    rows.withColumn("event_month", month).hint("rebalance", "event_month").write.mode("error").partitionBy("event_month").parquet(path)
    written = spark.read.schema("event_month string").parquet(path).select("event_month").distinct().collect()
    return [(name, r.event_month, f"{folder}/{name}/event_month={r.event_month}") for r in written]


def _next(spark: SparkSession, warehouse: str) -> tuple[int, str]:
    version = max(versions(spark, warehouse), default=0) + 1
    return version, f"data/{version:012d}-{uuid.uuid4().hex}"


def replace(spark: SparkSession, warehouse: str, tables: Tables) -> int:
    """Write the tables as a new version and make it the current one; returns its number."""
    version, folder = _next(spark, warehouse)
    publish(spark, warehouse, version, [n for name, rows in tables.items() for n in _write(spark, warehouse, folder, name, rows)])
    return version


def add_late(spark: SparkSession, warehouse: str, name: str, rows: DataFrame) -> int:
    """A new version with `rows` added to an event table; only the months they fall in are written."""
    last = versions(spark, warehouse)[0]
    named = published(spark, warehouse, last)
    version, folder = _next(spark, warehouse)
    rows = enforce(rows, TABLE_SCHEMAS[name])
    day = F.date_format(F.col(EVENT_DAY[name]).cast("date"), "yyyy-MM")
    months = {r.m for r in rows.select(F.coalesce(day, F.lit(UNDATED)).alias("m")).distinct().collect()}
    touched = [n for n in named if n[0] == name and n[1] in months]
    new = _write(spark, warehouse, folder, name, _read(spark, warehouse, name, touched).unionByName(rows))
    publish(spark, warehouse, version, sorted({n for n in named if n not in touched} | set(new)))
    return version


def _read(spark: SparkSession, warehouse: str, name: str, named: Named) -> DataFrame:
    paths = [os.path.join(warehouse, folder) for _, _, folder in named]
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLE_SCHEMAS[name])


def current(spark: SparkSession, warehouse: str, version: int | None = None, first: str | None = None, last: str | None = None) -> Tables:
    """The tables of the newest (or the given) version; of the event tables only the months from
    `first` to `last` ('yyyy-MM'), if given: undated events are in none."""
    if version is None:
        version = next(iter(versions(spark, warehouse)), -1)
    named = published(spark, warehouse, version)
    if first or last:
        named = [n for n in named if n[0] not in EVENT_DAY or n[1] != UNDATED and (first or "") <= n[1] <= (last or "9999-99")]
    return Tables(**{name: _read(spark, warehouse, name, [n for n in named if n[0] == name]) for name in TABLE_NAMES})


def expire(spark: SparkSession, warehouse: str, keep: int = 2) -> list[str]:
    """Delete the folders that the newest `keep` versions don't name, those of loads that died among
    them; run it when no load is running and no reader holds an older version.  Returns the
    folders deleted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    data = hadoop.Path(os.path.join(warehouse, "data"))
    files = data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(data):
        return []
    every = versions(spark, warehouse)
    kept = {folder.split("/")[1] for v in every[:max(1, keep)] for _, _, folder in published(spark, warehouse, v)}
    for version in every[max(1, keep):]:  # the entry first: no entry names a folder that is gone
        files.delete(hadoop.Path(os.path.join(warehouse, "manifest", f"entry={version:012d}")), True)
    gone = sorted(s.getPath().getName() for s in files.listStatus(data) if s.getPath().getName() not in kept)
    for name in gone:
        files.delete(hadoop.Path(data, name), True)
    return gone
