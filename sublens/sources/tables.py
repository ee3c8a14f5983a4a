"""The five input tables as one value passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tables:
    accounts: DataFrame
    subscriptions: DataFrame
    feature_usage_raw: DataFrame
    support_tickets: DataFrame
    churn_events: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        return replace(self, **{name: df})

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> "Tables":
        """Read the five tables written as <folder>/<name>.parquet."""
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}.parquet") for f in fields(cls)})

    def write_parquet(self, folder: str, mode: str = "overwrite") -> None:
        for name, df in self.items():
            df.write.mode(mode).parquet(f"{folder}/{name}.parquet")
