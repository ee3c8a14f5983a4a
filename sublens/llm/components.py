"""Connected components of an edge table by alternating star contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sublens.llm.common import drop_scratch, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (u, v) with u > v.  large: link each node's larger neighbours to the
    smallest of its neighbourhood; small: link its smaller neighbours and itself to it."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): every node that isn't the smallest of its component, and that smallest node.

    edges: columns u, v of one orderable type, in any direction, repeats and loops allowed."""
    spark = edges.sparkSession
    spread = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held, mark = written(spread, name), None
    while True:
        seen = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark:
            return held
        mark = seen
        following = written(_star(_star(held, True), False), name)
        drop_scratch(spark, held)
        held = following
