"""Named views, plot-ready extracts and the notebook's frame transforms.

The notebook pulls three small monthly frames to pandas and reshapes them there; here the
same reshapes are DataFrame operations on the monthly results (one row per calendar month
or month x tier), so nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sublens.operators import drivers, lenses, reasons, signals, snapshot
from sublens.session import scratch_path
from sublens.sources.tables import Tables

# Waterfall step labels and trend series titles, in display order.
WATERFALL_STEPS = (("Starting", "starting_mrr", 1), ("New", "new_mrr", 1), ("Expansion", "expansion_mrr", 1),
                   ("Contraction", "contraction_mrr", -1), ("Churned", "churned_mrr", -1),
                   ("Ending", "ending_mrr", 1))
TREND_SERIES = (("Logo churn rate", "logo_churn_rate"),
                ("Net revenue retention (NRR)", "net_revenue_retention"),
                ("Activity churn rate", "activity_churn_rate"))


def register_all(spark: SparkSession, tables: Tables, materialize: bool = False) -> dict[str, DataFrame]:
    """Publish the five tables and every view as temp views; returns them by name.

    With materialize=True the month-end snapshot, which nearly every view reads, is
    written once as Parquet (to the shared spark.checkpoint.dir) so the views do not each
    recompute it from the subscriptions, read only the columns they use, and a lost
    executor does not send them back to the source.
    """
    snap = snapshot.account_mrr_month(tables.subscriptions)
    if materialize:
        path, schema = scratch_path(spark, "snapshot"), snap.schema
        snap.write.parquet(path)
        snap = spark.read.schema(schema).parquet(path)
    with_tier = signals.change_signals_with_tier(tables, snap)
    account_signals = with_tier.drop("plan_tier")
    reason_rows = reasons.churn_reason_rows(snap, tables.churn_events)
    views = dict(tables.items())
    views.update({
        "v_account_mrr_month": snap,
        "v_logo_churn_month": lenses.logo_churn_month(tables, snap),
        "v_revenue_waterfall_month": lenses.revenue_waterfall_month(tables, snap),
        "v_activity_churn_month": lenses.activity_churn_month(tables, snap),
        "v_churn_scoreboard_month": lenses.churn_scoreboard_month(tables, snap),
        "v_mix_shift_by_plan_month": lenses.mix_shift_by_plan_month(snap),
        "v_support_account_month": drivers.support_account_month(tables.support_tickets),
        "v_usage_account_month": drivers.usage_account_month(tables),
        "v_account_month_cohorts": drivers.account_month_cohorts(snap),
        "v_churn_driver_table_3m": drivers.churn_driver_table(drivers.churn_driver_rows(tables, snap)),
        "v_change_signals_3m_account": account_signals,
        "v_change_signals_3m_summary": signals.change_signals_summary(account_signals),
        "v_change_signals_3m_summary_by_tier": signals.change_signals_summary_by_tier(with_tier),
        "v_reason_code_by_tier": reasons.reason_code_by_tier(reason_rows),
    })
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def scoreboard_trends(scoreboard: DataFrame, as_timestamp: bool = False) -> DataFrame:
    """S9 (+ N1): month_start and the three headline rates, in month order."""
    return _month_ordered(scoreboard.select("month_start", "logo_churn_rate", "net_revenue_retention",
                                            "activity_churn_rate"), as_timestamp)


def waterfall_inputs(waterfall: DataFrame, as_timestamp: bool = False) -> DataFrame:
    """S10 (+ N1): the six MRR components per month."""
    return _month_ordered(waterfall.select("month_start", *[c for _, c, _ in WATERFALL_STEPS]), as_timestamp)


def mix_extract(mix: DataFrame, as_timestamp: bool = False) -> DataFrame:
    """S11 (+ N1): mix shift rows in (month, tier) order."""
    out = mix.select("month_start", "plan_tier", "paying_accounts", "total_mrr", "avg_mrr_per_account")
    out = _with_month_type(out, as_timestamp)
    return out.orderBy(F.col("month_start").asc_nulls_last(), F.col("plan_tier").asc_nulls_last())


def _with_month_type(df: DataFrame, as_timestamp: bool) -> DataFrame:
    return df.withColumn("month_start", F.col("month_start").cast("timestamp_ntz")) if as_timestamp else df


def _month_ordered(df: DataFrame, as_timestamp: bool) -> DataFrame:
    return _with_month_type(df, as_timestamp).orderBy(F.col("month_start").asc_nulls_last())


def waterfall_for_month(waterfall: DataFrame, month: str) -> DataFrame:
    """The waterfall row of one month.  When the month has no row the query fails as it
    runs; nothing runs while it is built."""
    row = F.struct(*[F.col(c) for c in waterfall.columns])
    found = waterfall.agg(F.max(F.when(F.col("month_start") == F.lit(month).cast("date"), row)).alias("found"))
    missing = F.raise_error(F.lit(f"month {month} not found in revenue waterfall"))
    return found.select(F.coalesce("found", missing).alias("found")).select("found.*")


def waterfall_long(waterfall: DataFrame) -> DataFrame:
    """Six labelled steps per month; contraction and churned negated."""
    parts = ", ".join(f"{i}, '{label}', CAST({sign} * {col} AS DECIMAL(18,2))"
                      for i, (label, col, sign) in enumerate(WATERFALL_STEPS, start=1))
    return waterfall.selectExpr("month_start", f"stack({len(WATERFALL_STEPS)}, {parts}) AS (step, label, value)")


def waterfall_bases(waterfall: DataFrame, start_at: str = "starting") -> DataFrame:
    """Floating-bar bases. Middle steps sit on the running total of the steps before them;
    the first and last bars stand on 0.  start_at='starting' runs from the starting MRR,
    start_at='zero' reproduces the published drawing, whose running total starts at 0."""
    if start_at not in ("starting", "zero"):
        raise ValueError("start_at must be 'starting' or 'zero'")
    long = waterfall_long(waterfall)
    before = Window.partitionBy("month_start").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    running = F.sum("value").over(before)
    if start_at == "zero":
        running = running - F.sum(F.when(F.col("step") == 1, F.col("value"))).over(before)
    last = len(WATERFALL_STEPS)
    base = F.when(F.col("step").isin(1, last), F.lit(0)).otherwise(running).cast("decimal(18,2)")
    return long.withColumn("base", base)


def _listed(mix: DataFrame, tiers: list[str]) -> DataFrame:
    """Rows with a tier; a tier that isn't in `tiers` fails the query as it runs."""
    tier = F.col("plan_tier")
    unlisted = F.raise_error(F.concat(F.lit("plan tier not listed: "), tier))
    return mix.filter(tier.isNotNull()).withColumn("plan_tier", F.when(tier.isin(tiers), tier).otherwise(unlisted))


def mix_pivot(mix: DataFrame, tiers: list[str]) -> DataFrame:
    """Month x tier total MRR, missing cells 0, month order; NULL tier left out."""
    tiers = sorted(tiers)
    zero = F.lit(0).cast("decimal(18,2)")
    wide = _listed(mix, tiers).groupBy("month_start").pivot("plan_tier", tiers).agg(F.sum("total_mrr").cast("decimal(18,2)"))
    return wide.select("month_start", *[F.coalesce(F.col(f"`{t}`"), zero).alias(t) for t in tiers]).orderBy("month_start")


def mix_stack_offsets(mix: DataFrame, tiers: list[str]) -> DataFrame:
    """(month_start, plan_tier, total_mrr, bottom): bottom = sum of the tiers stacked below.

    Each month's cells are one map with at most a cell for every tier, laid on the tier list."""
    zero = F.lit(0).cast("decimal(18,2)")
    cell = F.struct("plan_tier", F.col("total_mrr").cast("decimal(18,2)"))
    months = _listed(mix, tiers).groupBy("month_start").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    long = months.select("month_start", "cells", F.explode(F.array(*[F.lit(t) for t in sorted(tiers)])).alias("plan_tier"))
    long = long.select("month_start", "plan_tier", F.coalesce(F.col("cells")[F.col("plan_tier")], zero).alias("total_mrr"))
    below = Window.partitionBy("month_start").orderBy("plan_tier").rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("bottom", F.coalesce(F.sum("total_mrr").over(below), zero).cast("decimal(18,2)"))


def scoreboard_trend_long(trends: DataFrame) -> DataFrame:
    """(month_start, series, title, value) for the three trend panels."""
    titles = F.create_map(*[F.lit(x) for title, col in TREND_SERIES for x in (col, title)])
    long = trends.unpivot("month_start", [col for _, col in TREND_SERIES], "series", "value")
    return long.select("month_start", "series", titles[F.col("series")].alias("title"), "value")
