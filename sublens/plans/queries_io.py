"""Registered queries: CSV loaders, reload, named views, extracts, notebook frames, profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sublens.operators import extracts, lenses, quality, snapshot
from sublens.plans.registry import query
from sublens.session import scratch_path
from sublens.sources import csv_io
from sublens.sources.fixture import PLAN_TIERS
from sublens.sources.tables import Tables

HIGHLIGHT_MONTH = "1998-09-01"  # a month of the test data's calendar


def _loader(table: str, drop: tuple[str, ...] = ()):
    def fn(t: Tables, spark: SparkSession):
        return csv_io.round_trip(spark, t, table).drop(*drop)
    fn.__doc__ = f"CSV round trip of {table} through the typed FAILFAST reader."
    return fn


query("load_accounts")(_loader("accounts"))
query("load_subscriptions")(_loader("subscriptions"))
# row_id is generated at load and differs between engines; it is compared without it.
query("load_feature_usage")(_loader("feature_usage_raw", drop=("row_id",)))
query("load_support_tickets")(_loader("support_tickets"))
query("load_churn_events")(_loader("churn_events"))


@query("reload_idempotent")
def q_reload(t: Tables, spark: SparkSession):
    """Load the CSV export twice into the same warehouse; the counts must not double."""
    csv_folder, warehouse = scratch_path(spark, "export"), scratch_path(spark, "warehouse")
    csv_io.export_tables(t, csv_folder)
    csv_io.reload(spark, csv_folder, warehouse)
    return quality.row_counts(csv_io.reload(spark, csv_folder, warehouse))


@query("reload_streaming")
def q_reload_streaming(t: Tables, spark: SparkSession):
    """Incremental (streaming) load run twice over the same files; counts must not double."""
    from sublens.streaming.landing import load_all_incrementally, read_landed
    csv_folder, warehouse = scratch_path(spark, "export"), scratch_path(spark, "landing")
    csv_io.export_tables(t, csv_folder)
    load_all_incrementally(spark, csv_folder, warehouse)
    paths = load_all_incrementally(spark, csv_folder, warehouse)
    loaded = Tables(**{name: read_landed(spark, name, path) for name, path in paths.items()})
    return quality.row_counts(loaded)


@query("validate_contracts_landed")
def q_validate_landed(t: Tables, spark: SparkSession):
    """Contracts of the tables that the streaming load landed, generated row_id included."""
    from sublens.streaming.landing import load_all_incrementally, read_landed
    csv_folder, warehouse = scratch_path(spark, "export"), scratch_path(spark, "landing")
    csv_io.export_tables(t, csv_folder)
    paths = load_all_incrementally(spark, csv_folder, warehouse)
    return quality.validate_contracts(Tables(**{name: read_landed(spark, name, path) for name, path in paths.items()}))


@query("registered_views")
def q_registered(t: Tables, spark: SparkSession):
    """Scoreboard read back through the view name published by register_all."""
    extracts.register_all(spark, t, materialize=True)
    return spark.table("v_churn_scoreboard_month")


@query("registered_view_counts")
def q_registered_counts(t: Tables, spark: SparkSession):
    """Row count of every published view and table, each read back by its name."""
    names = extracts.register_all(spark, t, materialize=True)
    counts = [spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("view_name"), "row_count")
              for n in names]
    return reduce(DataFrame.unionByName, counts)


@query("extract_scoreboard_trends")
def q_extract_trends(t: Tables):
    return extracts.scoreboard_trends(lenses.churn_scoreboard_month(t))


@query("extract_scoreboard_trends_timestamp")
def q_extract_trends_timestamp(t: Tables):
    return extracts.scoreboard_trends(lenses.churn_scoreboard_month(t), as_timestamp=True)


@query("extract_waterfall_inputs")
def q_extract_waterfall(t: Tables):
    return extracts.waterfall_inputs(lenses.revenue_waterfall_month(t))


@query("extract_mix_shift")
def q_extract_mix(t: Tables):
    return extracts.mix_extract(lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(t.subscriptions)))


@query("freeze_extract")
def q_freeze(t: Tables, spark: SparkSession):
    return csv_io.freeze(spark, extracts.scoreboard_trends(lenses.churn_scoreboard_month(t)), "scoreboard_trends")


@query("waterfall_for_month")
def q_waterfall_month(t: Tables):
    return extracts.waterfall_for_month(extracts.waterfall_inputs(lenses.revenue_waterfall_month(t)), HIGHLIGHT_MONTH)


@query("waterfall_long")
def q_waterfall_long(t: Tables):
    return extracts.waterfall_long(lenses.revenue_waterfall_month(t))


@query("waterfall_bases")
def q_waterfall_bases(t: Tables):
    return extracts.waterfall_bases(lenses.revenue_waterfall_month(t), "starting")


@query("waterfall_bases_as_published")
def q_waterfall_bases_pub(t: Tables):
    return extracts.waterfall_bases(lenses.revenue_waterfall_month(t), "zero")


def _mix(t: Tables):
    return lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(t.subscriptions))


@query("mix_pivot")
def q_mix_pivot(t: Tables):
    return extracts.mix_pivot(_mix(t), list(PLAN_TIERS))


@query("mix_stack_offsets")
def q_mix_offsets(t: Tables):
    return extracts.mix_stack_offsets(_mix(t), list(PLAN_TIERS))


@query("scoreboard_trend_long")
def q_trend_long(t: Tables):
    return extracts.scoreboard_trend_long(extracts.scoreboard_trends(lenses.churn_scoreboard_month(t)))


for _name, _fn in (("profile_row_counts", quality.row_counts),
                   ("profile_key_duplicates", quality.key_duplicates),
                   ("profile_nulls_subscriptions", quality.nulls_subscriptions),
                   ("profile_nulls_usage", quality.nulls_usage),
                   ("profile_nulls_churn_events", quality.nulls_churn_events),
                   ("profile_nulls_support", quality.nulls_support),
                   ("profile_bad_intervals", quality.bad_intervals),
                   ("profile_subscription_range", quality.subscription_range),
                   ("profile_usage_range", quality.usage_range),
                   ("orphans_subscriptions", quality.orphans_subscriptions),
                   ("orphans_usage", quality.orphans_usage),
                   ("orphans_churn_events", quality.orphans_churn_events),
                   ("orphans_support", quality.orphans_support),
                   ("profile_usage_duplicates", quality.usage_duplicates),
                   ("validate_contracts", quality.validate_contracts)):
    query(_name)(lambda t, _f=_fn: _f(t))
