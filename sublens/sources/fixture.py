"""Derive the five subscription tables from the driver's TPC-H-style parquet tables.

The recipe is FIXTURES.md section 2; the DuckDB oracle builds the same rows from the same
files (sublens.plans.oracle).  Every table is a narrow projection of one driver table
(accounts additionally joins the 25-row nation dimension), so the derivation is a
map-only stage that scales with the input and never shuffles the fact tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sublens.sources.schemas import (
    ACCOUNTS, CHURN_EVENTS, FEATURE_USAGE, SUBSCRIPTIONS, SUPPORT_TICKETS, enforce,
)
from sublens.sources.tables import Tables

# Fixed values of the recipe (FIXTURES.md section 2), kept together in natural order.
ORIGIN_DATE = "1995-01-01"
REFERRAL_SOURCES = ("organic", "ads", "partner", "event")           # by custkey % 4
PLAN_TIERS = ("Basic", "Pro", "Enterprise")                          # by key % 3
BILLING_FREQUENCIES = ("monthly", "annual")                          # by orderkey % 2
TICKET_PRIORITY = {"error": " Urgent ", "purchase": "HIGH", "view": "low", "click": "medium"}
REASON_BY_ORDER_PRIORITY = {"1-URGENT": "pricing", "2-HIGH": "support",
                            "3-MEDIUM": "features", "5-LOW": "budget"}
FEEDBACK_PREFIX = 'said "too dear", order '


def key_text(letter: str, k: Column) -> Column:
    """'<letter>-' followed by the key left-padded with zeros to 9 characters."""
    return F.concat(F.lit(f"{letter}-"), F.lpad(k.cast("string"), 9, "0"))


def pick(k: Column, values: tuple[str, ...]) -> Column:
    """values[k % len(values)]."""
    m = k % len(values)
    expr = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(m == i, F.lit(v))
    return expr


def lookup(c: Column, mapping: dict[str, str]) -> Column:
    items = list(mapping.items())
    expr = F.when(c == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(c == k, F.lit(v))
    return expr


def day_offset(days: Column) -> Column:
    return F.date_add(F.lit(ORIGIN_DATE).cast("date"), days.cast("int"))


def accounts_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
    return enforce(joined.select(
        key_text("A", k).alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("country"),
        day_offset((k * 11) % 2400).alias("signup_date"),
        pick(k, REFERRAL_SOURCES).alias("referral_source"),
        pick(k, PLAN_TIERS).alias("plan_tier"),
        (1 + k % 200).alias("seats"),
        (k % 17 == 0).alias("is_trial"),
        (k % 5 == 0).alias("churn_flag"),
    ), ACCOUNTS)


def subscriptions_from(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    end = (F.when(k % 1000 == 3, F.date_sub(start, 1))
           .when((F.col("o_orderstatus") == "O") & (k % 4 == 0), F.lit(None).cast("date"))
           .otherwise(F.date_add(start, (20 + (k * 13) % 180).cast("int"))))
    mrr = (F.when(k % 9 == 0, F.lit(0).cast("decimal(12,2)"))
           .when(k % 97 == 0, F.lit(None).cast("decimal(12,2)"))
           .otherwise((19 + (k * 37) % 4000).cast("decimal(12,2)")))
    return enforce(orders.select(
        key_text("S", k).alias("subscription_id"),
        key_text("A", F.col("o_custkey")).alias("account_id"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.when(k % 50 == 0, F.lit(None).cast("string")).otherwise(pick(k, PLAN_TIERS)).alias("plan_tier"),
        (1 + k % 200).alias("seats"),
        mrr.alias("mrr_amount"),
        (mrr * 12).cast("decimal(12,2)").alias("arr_amount"),
        (k % 9 == 0).alias("is_trial"),
        (k % 6 == 1).alias("upgrade_flag"),
        (k % 6 == 2).alias("downgrade_flag"),
        end.isNotNull().alias("churn_flag"),
        pick(k, BILLING_FREQUENCIES).alias("billing_frequency"),
        (k % 2 == 0).alias("auto_renew_flag"),
    ), SUBSCRIPTIONS)


def feature_usage_from(lineitem: DataFrame) -> DataFrame:
    p = F.col("l_partkey")
    return enforce(lineitem.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("usage_id"),
        key_text("S", F.col("l_orderkey")).alias("subscription_id"),
        F.col("l_shipdate").cast("date").alias("usage_date"),
        F.concat(F.lit("feature_"), (p % 40).cast("string")).alias("feature_name"),
        F.when(p % 23 == 0, F.lit(None).cast("int"))
         .when(p % 11 == 0, F.lit(0))
         .otherwise(F.col("l_quantity").cast("int")).alias("usage_count"),
        (60 + (p * 7) % 3600).alias("usage_duration_secs"),
        (F.col("l_linenumber") % 3).alias("error_count"),
        (p % 10 == 0).alias("is_beta_feature"),
    ), FEATURE_USAGE)


def support_tickets_from(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    day = (e * 7) % 2600
    return enforce(events.select(
        key_text("T", e).alias("ticket_id"),
        F.when(e % 500 == 7, F.lit("A-unknown"))
         .when(e % 500 == 8, F.lit(None).cast("string"))
         .otherwise(key_text("A", F.col("user_id") * 10 + e % 10)).alias("account_id"),
        day_offset(day).cast("timestamp_ntz").alias("submitted_at"),
        F.when(e % 6 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(day_offset(day + 1 + e % 9).cast("timestamp_ntz")).alias("closed_at"),
        (4 + e % 200).cast("decimal(12,2)").alias("resolution_time_hours"),
        lookup(F.col("event_type"), TICKET_PRIORITY).alias("priority"),
        F.when(e % 13 == 0, F.lit(None).cast("int")).otherwise(((e * 3) % 500).cast("int"))
         .alias("first_response_time_minutes"),
        F.when(e % 3 == 0, F.lit(None).cast("decimal(6,2)")).otherwise((1 + e % 5).cast("decimal(6,2)"))
         .alias("satisfaction_score"),
        F.when(e % 19 == 0, F.lit(None).cast("boolean")).otherwise(F.col("event_type") == "error")
         .alias("escalation_flag"),
    ), SUPPORT_TICKETS)


def churn_events_from(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    return enforce(orders.filter(F.col("o_orderstatus") == "F").select(
        key_text("C", k).alias("churn_event_id"),
        key_text("A", F.col("o_custkey")).alias("account_id"),
        F.date_add(start, (21 + (k * 13) % 180).cast("int")).alias("churn_date"),
        lookup(F.col("o_orderpriority"), REASON_BY_ORDER_PRIORITY).alias("reason_code"),
        (k % 300).cast("decimal(12,2)").alias("refund_amount_usd"),
        (k % 6 == 1).alias("preceding_upgrade_flag"),
        (k % 6 == 2).alias("preceding_downgrade_flag"),
        F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k % 5 == 0).alias("is_reactivation"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(FEEDBACK_PREFIX), k.cast("string"))).alias("feedback_text"),
    ), CHURN_EVENTS)


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The five tables for one scale-factor folder of driver parquet files."""
    return _derive(spark, sf_dir.rstrip("/"))


def _derive(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders")
    return Tables(
        accounts=accounts_from(read("customer"), read("nation")),
        subscriptions=subscriptions_from(orders),
        feature_usage_raw=feature_usage_from(read("lineitem")),
        support_tickets=support_tickets_from(read("events")),
        churn_events=churn_events_from(orders),
    )
