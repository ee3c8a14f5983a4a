"""Typed contracts of the five subscription tables (column order = file order)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampNTZType,
)

MONEY = DecimalType(12, 2)

ACCOUNTS = StructType([
    StructField("account_id", StringType()),
    StructField("account_name", StringType()),
    StructField("industry", StringType()),
    StructField("country", StringType()),
    StructField("signup_date", DateType()),
    StructField("referral_source", StringType()),
    StructField("plan_tier", StringType()),
    StructField("seats", IntegerType()),
    StructField("is_trial", BooleanType()),
    StructField("churn_flag", BooleanType()),
])

SUBSCRIPTIONS = StructType([
    StructField("subscription_id", StringType()),
    StructField("account_id", StringType()),
    StructField("start_date", DateType()),
    StructField("end_date", DateType()),
    StructField("plan_tier", StringType()),
    StructField("seats", IntegerType()),
    StructField("mrr_amount", MONEY),
    StructField("arr_amount", MONEY),
    StructField("is_trial", BooleanType()),
    StructField("upgrade_flag", BooleanType()),
    StructField("downgrade_flag", BooleanType()),
    StructField("churn_flag", BooleanType()),
    StructField("billing_frequency", StringType()),
    StructField("auto_renew_flag", BooleanType()),
])

# The landing file has no row_id; the loader adds it as a surrogate key.
FEATURE_USAGE_FILE = StructType([
    StructField("usage_id", StringType()),
    StructField("subscription_id", StringType()),
    StructField("usage_date", DateType()),
    StructField("feature_name", StringType()),
    StructField("usage_count", IntegerType()),
    StructField("usage_duration_secs", IntegerType()),
    StructField("error_count", IntegerType()),
    StructField("is_beta_feature", BooleanType()),
])
FEATURE_USAGE = StructType([StructField("row_id", LongType())] + FEATURE_USAGE_FILE.fields)

SUPPORT_TICKETS = StructType([
    StructField("ticket_id", StringType()),
    StructField("account_id", StringType()),
    StructField("submitted_at", TimestampNTZType()),
    StructField("closed_at", TimestampNTZType()),
    StructField("resolution_time_hours", MONEY),
    StructField("priority", StringType()),
    StructField("first_response_time_minutes", IntegerType()),
    StructField("satisfaction_score", DecimalType(6, 2)),
    StructField("escalation_flag", BooleanType()),
])

CHURN_EVENTS = StructType([
    StructField("churn_event_id", StringType()),
    StructField("account_id", StringType()),
    StructField("churn_date", DateType()),
    StructField("reason_code", StringType()),
    StructField("refund_amount_usd", MONEY),
    StructField("preceding_upgrade_flag", BooleanType()),
    StructField("preceding_downgrade_flag", BooleanType()),
    StructField("is_reactivation", BooleanType()),
    StructField("feedback_text", StringType()),
])

FILE_SCHEMAS = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage_raw": FEATURE_USAGE_FILE,
    "support_tickets": SUPPORT_TICKETS,
    "churn_events": CHURN_EVENTS,
}
TABLE_SCHEMAS = dict(FILE_SCHEMAS, feature_usage_raw=FEATURE_USAGE)
TABLE_NAMES = tuple(FILE_SCHEMAS)


@dataclass(frozen=True)
class Contract:
    """Declared constraints of one table; Spark enforces none, validation jobs check them."""
    table: str
    primary_key: str
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = field(default=())  # (column, parent table, parent column)


CONTRACTS = (
    Contract("accounts", "account_id"),
    Contract("subscriptions", "subscription_id", ("start_date",),
             (("account_id", "accounts", "account_id"),)),
    Contract("feature_usage_raw", "row_id", ("usage_date",),
             (("subscription_id", "subscriptions", "subscription_id"),)),
    Contract("support_tickets", "ticket_id", (),
             (("account_id", "accounts", "account_id"),)),
    Contract("churn_events", "churn_event_id", ("churn_date",),
             (("account_id", "accounts", "account_id"),)),
)


def enforce(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns in order, cast to the declared types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
