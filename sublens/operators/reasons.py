"""Churn reasons by plan tier at the churn month.

The first non-reactivation reason per account is a MIN over a struct ordered by
(churn_date, churn_event_id): a partial aggregate, so an account with a huge event
history is reduced inside each task instead of being sorted in one window partition.
The tier at churn comes from the cohort row of the churn month itself (the snapshot row
the published join would look up), so no join back to the snapshot is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sublens.functions.columns import count_if, ratio
from sublens.operators.drivers import observed_prev_mrr

UNKNOWN_REASON = "unknown"


def churned_accounts(snapshot: DataFrame) -> DataFrame:
    """D37 (+ tier): account_id, churn_month, plan_tier of the churn-month snapshot row.

    A churn month is the first of its run, so runs of a calendar snapshot need no months."""
    lagged = observed_prev_mrr(snapshot).filter(F.col("account_id").isNotNull())
    dropped = lagged.filter((F.col("prev_mrr") > 0) & (F.col("mrr_amount") == 0))
    nth = F.row_number().over(Window.partitionBy("account_id").orderBy("month_start"))
    return dropped.withColumn("nth", nth).filter("nth = 1").select("account_id", F.col("month_start").alias("churn_month"), "plan_tier")


def first_churn_reason(churn_events: DataFrame) -> DataFrame:
    """Per account the earliest non-reactivation churn event (NULL is_reactivation = false);
    ties on churn_date go to the lower churn_event_id."""
    first = F.min(F.struct(F.col("churn_date").isNull().alias("undated"), "churn_date", "churn_event_id",
                           "reason_code")).alias("e")
    return (churn_events.filter(~F.coalesce("is_reactivation", F.lit(False)))
            .groupBy("account_id").agg(first)
            .select("account_id", "e.reason_code", "e.churn_date"))


def churn_reason_rows(snapshot: DataFrame, churn_events: DataFrame) -> DataFrame:
    """Churned accounts with tier at churn and their first reason (joined by account only)."""
    reasons = first_churn_reason(churn_events).select("account_id", "reason_code")
    return churned_accounts(snapshot).join(reasons, "account_id", "left").select(
        "account_id", "churn_month", "plan_tier", "reason_code")


def reason_code_by_tier(rows: DataFrame) -> DataFrame:
    """D40 + D41: distinct churned accounts per (tier, reason), the tier total and the share.

    The published tier total is re-joined with a plain '=', which drops the NULL tier; the
    filter states that directly.  The total is a window sum over the per-(tier, reason)
    counts, a relation of #tiers x #reasons rows.
    """
    counts = (rows.filter(F.col("plan_tier").isNotNull())
              .groupBy("plan_tier", F.coalesce("reason_code", F.lit(UNKNOWN_REASON)).alias("reason_code"))
              .agg(F.countDistinct("account_id").alias("churned_accounts")))
    total = F.sum("churned_accounts").over(Window.partitionBy("plan_tier"))
    return (counts.withColumn("tier_churned_accounts", total.cast("bigint"))
            .withColumn("share_within_tier", ratio("churned_accounts", "tier_churned_accounts")))


def reason_share_sum(by_tier: DataFrame) -> DataFrame:
    """share_within_tier summed per tier (1 up to rounding)."""
    return by_tier.groupBy("plan_tier").agg(F.sum("share_within_tier").alias("share_sum"))


def reason_missing(rows: DataFrame) -> DataFrame:
    """Churned accounts, of these with no tier at churn, with no reason."""
    return rows.agg(F.count(F.lit(1)).alias("churned_accounts"),
                    count_if(F.col("plan_tier").isNull()).alias("missing_plan_tier"),
                    count_if(F.col("reason_code").isNull()).alias("missing_reason_code"))
