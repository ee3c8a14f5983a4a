"""Support and usage per account-month, pre-churn cohorts and the driver table.

Raw event tables are only ever aggregated (map-side partial aggregation first), so a hot
account or subscription is reduced to one row per month inside each task before any
shuffle.  Windows run on the month-end snapshot, which holds at most one row per
account and calendar month, so every window partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sublens.functions.columns import average, count_if, month_diff, month_of
from sublens.operators.state import account_month_flows, run_months
from sublens.sources.tables import Tables

# Priorities that count as high (after lower + trim), cohort labels.
HIGH_PRIORITY = ("high", "urgent")
RETAINED, CHURN_MONTH, PRE_CHURN, OTHER = "retained", "churn_month", "pre_churn_3m", "other"
PRE_CHURN_MONTHS = (1, 3)
MASKS, MASK_BITS = 2, 63  # longs that hold the features of a group, and features a long
BUCKETS = 1024  # of feature names beyond those


def support_account_month(tickets: DataFrame, high_priority: tuple[str, ...] = HIGH_PRIORITY) -> DataFrame:
    """D1 + D2: ticket metrics per (month_start, account_id) of submission."""
    closed = F.col("closed_at").isNotNull()
    return (tickets.groupBy(month_of("submitted_at").alias("month_start"), "account_id")
            .agg(F.count(F.lit(1)).alias("tickets_opened"),
                 count_if(closed).alias("tickets_closed"),
                 average("resolution_time_hours", closed).alias("avg_resolution_hours"),
                 average("first_response_time_minutes").alias("avg_first_response_minutes"),
                 average("satisfaction_score").alias("avg_satisfaction_score"),
                 count_if(F.lower(F.trim("priority")).isin(*high_priority)).alias("high_priority_tickets"),
                 count_if(F.col("escalation_flag") == F.lit(True)).alias("escalated_tickets")))


def support_distribution(support: DataFrame) -> DataFrame:
    """D5."""
    return support.agg(average("tickets_opened").alias("avg_tickets_opened"),
                       F.max("tickets_opened").alias("max_tickets_opened"),
                       average("high_priority_tickets").alias("avg_high_priority"),
                       average("escalated_tickets").alias("avg_escalated"))


def usage_account_month(tables: Tables) -> DataFrame:
    """Total usage, distinct features and active flag per (month_start, account_id).

    The features of a group are a bitmap: the first MASKS * MASK_BITS feature names are numbered (an
    exact dictionary, at most that many rows, hence broadcast) and a usage row carries its
    feature's number to the subscriptions (a key with most rows is split by AQE), where it becomes
    a bit in one of MASKS longs.  Bitmaps merge with OR in the tasks of the join, before the one
    shuffle by (month, account); none is spent on telling features apart.  Names beyond
    the dictionary, if there are any, are counted as distinct rows and added.
    """
    usage = tables.feature_usage_raw.select("subscription_id", month_of("usage_date").alias("month_start"), "feature_name", F.coalesce("usage_count", F.lit(0)).alias("use"))
    names = tables.feature_usage_raw.select("feature_name").where("feature_name is not null").distinct()
    number = F.row_number().over(Window.orderBy("feature_name")) - 1
    known = F.broadcast(names.orderBy("feature_name").limit(MASKS * MASK_BITS).select("feature_name", number.alias("number")))
    bit = F.expr(f"shiftleft(1L, number % {MASK_BITS})")
    masks = [f"mask_{i}" for i in range(MASKS)]
    merged = [F.bit_or(m).alias(m) for m in masks]
    subs = tables.subscriptions.select("subscription_id", "account_id")
    rows = (usage.join(known, "feature_name", "left").drop("feature_name").join(subs, "subscription_id")
            .select("month_start", "account_id", "use", *[F.when(F.floor(F.col("number") / MASK_BITS) == i, bit).alias(m) for i, m in enumerate(masks)], F.lit(0).alias("beyond")))
    # Hash buckets of the names beyond: at most BUCKETS rows, and none ends the branch at run time
    # before it reads the usage.
    bucket = F.pmod(F.xxhash64("feature_name"), F.lit(BUCKETS)).alias("bucket")
    more = F.broadcast(names.join(known, "feature_name", "left_anti").select(bucket).distinct())
    beyond = (usage.where("feature_name is not null").select("*", bucket).join(more, "bucket", "left_semi").join(known, "feature_name", "left_anti")
              .select("subscription_id", "month_start", "feature_name").distinct().join(subs, "subscription_id")
              .select("month_start", "account_id", "feature_name").distinct()
              .select("month_start", "account_id", F.lit(0).alias("use"), *[F.lit(None).cast("bigint").alias(m) for m in masks], F.lit(1).alias("beyond")))
    distinct = sum((F.bit_count(F.coalesce(m, F.lit(0).cast("bigint"))) for m in masks), F.col("beyond"))
    return (rows.unionByName(beyond).groupBy("month_start", "account_id")
            .agg(F.sum("use").cast("bigint").alias("total_usage_count"), *merged, F.sum("beyond").alias("beyond"))
            .select("month_start", "account_id", "total_usage_count", distinct.cast("bigint").alias("distinct_features_used"),
                    F.when(F.col("total_usage_count") > 0, 1).otherwise(0).alias("active_flag")))


def usage_distribution(usage: DataFrame) -> DataFrame:
    """D9."""
    return usage.agg(average("total_usage_count").alias("avg_total_usage"),
                     F.max("total_usage_count").alias("max_total_usage"),
                     average("distinct_features_used").alias("avg_distinct_features"),
                     F.max("distinct_features_used").alias("max_distinct_features"))


def _by_account() -> Window:
    return Window.partitionBy("account_id")


def observed_prev_mrr(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows + prev_mrr = MRR of the account's previous *observed* month (0 first).
    Over the runs of a calendar snapshot, that of the month before the run."""
    w = _by_account().orderBy("month_start")
    return snapshot.withColumn("prev_mrr", F.lag("mrr_amount", 1, 0).over(w).cast("decimal(12,2)"))


def _is_churn(prev: Column, mrr: Column) -> Column:
    return (prev > 0) & (mrr == 0)


def first_churn_month(snapshot: DataFrame, basis: str = "observed", tables: Tables | None = None) -> DataFrame:
    """(account_id, churn_month) = first month where a payer drops to 0 MRR.

    basis='observed' (the published rule) compares each snapshot row with the account's
    previous *observed* month, so an account that simply disappears never churns.
    basis='calendar' compares with the previous calendar month, as the logo-churn lens
    does (a month without a snapshot row counts as 0 MRR); it needs `tables`.
    """
    if basis == "observed":
        rows = observed_prev_mrr(snapshot)
    elif basis == "calendar":
        if tables is None:
            raise ValueError("basis='calendar' needs the tables")
        rows = (account_month_flows(tables, snapshot, with_usage=False)
                .select("account_id", "month_start",
                        F.coalesce("mrr_amount", F.lit(0).cast("decimal(12,2)")).alias("mrr_amount"),
                        F.coalesce("prev_mrr", F.lit(0).cast("decimal(12,2)")).alias("prev_mrr")))
    else:
        raise ValueError("basis must be 'observed' or 'calendar'")
    return (rows.filter(_is_churn(F.col("prev_mrr"), F.col("mrr_amount")))
            .groupBy("account_id").agg(F.min("month_start").alias("churn_month")))


def cohorts_with_tier(snapshot: DataFrame) -> DataFrame:
    """D12 with plan_tier kept: snapshot rows up to the churn month, labelled; runs of a calendar
    snapshot become months here, none after the churn month.

    The churn month is a window minimum over the same account partition as the LAG, so
    no join back is needed.  A NULL account never matches a churn month (SQL equality).
    """
    lagged = observed_prev_mrr(snapshot)
    whole = _by_account()
    churn = F.min(F.when(_is_churn(F.col("prev_mrr"), F.col("mrr_amount")), F.col("month_start"))).over(whole)
    rows = (run_months(lagged.withColumn("churn_month", F.when(F.col("account_id").isNotNull(), churn)), last=F.col("churn_month"))
            .withColumn("months_to_churn", month_diff("churn_month", "month_start")))
    lo, hi = PRE_CHURN_MONTHS
    label = (F.when(F.col("churn_month").isNull(), F.lit(RETAINED))
             .when(F.col("months_to_churn") == 0, F.lit(CHURN_MONTH))
             .when(F.col("months_to_churn").between(lo, hi), F.lit(PRE_CHURN))
             .otherwise(F.lit(OTHER)))
    return rows.withColumn("cohort_label", label)


def account_month_cohorts(snapshot: DataFrame) -> DataFrame:
    """month_start, account_id, mrr_amount, prev_mrr, churn_month, months_to_churn, cohort_label."""
    return cohorts_with_tier(snapshot).select("month_start", "account_id", "mrr_amount", "prev_mrr", "churn_month",
                                              "months_to_churn", "cohort_label")


def cohort_negative(cohorts: DataFrame) -> DataFrame:
    """D14."""
    return cohorts.filter(F.col("months_to_churn") < 0).agg(F.count(F.lit(1)).alias("negative_months"))


def cohort_counts(cohorts: DataFrame) -> DataFrame:
    """D15."""
    return cohorts.groupBy("cohort_label").agg(F.count(F.lit(1)).alias("row_count"),
                                               F.countDistinct("account_id").alias("accounts"))


def cohort_sample(cohorts: DataFrame, n: int = 10) -> DataFrame:
    """Latest churn-month rows (tie-break account_id)."""
    return (cohorts.filter(F.col("cohort_label") == CHURN_MONTH)
            .select("account_id", "month_start", "prev_mrr", "mrr_amount", "churn_month", "months_to_churn")
            .orderBy(F.col("month_start").desc_nulls_first(), F.col("account_id").asc_nulls_last())
            .limit(n))


def attach_activity(rows: DataFrame, support: DataFrame, usage: DataFrame) -> DataFrame:
    """Left join support and usage metrics on (account_id, month_start); counts default to 0,
    averages stay NULL, active_flag recomputed from the defaulted usage."""
    s = support.select("account_id", "month_start", "tickets_opened", "high_priority_tickets",
                       "escalated_tickets", "avg_resolution_hours", "avg_first_response_minutes",
                       "avg_satisfaction_score")
    u = usage.select("account_id", "month_start", "total_usage_count", "distinct_features_used")
    zero = F.lit(0).cast("bigint")
    j = rows.join(s, ["account_id", "month_start"], "left").join(u, ["account_id", "month_start"], "left")
    total = F.coalesce("total_usage_count", zero)
    return j.select(*rows.columns,
                    F.coalesce("tickets_opened", zero).alias("tickets_opened"),
                    F.coalesce("high_priority_tickets", zero).alias("high_priority_tickets"),
                    F.coalesce("escalated_tickets", zero).alias("escalated_tickets"),
                    "avg_resolution_hours", "avg_first_response_minutes", "avg_satisfaction_score",
                    total.alias("total_usage_count"),
                    F.coalesce("distinct_features_used", zero).alias("distinct_features_used"),
                    F.when(total > 0, 1).otherwise(0).alias("active_flag"))


def churn_driver_rows(tables: Tables, snapshot: DataFrame,
                      labels: tuple[str, ...] = (RETAINED, PRE_CHURN)) -> DataFrame:
    """Retained and pre-churn account-months with their support and usage metrics."""
    spine = (account_month_cohorts(snapshot).filter(F.col("cohort_label").isin(*labels))
             .select("month_start", "account_id", "cohort_label"))
    return attach_activity(spine, support_account_month(tables.support_tickets), usage_account_month(tables))


DRIVER_AVERAGES = (("tickets_opened", "avg_tickets_opened"),
                   ("high_priority_tickets", "avg_high_priority_tickets"),
                   ("escalated_tickets", "avg_escalated_tickets"),
                   ("avg_resolution_hours", "avg_resolution_hours"),
                   ("avg_first_response_minutes", "avg_first_response_minutes"),
                   ("avg_satisfaction_score", "avg_satisfaction_score"),
                   ("total_usage_count", "avg_total_usage_count"),
                   ("distinct_features_used", "avg_distinct_features_used"),
                   ("active_flag", "share_active"))


def churn_driver_table(rows: DataFrame) -> DataFrame:
    """Per cohort label, rows, distinct accounts and unweighted averages of the
    account-month values (averages of averages, as defined)."""
    return rows.groupBy("cohort_label").agg(
        F.count(F.lit(1)).alias("account_month_rows"),
        F.countDistinct("account_id").alias("accounts"),
        *[average(src).alias(dst) for src, dst in DRIVER_AVERAGES])
