"""3-month change signals around each account's anchor month.

Anchor = first observed churn month, else the last observed month.  Months 1-3 before
the anchor form the recent window, 4-6 the prior window (the anchor month itself is
excluded; only observed snapshot months count).

Everything up to the window labels (observed LAG, first churn, last month, anchor, tier at
the anchor) is computed with window functions over one account partition of the snapshot
(at most one row per calendar month each), so no join back to per-account aggregates is
needed.  The recent/prior pivot is folded into the per-account aggregate: the average of
a window is AVG(CASE WHEN label = w THEN x END), one groupBy instead of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sublens.functions.columns import average, count_if, month_diff, ratio, share
from sublens.operators.drivers import (
    attach_activity, observed_prev_mrr, support_account_month, usage_account_month,
)
from sublens.operators.state import run_end, run_months
from sublens.sources.tables import Tables

# Fixed labels.
RECENT, PRIOR = "recent_3m", "prior_3m"
CHURNED, RETAINED = "churned", "retained"

# (metric in the joined rows, name stem in the account signal table, has pct delta)
SIGNALS = (("tickets_opened", "tickets", True),
           ("high_priority_tickets", "high_priority", True),
           ("escalated_tickets", "escalations", True),
           ("total_usage_count", "usage", True),
           ("distinct_features_used", "features", False),
           ("active_flag", "share_active", False))
WINDOW_AVERAGES = (("tickets_opened", "avg_tickets_opened"),
                   ("high_priority_tickets", "avg_high_priority_tickets"),
                   ("escalated_tickets", "avg_escalated_tickets"),
                   ("avg_resolution_hours", "avg_resolution_hours"),
                   ("avg_first_response_minutes", "avg_first_response_minutes"),
                   ("avg_satisfaction_score", "avg_satisfaction_score"),
                   ("total_usage_count", "avg_total_usage_count"),
                   ("distinct_features_used", "avg_distinct_features_used"),
                   ("active_flag", "share_active"))
KEYS = ("account_id", "anchor_type", "anchor_month")
JOINED_SUMS = ("total_usage_count", "distinct_features_used", "active_flag")


def snapshot_with_anchor(snapshot: DataFrame) -> DataFrame:
    """D20 + D21 per snapshot row: churn_month, last_month, anchor_month, anchor_type, and
    the plan tier at the anchor month (D34, if the snapshot has tiers), all as window
    aggregates per account.  Runs of a calendar snapshot stay runs."""
    lagged = observed_prev_mrr(snapshot)
    whole = Window.partitionBy("account_id")
    end = run_end(snapshot)
    is_churn = (F.col("prev_mrr") > 0) & (F.col("mrr_amount") == 0)
    # A NULL account never matches first_churn in the published join: it stays retained.
    churn = F.when(F.col("account_id").isNotNull(), F.min(F.when(is_churn, F.col("month_start"))).over(whole))
    out = (lagged.withColumn("churn_month", churn)
           .withColumn("last_month", F.max(end).over(whole))
           .withColumn("anchor_month", F.coalesce("churn_month", "last_month"))
           .withColumn("anchor_type", F.when(F.col("churn_month").isNull(), F.lit(RETAINED)).otherwise(F.lit(CHURNED))))
    out = out.withColumn("at_anchor", F.col("anchor_month").between(F.col("month_start"), end))
    if "plan_tier" not in snapshot.columns:
        return out
    return out.withColumn("anchor_tier", F.max(F.when(F.col("at_anchor"), F.col("plan_tier"))).over(whole))


def churn_anchors(snapshot: DataFrame) -> DataFrame:
    """One row per account: account_id, churn_month, last_month, anchor_month, anchor_type."""
    return (snapshot_with_anchor(snapshot)
            .filter("at_anchor")
            .select("account_id", "churn_month", "last_month", "anchor_month", "anchor_type"))


def anchor_windows(snapshot: DataFrame, with_tier: bool = False) -> DataFrame:
    """Observed months 1-6 before the anchor, labelled recent_3m / prior_3m."""
    anchored = snapshot_with_anchor(snapshot).filter(F.col("account_id").isNotNull())
    rows = (run_months(anchored, F.add_months("anchor_month", -6), F.add_months("anchor_month", -1))
            .withColumn("months_to_anchor", month_diff("anchor_month", "month_start"))
            .withColumn("window_label", F.when(F.col("months_to_anchor") <= 3, F.lit(RECENT)).otherwise(F.lit(PRIOR))))
    cols = ["month_start", "account_id", "anchor_type", "anchor_month", "months_to_anchor", "window_label"]
    return rows.select(*cols, *(["anchor_tier"] if with_tier else []))


def anchor_window_rows(tables: Tables, snapshot: DataFrame, with_tier: bool = False) -> DataFrame:
    """D23 (own-month join): window rows with the support and usage of the same month."""
    return attach_activity(anchor_windows(snapshot, with_tier),
                           support_account_month(tables.support_tickets), usage_account_month(tables))


def anchor_window_averages(rows: DataFrame) -> DataFrame:
    """Per (account, anchor, window) averages of the window's observed months."""
    return rows.groupBy(*KEYS, "window_label").agg(*[average(src).alias(dst) for src, dst in WINDOW_AVERAGES])


def _deltas(pivoted: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    cols: list[Column] = [F.col(k) for k in KEYS]
    for _, stem, pct in SIGNALS:
        r, p = F.col(f"{stem}_recent_3m"), F.col(f"{stem}_prior_3m")
        cols += [r, p, (r - p).alias(f"{stem}_delta")]
        if pct:
            cols.append(ratio(r - p, p).alias(f"{stem}_delta_pct"))
    return pivoted.select(*cols, *extra)


def change_signals_account(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per account with recent / prior window averages and their deltas."""
    aggs = []
    for src, stem, _ in SIGNALS:
        for label in (RECENT, PRIOR):
            aggs.append(average(src, F.col("window_label") == label).alias(f"{stem}_{label}"))
    # Extra columns are constant per account (e.g. the tier at the anchor), so they ride
    # along as grouping keys; that keeps the aggregate a hash aggregate.
    return _deltas(rows.groupBy(*KEYS, *extra).agg(*aggs), extra)


def anchor_window_rows_as_published(tables: Tables, snapshot: DataFrame, with_tier: bool = False) -> DataFrame:
    """D23 with the published usage join, one row per window month.

    The published join matches usage on the account only, and only for window months that
    have a ticket row (its month condition compares the ticket month).  A ticketed month
    therefore appears once per usage month of the account (K rows, or 1 when K = 0), each
    carrying that usage month's values; other months appear once with zero usage.  Instead
    of materialising those pairs, each window month carries `join_rows` (its multiplicity)
    and the sums of the usage values over its joined rows, computed from per-account usage
    totals: the same information, linear in the window rows.
    """
    windows = anchor_windows(snapshot, with_tier)
    support = support_account_month(tables.support_tickets).select(
        "account_id", "month_start", "tickets_opened", "high_priority_tickets", "escalated_tickets",
        "avg_resolution_hours", "avg_first_response_minutes", "avg_satisfaction_score")
    per_account = (usage_account_month(tables).filter(F.col("account_id").isNotNull()).groupBy("account_id")
                   .agg(F.count(F.lit(1)).alias("k"), F.sum("total_usage_count").alias("u"),
                        F.sum("distinct_features_used").alias("f"), F.sum("active_flag").alias("a")))
    j = windows.join(support, ["account_id", "month_start"], "left").join(per_account, "account_id", "left")
    ticketed = F.col("tickets_opened").isNotNull()
    zero = F.lit(0).cast("bigint")

    def on_ticket(c: str) -> Column:
        return F.when(ticketed, F.coalesce(F.col(c).cast("bigint"), zero)).otherwise(zero)

    return j.select(
        *windows.columns,
        F.when(ticketed, F.greatest(F.coalesce("k", zero), F.lit(1).cast("bigint"))).otherwise(F.lit(1).cast("bigint"))
        .alias("join_rows"),
        F.coalesce("tickets_opened", zero).alias("tickets_opened"),
        F.coalesce("high_priority_tickets", zero).alias("high_priority_tickets"),
        F.coalesce("escalated_tickets", zero).alias("escalated_tickets"),
        "avg_resolution_hours", "avg_first_response_minutes", "avg_satisfaction_score",
        on_ticket("u").alias("total_usage_count_sum"),
        on_ticket("f").alias("distinct_features_used_sum"),
        on_ticket("a").alias("active_flag_sum"))


def _weighted(src: str, where: Column | None = None) -> Column:
    """Average of a metric over the rows of the published join: each window month counts
    `join_rows` times; usage metrics come as sums over those rows."""
    w = F.col("join_rows")
    num, den = (F.col(f"{src}_sum"), w) if src in JOINED_SUMS else (w * F.col(src), F.when(F.col(src).isNotNull(), w))
    if where is not None:
        num, den = F.when(where, num), F.when(where, den)
    return F.sum(num).cast("double") / F.sum(den).cast("double")


def anchor_window_averages_as_published(rows: DataFrame) -> DataFrame:
    """D24 over anchor_window_rows_as_published."""
    return rows.groupBy(*KEYS, "window_label").agg(*[_weighted(src).alias(dst) for src, dst in WINDOW_AVERAGES])


def change_signals_account_as_published(tables: Tables, snapshot: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """D26 with the published usage join (see anchor_window_rows_as_published)."""
    rows = anchor_window_rows_as_published(tables, snapshot, with_tier="anchor_tier" in extra)
    aggs = [_weighted(src, F.col("window_label") == label).alias(f"{stem}_{label}")
            for src, stem, _ in SIGNALS for label in (RECENT, PRIOR)]
    return _deltas(rows.groupBy(*KEYS, *extra).agg(*aggs), extra)


def signals_grain(signals: DataFrame) -> DataFrame:
    """D27."""
    return signals.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("account_id").alias("distinct_accounts"))


def signals_anchor_counts(signals: DataFrame) -> DataFrame:
    """D28."""
    return signals.groupBy("anchor_type").agg(F.count(F.lit(1)).alias("accounts"))


def signals_sample(signals: DataFrame, n: int = 5) -> DataFrame:
    """The n latest anchors of each type (tie-break account_id); a top-n per type."""
    parts = [signals.filter(F.col("anchor_type") == t)
             .orderBy(F.col("anchor_month").desc_nulls_first(), F.col("account_id").asc_nulls_last()).limit(n)
             for t in (CHURNED, RETAINED)]
    return parts[0].unionByName(parts[1])


def _coverage() -> list[Column]:
    return [F.count(F.lit(1)).alias("accounts"),
            count_if(F.col("usage_recent_3m").isNotNull() & F.col("usage_prior_3m").isNotNull())
            .alias("accounts_with_usage_both_windows"),
            count_if(F.col("tickets_recent_3m").isNotNull() & F.col("tickets_prior_3m").isNotNull())
            .alias("accounts_with_tickets_both_windows"),
            count_if(F.col("usage_prior_3m") > 0).alias("accounts_with_usage_prior_gt_0"),
            count_if(F.col("tickets_prior_3m") > 0).alias("accounts_with_tickets_prior_gt_0")]


def signals_coverage(signals: DataFrame) -> DataFrame:
    """D30."""
    return signals.groupBy("anchor_type").agg(*_coverage())


SUMMARY_COLUMNS = ("anchor_type", "accounts", "accounts_with_usage_both_windows",
                   "accounts_with_tickets_both_windows", "accounts_with_usage_prior_gt_0",
                   "accounts_with_tickets_prior_gt_0", "avg_usage_delta", "avg_usage_delta_pct",
                   "share_usage_declining", "avg_features_delta", "share_features_declining",
                   "avg_share_active_delta", "share_active_declining", "avg_tickets_delta",
                   "avg_tickets_delta_pct", "share_tickets_increasing", "avg_high_priority_delta",
                   "share_high_priority_increasing", "avg_escalations_delta")


def _signal_block() -> list[Column]:
    c = F.col
    return [average("usage_delta").alias("avg_usage_delta"),
            average("usage_delta_pct", c("usage_prior_3m") > 0).alias("avg_usage_delta_pct"),
            share(c("usage_delta") < 0).alias("share_usage_declining"),
            average("features_delta").alias("avg_features_delta"),
            share(c("features_delta") < 0).alias("share_features_declining"),
            average("share_active_delta").alias("avg_share_active_delta"),
            share(c("share_active_delta") < 0).alias("share_active_declining"),
            average("tickets_delta").alias("avg_tickets_delta"),
            average("tickets_delta_pct", c("tickets_prior_3m") > 0).alias("avg_tickets_delta_pct"),
            share(c("tickets_delta") > 0).alias("share_tickets_increasing"),
            average("high_priority_delta").alias("avg_high_priority_delta"),
            share(c("high_priority_delta") > 0).alias("share_high_priority_increasing"),
            average("escalations_delta").alias("avg_escalations_delta")]


def change_signals_summary(signals: DataFrame) -> DataFrame:
    """Coverage and signal blocks by anchor type, in one aggregate (no self-join)."""
    return signals.groupBy("anchor_type").agg(*_coverage(), *_signal_block()).select(*SUMMARY_COLUMNS)


def change_signals_with_tier(tables: Tables, snapshot: DataFrame, as_published: bool = False) -> DataFrame:
    """Account signals + plan_tier of the snapshot row at the anchor month; as_published
    takes the published usage join (see anchor_window_rows_as_published)."""
    extra = ("anchor_tier",)
    signals = (change_signals_account_as_published(tables, snapshot, extra) if as_published
               else change_signals_account(anchor_window_rows(tables, snapshot, with_tier=True), extra))
    return signals.withColumnRenamed("anchor_tier", "plan_tier")


def change_signals_summary_by_tier(with_tier: DataFrame) -> DataFrame:
    """The summary by (anchor_type, plan_tier); a NULL tier is its own group."""
    cols = ("anchor_type", "plan_tier") + SUMMARY_COLUMNS[1:]
    return with_tier.groupBy("anchor_type", "plan_tier").agg(*_coverage(), *_signal_block()).select(*cols)


def tier_counts(with_tier: DataFrame) -> DataFrame:
    """D36."""
    return with_tier.groupBy("anchor_type", "plan_tier").agg(F.count(F.lit(1)).alias("accounts"))
