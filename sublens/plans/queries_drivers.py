"""Registered queries: support / usage metrics, cohorts, driver table, change signals, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sublens.functions.columns import round6
from sublens.operators import drivers, quality, reasons, signals, state
from sublens.operators.snapshot import account_mrr, account_mrr_month
from sublens.plans.registry import query
from sublens.sources.tables import Tables


def _snap(t: Tables):
    return account_mrr_month(t.subscriptions)


def _mrr(t: Tables):
    """The snapshot for what needs no plan tier."""
    return account_mrr(t.subscriptions)


# Averages of doubles: their last bits depend on the order of summation, so the registered
# queries round them to be comparable with the oracle; the operators return them unrounded.
TICKET_AVERAGES = ("avg_resolution_hours", "avg_first_response_minutes", "avg_satisfaction_score")
DELTA_AVERAGES = ("avg_usage_delta", "avg_usage_delta_pct", "avg_features_delta", "avg_share_active_delta",
                  "avg_tickets_delta", "avg_tickets_delta_pct", "avg_high_priority_delta", "avg_escalations_delta")


def _comparable(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: round6(c) for c in columns})


def _support(t: Tables):
    return drivers.support_account_month(t.support_tickets)


@query("support_account_month")
def q_support(t: Tables):
    return _support(t)


@query("qc_support_grain")
def q_support_grain(t: Tables):
    return quality.grain_check(_support(t), "month_start", "account_id")


@query("qc_support_range")
def q_support_range(t: Tables):
    return quality.range_check(_support(t))


@query("qc_support_distribution")
def q_support_dist(t: Tables):
    return drivers.support_distribution(_support(t))


@query("usage_account_month")
def q_usage_am(t: Tables):
    return drivers.usage_account_month(t)


@query("qc_usage_grain")
def q_usage_grain(t: Tables):
    return quality.grain_check(drivers.usage_account_month(t), "month_start", "account_id")


@query("qc_usage_range")
def q_usage_range(t: Tables):
    return quality.range_check(drivers.usage_account_month(t))


@query("qc_usage_distribution")
def q_usage_dist(t: Tables):
    return drivers.usage_distribution(drivers.usage_account_month(t))


@query("first_churn_month")
def q_first_churn(t: Tables):
    return drivers.first_churn_month(_mrr(t))


@query("first_churn_month_calendar")
def q_first_churn_calendar(t: Tables):
    return drivers.first_churn_month(_mrr(t), basis="calendar", tables=t)


@query("account_month_cohorts")
def q_cohorts(t: Tables):
    return drivers.account_month_cohorts(_mrr(t))


@query("qc_cohort_grain")
def q_cohort_grain(t: Tables):
    return quality.grain_check(drivers.account_month_cohorts(_mrr(t)), "month_start", "account_id")


@query("qc_cohort_negative")
def q_cohort_negative(t: Tables):
    return drivers.cohort_negative(drivers.account_month_cohorts(_mrr(t)))


@query("qc_cohort_counts")
def q_cohort_counts(t: Tables):
    return drivers.cohort_counts(drivers.account_month_cohorts(_mrr(t)))


@query("qc_cohort_sample")
def q_cohort_sample(t: Tables):
    return drivers.cohort_sample(drivers.account_month_cohorts(_mrr(t)))


@query("churn_driver_rows")
def q_driver_rows(t: Tables):
    return drivers.churn_driver_rows(t, _mrr(t))


@query("churn_driver_table_3m")
def q_driver_table(t: Tables):
    return _comparable(drivers.churn_driver_table(drivers.churn_driver_rows(t, _mrr(t))), TICKET_AVERAGES)


@query("qc_driver_sizes")
def q_driver_sizes(t: Tables):
    return drivers.churn_driver_table(drivers.churn_driver_rows(t, _mrr(t))).select(
        "cohort_label", "account_month_rows", "accounts")


@query("churn_anchors")
def q_anchors(t: Tables):
    return signals.churn_anchors(_mrr(t))


@query("anchor_windows")
def q_anchor_windows(t: Tables):
    return signals.anchor_windows(_mrr(t))


@query("anchor_window_rows")
def q_anchor_window_rows(t: Tables):
    return signals.anchor_window_rows(t, _mrr(t))


@query("anchor_window_rows_as_published")
def q_anchor_window_rows_published(t: Tables):
    return signals.anchor_window_rows_as_published(t, _mrr(t))


@query("anchor_window_averages")
def q_anchor_window_avgs(t: Tables):
    return _comparable(signals.anchor_window_averages(signals.anchor_window_rows(t, _mrr(t))), TICKET_AVERAGES)


@query("anchor_window_averages_as_published")
def q_anchor_window_avgs_published(t: Tables):
    rows = signals.anchor_window_rows_as_published(t, _mrr(t))
    return _comparable(signals.anchor_window_averages_as_published(rows), TICKET_AVERAGES)


def _signals(t: Tables):
    return signals.change_signals_account(signals.anchor_window_rows(t, _mrr(t)))


@query("change_signals_3m_account")
def q_signals(t: Tables):
    return _signals(t)


@query("change_signals_3m_account_as_published")
def q_signals_published(t: Tables):
    return signals.change_signals_account_as_published(t, _mrr(t))


@query("qc_signals_grain")
def q_signals_grain(t: Tables):
    return signals.signals_grain(_signals(t))


@query("qc_signals_anchor_counts")
def q_signals_anchor_counts(t: Tables):
    return signals.signals_anchor_counts(_signals(t))


@query("qc_signals_sample")
def q_signals_sample(t: Tables):
    return signals.signals_sample(_signals(t))


@query("qc_signals_coverage")
def q_signals_coverage(t: Tables):
    return signals.signals_coverage(_signals(t))


@query("change_signals_3m_summary")
def q_signals_summary(t: Tables):
    return _comparable(signals.change_signals_summary(_signals(t)), DELTA_AVERAGES)


@query("change_signals_3m_summary_as_published")
def q_signals_summary_published(t: Tables):
    return _comparable(signals.change_signals_summary(signals.change_signals_account_as_published(t, _mrr(t))), DELTA_AVERAGES)


@query("change_signals_with_tier")
def q_signals_tier(t: Tables):
    return signals.change_signals_with_tier(t, _snap(t))


@query("change_signals_3m_summary_by_tier")
def q_signals_by_tier(t: Tables):
    return _comparable(signals.change_signals_summary_by_tier(signals.change_signals_with_tier(t, _snap(t))), DELTA_AVERAGES)


@query("change_signals_with_tier_as_published")
def q_signals_tier_published(t: Tables):
    return signals.change_signals_with_tier(t, _snap(t), as_published=True)


@query("change_signals_3m_summary_by_tier_as_published")
def q_signals_by_tier_published(t: Tables):
    with_tier = signals.change_signals_with_tier(t, _snap(t), as_published=True)
    return _comparable(signals.change_signals_summary_by_tier(with_tier), DELTA_AVERAGES)


@query("qc_tier_counts_as_published")
def q_tier_counts_published(t: Tables):
    return signals.tier_counts(signals.change_signals_with_tier(t, _snap(t), as_published=True))


@query("qc_tier_counts")
def q_tier_counts(t: Tables):
    return signals.tier_counts(signals.change_signals_with_tier(t, _snap(t)))


@query("first_churn_reason")
def q_first_reason(t: Tables):
    return reasons.first_churn_reason(t.churn_events)


@query("churn_reason_rows")
def q_reason_rows(t: Tables):
    return reasons.churn_reason_rows(_snap(t), t.churn_events)


@query("reason_code_by_tier")
def q_reason_by_tier(t: Tables):
    return reasons.reason_code_by_tier(reasons.churn_reason_rows(_snap(t), t.churn_events))


@query("qc_reason_share_sum")
def q_reason_share(t: Tables):
    by_tier = reasons.reason_code_by_tier(reasons.churn_reason_rows(_snap(t), t.churn_events))
    return _comparable(reasons.reason_share_sum(by_tier), ("share_sum",))


@query("qc_reason_missing")
def q_reason_missing(t: Tables):
    return reasons.reason_missing(reasons.churn_reason_rows(_snap(t), t.churn_events))


# The same over the calendar churn basis.
def _calendar(t: Tables, snapshot: DataFrame | None = None):
    return state.calendar_snapshot(t, _snap(t) if snapshot is None else snapshot)


@query("account_month_cohorts_calendar")
def q_cohorts_calendar(t: Tables):
    return drivers.account_month_cohorts(_calendar(t, _mrr(t)))


@query("churn_anchors_calendar")
def q_anchors_calendar(t: Tables):
    return signals.churn_anchors(_calendar(t, _mrr(t)))


@query("change_signals_with_tier_calendar")
def q_signals_tier_calendar(t: Tables):
    return signals.change_signals_with_tier(t, _calendar(t))


@query("change_signals_3m_summary_by_tier_calendar")
def q_signals_by_tier_calendar(t: Tables):
    with_tier = signals.change_signals_with_tier(t, _calendar(t))
    return _comparable(signals.change_signals_summary_by_tier(with_tier), DELTA_AVERAGES)


@query("reason_code_by_tier_calendar")
def q_reason_by_tier_calendar(t: Tables):
    return reasons.reason_code_by_tier(reasons.churn_reason_rows(_calendar(t), t.churn_events))
