"""Registered queries: calendar, snapshot, state, lenses, mix shift, checks, previews."""

from __future__ import annotations

from sublens.operators import calendar, lenses, snapshot, state
from sublens.plans.registry import query
from sublens.sources.tables import Tables


@query("month_bounds")
def q_month_bounds(t: Tables):
    return calendar.month_bounds(t.subscriptions)


@query("month_calendar")
def q_month_calendar(t: Tables):
    return calendar.month_calendar(t.subscriptions)


@query("subscriptions_active_at_eom")
def q_active(t: Tables):
    return snapshot.active_month_rows(t.subscriptions).select(
        "month_start", "month_end", "account_id", "subscription_id", "plan_tier", "seats", "mrr_amount",
        "start_date", "end_date")


@query("account_mrr_month")
def q_snapshot(t: Tables):
    return snapshot.account_mrr_month(t.subscriptions)


@query("account_mrr_month_top10")
def q_snapshot_top(t: Tables):
    return snapshot.account_mrr_month_top(snapshot.account_mrr_month(t.subscriptions), 10)


@query("account_month_spine")
def q_spine(t: Tables):
    return state.account_month_spine(t.subscriptions)


@query("account_month_state")
def q_state(t: Tables):
    return state.account_month_state(t)


@query("usage_by_account_month")
def q_usage(t: Tables):
    return state.usage_by_account_month(t)


@query("account_activity_state")
def q_activity_state(t: Tables):
    return state.account_activity_state(t)


@query("logo_churn_month")
def q_logo(t: Tables):
    return lenses.logo_churn_month(t)


@query("revenue_waterfall_month")
def q_waterfall(t: Tables):
    return lenses.revenue_waterfall_month(t)


@query("activity_churn_month")
def q_activity(t: Tables):
    return lenses.activity_churn_month(t)


@query("churn_scoreboard_month")
def q_scoreboard(t: Tables):
    return lenses.churn_scoreboard_month(t)


@query("mix_shift_by_plan_month")
def q_mix(t: Tables):
    return lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(t.subscriptions))


@query("check_mrr_reconciliation")
def q_check_mrr(t: Tables):
    return lenses.check_mrr_reconciliation(lenses.revenue_waterfall_month(t))


@query("check_customer_reconciliation")
def q_check_customers(t: Tables):
    return lenses.check_customer_reconciliation(lenses.logo_churn_month(t))


@query("preview_logo")
def q_preview_logo(t: Tables):
    return lenses.preview(lenses.logo_churn_month(t), 50)


@query("preview_waterfall")
def q_preview_waterfall(t: Tables):
    return lenses.preview(lenses.revenue_waterfall_month(t), 50)


@query("preview_activity")
def q_preview_activity(t: Tables):
    return lenses.preview(lenses.activity_churn_month(t), 50)


@query("preview_scoreboard")
def q_preview_scoreboard(t: Tables):
    return lenses.preview(lenses.churn_scoreboard_month(t), 10)


@query("preview_mix")
def q_preview_mix(t: Tables):
    return lenses.preview(lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(t.subscriptions)), None)
