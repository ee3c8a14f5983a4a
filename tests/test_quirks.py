
from __future__ import annotations

from conftest import churn, d, money, sub, ticket, usage

from sublens.operators import drivers, extracts, lenses, reasons, signals, snapshot, state


def test_q2_observed_and_calendar_churn_bases_differ(make_tables):
    # A gap: paid Jan-Feb, nothing in Mar-Apr, paid again from May.
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-02-29", 100), sub("S2", "A1", "2024-05-01", None, 100)])
    snap = snapshot.account_mrr_month(t.subscriptions)
    observed = drivers.first_churn_month(snap).collect()
    calendar = drivers.first_churn_month(snap, basis="calendar", tables=t).collect()
    assert observed == []
    whole = state.calendar_snapshot(t, snap)
    assert [r.churn_month for r in drivers.first_churn_month(whole).collect()] == [d("2024-03-01")]
    (anchor,) = signals.churn_anchors(whole).collect()
    assert (anchor.anchor_type, anchor.anchor_month) == ("churned", d("2024-03-01"))
    (row,) = reasons.churn_reason_rows(whole, t.churn_events).collect()
    assert (row.churn_month, row.plan_tier) == (d("2024-03-01"), "Basic")  # the tier last paid
    assert [(r.account_id, r.churn_month) for r in calendar] == [("A1", d("2024-03-01"))]


def test_q4_null_tier_is_a_group_in_the_signal_summary(make_tables):
    subs = [sub(f"S{i}", f"A{i}", "2024-01-01", None, 100, tier=None if i == 0 else "Pro") for i in range(3)]
    subs += [sub("S9", "A9", "2024-09-01", "2024-09-30", 100)]  # stretches the calendar
    t = make_tables(subs)
    snap = snapshot.account_mrr_month(t.subscriptions)
    by_tier = signals.change_signals_summary_by_tier(signals.change_signals_with_tier(t, snap)).collect()
    assert {(r.anchor_type, r.plan_tier, r.accounts) for r in by_tier} == {("retained", None, 1), ("retained", "Pro", 2)}


def test_q8_null_delta_counts_as_not_declining(make_tables):
    # A1 has a prior window, A2 only a recent one: its delta is NULL but it stays in the denominator.
    subs = [sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A2", "2024-03-01", None, 100),
            sub("S9", "A9", "2024-05-01", "2024-05-31", 100)]  # stretches the calendar to May
    use = [usage(1, "S1", "2024-01-05", 9)]  # A1: anchor May, prior window = Jan, recent = Feb-Apr
    t = make_tables(subs, use)
    snap = snapshot.account_mrr_month(t.subscriptions)
    sig = signals.change_signals_account(signals.anchor_window_rows(t, snap))
    deltas = {r.account_id: r.usage_delta for r in sig.collect()}
    assert deltas["A2"] is None and deltas["A1"] < 0
    (summary,) = signals.change_signals_summary(sig).collect()
    assert summary.accounts == 2 and summary.share_usage_declining == 0.5


def test_q9_waterfall_bases_start_at_starting_mrr_or_zero(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A2", "2024-02-01", None, 40)])
    wf = lenses.revenue_waterfall_month(t)
    feb = d("2024-02-01")
    own = {r.label: r.base for r in extracts.waterfall_bases(wf, "starting").collect() if r.month_start == feb}
    pub = {r.label: r.base for r in extracts.waterfall_bases(wf, "zero").collect() if r.month_start == feb}
    assert own["New"] == money(100) and pub["New"] == money(0)
    assert own["Ending"] == pub["Ending"] == money(0)


def test_q14_duplicate_usage_rows_inflate_usage(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", None, 100)]
    use = [usage(1, "S1", "2024-01-05", 3, usage_id="u1"), usage(2, "S1", "2024-01-05", 3, usage_id="u1")]
    t = make_tables(subs, use)
    (r,) = state.usage_by_account_month(t).collect()
    assert r.total_usage_count == 6


def test_q16_activity_denominator_includes_accounts_that_stopped_paying(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", "2024-01-31", 100),     # active payer who stops paying
            sub("S2", "A2", "2024-01-01", "2024-02-29", 100)]      # active payer who goes inactive
    use = [usage(1, "S1", "2024-01-10", 5), usage(2, "S2", "2024-01-10", 5)]
    t = make_tables(subs, use)
    feb = {r.month_start: r for r in lenses.activity_churn_month(t).collect()}[d("2024-02-01")]
    assert feb.activity_churned_accounts == 1 and feb.activity_churn_rate == 0.5


def test_q7_p1_is_not_high_priority(make_tables):
    t = make_tables([], tickets=[ticket("T1", "A1", "2024-01-05", priority="P1")])
    (r,) = drivers.support_account_month(t.support_tickets).collect()
    assert r.high_priority_tickets == 0


def test_q6_reason_is_the_first_event_even_long_before_the_churn(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A1", "2024-06-01", None, 0)]
    t = make_tables(subs, churn_rows=[churn("C1", "A1", "2023-05-01", "budget"), churn("C2", "A1", "2024-06-03", "support")])
    (r,) = reasons.churn_reason_rows(snapshot.account_mrr_month(t.subscriptions), t.churn_events).collect()
    assert (r.churn_month, r.reason_code) == (d("2024-06-01"), "budget")


def test_q10_q11_windows_average_over_observed_months_and_coverage_agrees(make_tables):
    # A1 is observed in Apr and May only (recent window), A2 from January on; both anchor in June.
    subs = [sub("S1", "A1", "2024-04-01", None, 100), sub("S2", "A2", "2024-01-01", None, 100),
            sub("S9", "A9", "2024-06-01", "2024-06-30", 100)]  # stretches the calendar to June
    t = make_tables(subs, [usage(1, "S1", "2024-04-03", 3)])
    snap = snapshot.account_mrr_month(t.subscriptions)
    sig = signals.change_signals_account(signals.anchor_window_rows(t, snap))
    got = {r.account_id: r for r in sig.collect()}
    assert got["A1"].usage_recent_3m == 1.5 and got["A1"].usage_prior_3m is None  # two months, not three
    (coverage,) = signals.signals_coverage(sig).collect()
    assert coverage.accounts_with_usage_both_windows == coverage.accounts_with_tickets_both_windows == 1
