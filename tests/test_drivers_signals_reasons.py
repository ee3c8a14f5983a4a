"""Hand-written frames for cohorts, change signals (both usage-join modes) and reasons."""

from __future__ import annotations

from conftest import churn, d, sub, ticket, usage

from sublens.operators import drivers, reasons, signals, snapshot


def test_zero_mrr_winner_is_observed_churn_but_disappearing_is_not(make_tables):
    t = make_tables([
        sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A1", "2024-03-01", None, 0),   # 0-MRR winner in March
        sub("S3", "A2", "2024-01-01", "2024-02-29", 100), sub("S4", "A2", "2024-06-01", None, 100),  # gap
    ])
    snap = snapshot.account_mrr_month(t.subscriptions)
    first = {r.account_id: r.churn_month for r in drivers.first_churn_month(snap).collect()}
    assert first == {"A1": d("2024-03-01")}
    cohorts = drivers.account_month_cohorts(snap).collect()
    a1 = {r.month_start: r.cohort_label for r in cohorts if r.account_id == "A1"}
    assert a1 == {d("2024-01-01"): "pre_churn_3m", d("2024-02-01"): "pre_churn_3m", d("2024-03-01"): "churn_month"}
    assert {r.cohort_label for r in cohorts if r.account_id == "A2"} == {"retained"}


def test_support_metrics_priority_and_escalation(make_tables):
    t = make_tables([], tickets=[
        ticket("T1", "A1", "2024-01-05", priority=" Urgent ", escalated=True),
        ticket("T2", "A1", "2024-01-06", priority="HIGH", escalated=None, closed=False),
        ticket("T3", "A1", "2024-01-07", priority="p1", escalated=False, hours=9),
    ])
    (r,) = drivers.support_account_month(t.support_tickets).collect()
    assert (r.tickets_opened, r.tickets_closed, r.high_priority_tickets, r.escalated_tickets) == (3, 2, 2, 1)
    assert r.avg_resolution_hours == 7.0  # closed tickets only


def _signal_fixture(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A1", "2024-08-01", None, 0)]
    use = [usage(1, "S1", "2024-06-10", 4), usage(2, "S1", "2024-05-10", 6), usage(3, "S1", "2024-02-10", 1)]
    tickets = [ticket("T1", "A1", "2024-06-02"), ticket("T2", "A1", "2024-03-02")]
    return make_tables(subs, use, tickets)


def test_change_signals_own_month(make_tables):
    t = _signal_fixture(make_tables)
    snap = snapshot.account_mrr_month(t.subscriptions)
    (r,) = signals.change_signals_account(signals.anchor_window_rows(t, snap)).collect()
    assert (r.anchor_type, r.anchor_month) == ("churned", d("2024-08-01"))
    # recent = May, Jun, Jul ; prior = Feb, Mar, Apr
    assert r.usage_recent_3m == 10 / 3 and r.usage_prior_3m == 1 / 3
    assert r.tickets_recent_3m == 1 / 3 and r.tickets_prior_3m == 1 / 3
    assert r.tickets_delta == 0.0 and r.tickets_delta_pct == 0.0


def test_change_signals_as_published_differs(make_tables):
    t = _signal_fixture(make_tables)
    snap = snapshot.account_mrr_month(t.subscriptions)
    (pub,) = signals.change_signals_account_as_published(t, snap).collect()
    # A ticketed month joins all 3 usage months of the account: weight 3, usage 11 each.
    # recent: Jun (ticket, weight 3, usage 11) + May + Jul (weight 1, usage 0) -> 11 / 5
    assert pub.usage_recent_3m == 11 / 5
    assert pub.tickets_recent_3m == 3 / 5
    (own,) = signals.change_signals_account(signals.anchor_window_rows(t, snap)).collect()
    assert own.usage_recent_3m != pub.usage_recent_3m
    (tier,) = signals.change_signals_with_tier(t, snap, as_published=True).collect()
    assert (tier.plan_tier, tier.usage_recent_3m) == ("Basic", pub.usage_recent_3m)
    rows = signals.anchor_window_rows_as_published(t, snap)
    averages = {r.window_label: r for r in signals.anchor_window_averages_as_published(rows).collect()}
    assert averages["recent_3m"].avg_total_usage_count == pub.usage_recent_3m
    assert averages["recent_3m"].avg_resolution_hours == 5.0  # over the months that have tickets


def test_retained_anchor_is_last_month_and_short_history_vanishes(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-04-30", 100), sub("S2", "A2", "2024-01-01", "2024-01-31")])
    snap = snapshot.account_mrr_month(t.subscriptions)
    anchors = {r.account_id: (r.anchor_type, r.anchor_month) for r in signals.churn_anchors(snap).collect()}
    assert anchors == {"A1": ("retained", d("2024-04-01")), "A2": ("retained", d("2024-01-01"))}
    accounts = {r.account_id for r in signals.change_signals_account(signals.anchor_window_rows(t, snap)).collect()}
    assert accounts == {"A1"}


def test_reason_is_first_non_reactivation_and_null_tier_dropped(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A1", "2024-03-01", None, 0),
            sub("S3", "A2", "2024-01-01", None, 100), sub("S4", "A2", "2024-03-01", None, 0, tier=None)]
    events = [churn("C1", "A1", "2024-02-01", "budget", reactivation=True),
              churn("C2", "A1", "2024-03-05", "pricing", reactivation=None),
              churn("C3", "A1", "2024-03-05", "support"),
              churn("C4", "A2", "2024-03-05", None)]
    t = make_tables(subs, churn_rows=events)
    snap = snapshot.account_mrr_month(t.subscriptions)
    first = {r.account_id: r.reason_code for r in reasons.first_churn_reason(t.churn_events).collect()}
    assert first == {"A1": "pricing", "A2": None}  # C2 < C3 on the id tie-break
    rows = reasons.churn_reason_rows(snap, t.churn_events)
    by_tier = [(r.plan_tier, r.reason_code, r.churned_accounts, r.share_within_tier)
               for r in reasons.reason_code_by_tier(rows).collect()]
    assert by_tier == [("Basic", "pricing", 1, 1.0)]
    (m,) = reasons.reason_missing(rows).collect()
    assert (m.churned_accounts, m.missing_plan_tier, m.missing_reason_code) == (2, 1, 1)


def test_distinct_features_by_bitmaps_whatever_their_number(make_tables, monkeypatch):
    import random
    rng = random.Random(4)
    subs = [sub(f"S{i}", f"A{i % 5}", "2024-01-01", None, 100) for i in range(12)] + [sub("S99", None, "2024-01-01", None, 100)]
    names = [f"feature_{k}" for k in range(40)] + [None]
    rows = [usage(i, rng.choice([f"S{k}" for k in range(12)] + ["S99", "orphan", None]), f"2024-0{rng.randint(1, 3)}-05",
                  rng.choice([0, 1, 7, None]), rng.choice(names)) for i in range(500)]
    t = make_tables(subs, rows)
    account = {s[0]: s[1] for s in subs}
    want = {}
    for _, _, s, day, feature, count, *_ in rows:
        if s in account:
            total, seen = want.setdefault((day.replace(day=1), account[s]), [0, set()])
            want[day.replace(day=1), account[s]][0] += count or 0
            seen |= {feature} - {None}
    want = {k: (v[0], len(v[1]), int(v[0] > 0)) for k, v in want.items()}
    for masks, bits in ((2, 63), (1, 63), (2, 20), (1, 7), (3, 5)):  # all names in the dictionary, the last fits, or most are beyond
        monkeypatch.setattr(drivers, "MASKS", masks)
        monkeypatch.setattr(drivers, "MASK_BITS", bits)
        got = {(r.month_start, r.account_id): (r.total_usage_count, r.distinct_features_used, r.active_flag) for r in drivers.usage_account_month(t).collect()}
        assert got == want, (masks, bits)


def test_usage_is_shuffled_three_times(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01")], [usage(1, "S1", "2024-01-05")])
    frame = drivers.usage_account_month(t)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "feature_name" not in "".join(line for line in final.split("\n") if "hashpartitioning" in line and "month_start" in line)
