"""A hot account holding a third of all rows: results stay whole and consistent."""

from __future__ import annotations

import datetime as dt

from conftest import sub, usage

from sublens.operators import lenses, quality, state


def _skewed(make_tables):
    subs, use = [], []
    base = dt.date(2023, 1, 1)
    for i in range(300):
        account = "HOT" if i % 3 == 0 else f"A{i % 40}"
        start = base + dt.timedelta(days=(i * 17) % 700)
        end = None if i % 7 == 0 else start + dt.timedelta(days=20 + (i * 13) % 200)
        subs.append(sub(f"S{i:04d}", account, start.isoformat(), end.isoformat() if end else None,
                        mrr=0 if i % 9 == 0 else 10 + i % 50))
        for j in range(3):
            use.append(usage(i * 3 + j, f"S{i:04d}", (start + dt.timedelta(days=j * 11)).isoformat(), count=j))
    return make_tables(subs, use)


def test_hot_account_lenses_match_the_dense_definition(make_tables):
    t = _skewed(make_tables)
    dense = state.account_activity_state(t).collect()
    expect: dict = {}
    for r in dense:
        m = expect.setdefault(r.month_start, [0, 0, 0])
        m[0] += r.is_paying
        m[1] += r.prev_is_paying and not r.is_paying
        m[2] += r.prev_is_paying and r.prev_is_active and r.is_paying and not r.is_active
    score = {r.month_start: r for r in lenses.churn_scoreboard_month(t).collect()}
    assert set(score) == set(expect)
    for month, (paying, churned, act_churned) in expect.items():
        r = score[month]
        assert (r.customers_end, r.churned_customers, r.activity_churned_accounts) == (paying, churned, act_churned)


def test_hot_account_invariants_and_orphans(make_tables):
    t = _skewed(make_tables)
    assert all(r.diff == 0 for r in lenses.check_customer_reconciliation(lenses.logo_churn_month(t)).collect())
    assert all(r.diff == 0 for r in lenses.check_mrr_reconciliation(lenses.revenue_waterfall_month(t)).collect())
    assert quality.orphans_usage(t).collect()[0].usage_missing_subscription == 0
    assert quality.orphans_subscriptions(t).collect()[0].subscriptions_missing_account == 0
