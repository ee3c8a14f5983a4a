"""Hand-written frames for the month-end snapshot and the three churn lenses."""

from __future__ import annotations

from conftest import d, money, sub, usage

from sublens.operators import lenses, snapshot, state


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))


def test_end_date_is_inclusive(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-10", "2024-01-31"), sub("S2", "A2", "2024-01-10", "2024-01-30")])
    snap = snapshot.account_mrr_month(t.subscriptions)
    assert rows(snap, "account_id", "month_start") == [("A1", d("2024-01-01"))]


def test_winner_tie_breaks(make_tables):
    t = make_tables([
        # latest start wins
        sub("S1", "A1", "2024-01-01", None, 500), sub("S2", "A1", "2024-01-05", None, 100),
        # same start: higher MRR wins
        sub("S3", "A2", "2024-01-05", None, 100), sub("S4", "A2", "2024-01-05", None, 300),
        # same start and MRR: higher id wins
        sub("S5", "A3", "2024-01-05", None, 100), sub("S6", "A3", "2024-01-05", None, 100),
    ])
    snap = snapshot.account_mrr_month(t.subscriptions)
    assert rows(snap, "account_id", "subscription_id") == [("A1", "S2"), ("A2", "S4"), ("A3", "S6")]


def test_open_subscription_runs_to_calendar_end(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-10", None), sub("S2", "A2", "2024-01-01", "2024-04-30")])
    snap = snapshot.account_mrr_month(t.subscriptions)
    months_a1 = [m for a, m in rows(snap, "account_id", "month_start") if a == "A1"]
    assert months_a1 == [d("2024-01-01"), d("2024-02-01"), d("2024-03-01"), d("2024-04-01")]


def test_inverted_and_sub_month_intervals_give_no_rows(make_tables):
    t = make_tables([sub("S1", "A1", "2024-02-10", "2024-02-01"), sub("S2", "A2", "2024-03-10", "2024-03-15")])
    assert snapshot.account_mrr_month(t.subscriptions).count() == 0


def test_empty_subscriptions(make_tables):
    t = make_tables([])
    assert snapshot.account_mrr_month(t.subscriptions).count() == 0
    assert lenses.churn_scoreboard_month(t).count() == 0
    assert state.account_month_spine(t.subscriptions).count() == 0


def test_gap_is_logo_churn_then_new(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-01-31", 100),
                     sub("S2", "A1", "2024-03-01", "2024-03-31", 150)])
    logo = {r.month_start: r for r in lenses.logo_churn_month(t).collect()}
    assert logo[d("2024-02-01")].churned_customers == 1
    assert logo[d("2024-03-01")].new_customers == 1
    assert logo[d("2024-02-01")].logo_churn_rate == 1.0
    assert logo[d("2024-01-01")].logo_churn_rate is None  # no customers at start
    wf = {r.month_start: r for r in lenses.revenue_waterfall_month(t).collect()}
    assert wf[d("2024-02-01")].churned_mrr == money(100)
    assert wf[d("2024-03-01")].new_mrr == money(150)


def test_expansion_and_contraction(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-01-31", 100),
                     sub("S2", "A1", "2024-02-01", "2024-02-29", 180),
                     sub("S3", "A1", "2024-03-01", "2024-03-31", 120)])
    wf = {r.month_start: r for r in lenses.revenue_waterfall_month(t).collect()}
    assert wf[d("2024-02-01")].expansion_mrr == money(80)
    assert wf[d("2024-03-01")].contraction_mrr == money(60)
    assert abs(wf[d("2024-03-01")].net_revenue_retention - 120 / 180) < 1e-12


def test_null_mrr_counts_as_zero_and_null_account_is_not_on_the_spine(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-02-29", None),
                     sub("S2", None, "2024-01-01", "2024-02-29", 50, tier=None)])
    snap = snapshot.account_mrr_month(t.subscriptions)
    assert ("A1", money(0)) in rows(snap, "account_id", "mrr_amount")
    mix = lenses.mix_shift_by_plan_month(snap).collect()
    assert any(r.plan_tier is None and r.paying_accounts == 1 for r in mix)  # NULL account and tier kept in mix
    score = lenses.churn_scoreboard_month(t).collect()
    assert all(r.customers_end == 0 and r.paying_accounts == 0 for r in score)  # invisible to the lenses


def test_activity_churn(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", "2024-03-31", 100)]
    use = [usage(1, "S1", "2024-01-15", 5), usage(2, "S1", "2024-03-15", 0)]
    t = make_tables(subs, use)
    act = {r.month_start: r for r in lenses.activity_churn_month(t).collect()}
    assert act[d("2024-01-01")].active_paying_accounts == 1
    assert act[d("2024-02-01")].activity_churned_accounts == 1
    assert act[d("2024-02-01")].activity_churn_rate == 1.0
    assert act[d("2024-03-01")].inactive_but_paying_accounts == 1
    assert act[d("2024-03-01")].activity_churn_rate is None  # nobody active and paying last month


def test_sparse_state_matches_dense_spine(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", "2024-02-29", 100), sub("S2", "A1", "2024-05-01", None, 70),
            sub("S3", "A2", "2024-02-01", "2024-06-30", 0), sub("S4", "A3", "2024-03-01", "2024-04-30", 40)]
    use = [usage(1, "S1", "2024-01-03", 3), usage(2, "S3", "2024-04-03", 2), usage(3, "S4", "2024-04-09", 1)]
    t = make_tables(subs, use)
    dense = state.account_activity_state(t).collect()
    by_month: dict = {}
    for r in dense:
        m = by_month.setdefault(r.month_start, [0, 0, 0, 0])
        m[0] += r.is_paying
        m[1] += r.is_paying and r.is_active
        m[2] += r.prev_is_paying and r.prev_is_active and r.is_paying and not r.is_active
        m[3] += r.prev_is_paying and r.prev_is_active
    act = {r.month_start: r for r in lenses.activity_churn_month(t).collect()}
    assert set(act) == set(by_month)
    for month, (paying, active_paying, churned, base) in by_month.items():
        r = act[month]
        assert (r.paying_accounts, r.active_paying_accounts, r.activity_churned_accounts) == \
            (paying, active_paying, churned)


def test_reconciliation_diffs_are_zero(make_tables):
    subs = [sub("S1", "A1", "2024-01-01", "2024-02-29", 100), sub("S2", "A1", "2024-03-01", None, 70),
            sub("S3", "A2", "2024-02-01", "2024-06-30", 10), sub("S4", "A3", "2024-03-01", "2024-04-30", 40)]
    t = make_tables(subs)
    assert all(r.diff == 0 for r in lenses.check_mrr_reconciliation(lenses.revenue_waterfall_month(t)).collect())
    assert all(r.diff == 0 for r in lenses.check_customer_reconciliation(lenses.logo_churn_month(t)).collect())


def test_trust_gate_passes_on_consistent_data_and_fails_on_negative_mrr(make_tables):
    import pytest
    from sublens.operators.quality import TrustGateError, trust_gate
    good = make_tables([sub("S1", "A1", "2024-01-01", "2024-02-29", 100), sub("S2", "A2", "2024-02-01", None, 50)])
    trust_gate(good)
    # Negative MRR belongs to no movement bucket: moving from -100 to +50 is neither new nor
    # expansion, yet the 50 is in ending MRR, so the waterfall no longer reconciles.
    bad = make_tables([sub("S1", "A1", "2024-01-01", "2024-01-31", -100), sub("S2", "A1", "2024-02-01", None, 50)])
    with pytest.raises(TrustGateError):
        trust_gate(bad)


def test_ties_are_settled_month_by_month(make_tables):
    # Same start and MRR: the higher id wins while it is active, then the next lower one that still is.
    t = make_tables([sub("S1", "A1", "2024-01-05", "2024-06-30"), sub("S2", "A1", "2024-01-05", "2024-02-29"),
                     sub("S3", "A1", "2024-01-05", "2024-04-30"), sub("S0", "A1", "2024-01-05", "2024-03-31"),
                     sub("S9", None, "2024-01-05", "2024-01-31", mrr=None), sub("S8", None, "2024-01-05", "2024-02-29", mrr=None)])
    snap = rows(snapshot.account_mrr_month(t.subscriptions), "account_id", "month_start", "subscription_id", "mrr_amount")
    won = [(a, m.month, s) for a, m, s, _ in snap]
    assert won == [("A1", 1, "S3"), ("A1", 2, "S3"), ("A1", 3, "S3"), ("A1", 4, "S3"), ("A1", 5, "S1"), ("A1", 6, "S1"), (None, 1, "S9"), (None, 2, "S8")]


def test_packed_key_keeps_the_order_of_every_start_and_amount(spark):
    import datetime as dt
    from decimal import Decimal
    days = [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(9999, 12, 31)]
    cents = [Decimal(x) for x in ("-9999999999.99", "-0.01", "0.00", "0.01", "123.45", "9999999999.99")]
    frame = spark.createDataFrame([(a, m) for a in days for m in cents], "start_date date, mrr_amount decimal(12,2)")
    keyed = frame.withColumn("k", snapshot.winner_key()).withColumn("back", snapshot.mrr_of_key("k")).collect()
    assert [r.k for r in keyed] == sorted({r.k for r in keyed}) and all(r.back == r.mrr_amount for r in keyed)
    assert snapshot.account_mrr(spark.createDataFrame([], "account_id string, start_date date, end_date date, mrr_amount decimal(12,2)")).count() == 0


def test_snapshot_is_hash_aggregated_on_both_sides(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01"), sub("S2", "A1", "2024-02-01")])
    for frame in (snapshot.account_mrr(t.subscriptions), snapshot.account_mrr_month(t.subscriptions)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "partial_max(winner_key" in plan


def random_subscriptions(rng, accounts=12, n=70):
    import datetime as dt
    for i in range(n):
        start = dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(0, 500, 10))
        end = None if rng.random() < 0.1 else start + dt.timedelta(days=rng.randrange(-5, 200, 15))
        yield sub(f"S{i:03d}", rng.choice([None, *[f"A{k}" for k in range(accounts)]]), start.isoformat(), end.isoformat() if end else None,
                  mrr=rng.choice([0, None, 10, 10, 25]), tier=rng.choice(["Basic", "Pro", None]))


def test_calendar_runs_equal_the_dense_spine(make_tables):
    """Runs and what is built on them against a month-by-month account of every spine cell."""
    import random
    from sublens.operators import drivers, reasons, signals
    for seed in range(3):
        t = make_tables(list(random_subscriptions(random.Random(seed))))
        snap = snapshot.account_mrr_month(t.subscriptions)
        cells = {(r.account_id, r.month_start): r for r in snap.collect() if r.account_id is not None}
        assert {k: r.mrr_amount for k, r in cells.items()} == {
            (r.account_id, r.month_start): r.mrr_amount for r in snapshot.account_mrr(t.subscriptions).collect() if r.account_id is not None}
        spine = {}
        for r in state.account_month_spine(t.subscriptions).collect():
            spine.setdefault(r.account_id, []).append(r.month_start)
        runs = state.calendar_snapshot(t, snap)
        assert runs.count() <= 2 * len(cells) + len(spine)
        dense, churned, anchors = {}, {}, {}
        for account, months in spine.items():
            tier, before = None, 0
            for m in sorted(months):
                cell = cells.get((account, m))
                mrr = cell.mrr_amount if cell else money(0)
                tier = cell.plan_tier if cell and cell.mrr_amount > 0 else tier
                dense[account, m] = (mrr, tier)
                if account is not None and before > 0 and mrr == 0:
                    churned.setdefault(account, (m, tier))
                before = mrr
            anchors[account] = churned[account][0] if account in churned else max(months)
        assert {(r.account_id, r.month_start): (r.mrr_amount, r.plan_tier) for r in state.run_months(runs).collect()} == dense
        assert {(r.account_id, r.month_start): r.mrr_amount for r in state.account_month_state(t).collect()} == {k: v[0] for k, v in dense.items()}
        assert {r.account_id: r.anchor_month for r in signals.churn_anchors(runs).collect()} == anchors
        assert {r.account_id: (r.churn_month, r.plan_tier) for r in reasons.churned_accounts(runs).collect()} == churned
        cohorts = {(r.account_id, r.month_start): (r.mrr_amount, r.prev_mrr) for r in drivers.account_month_cohorts(runs).collect()}
        want = {}
        for account, months in spine.items():
            before = money(0)
            for m in sorted(months):
                if account not in churned or m <= churned[account][0]:
                    want[account, m] = (dense[account, m][0], before)
                before = dense[account, m][0]
        assert cohorts == want
        windows = {(r.account_id, r.month_start, r.months_to_anchor) for r in signals.anchor_windows(runs).collect()}
        gap = lambda a, m: (anchors[a].year - m.year) * 12 + anchors[a].month - m.month
        assert windows == {(a, m, gap(a, m)) for a, ms in spine.items() if a is not None for m in ms if 1 <= gap(a, m) <= 6}


def test_calendar_basis_joins_no_spine(make_tables):
    t = make_tables([sub("S1", "A1", "2024-01-01", "2024-03-31")])
    plan = state.calendar_snapshot(t, snapshot.account_mrr(t.subscriptions))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
