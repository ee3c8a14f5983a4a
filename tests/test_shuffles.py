"""How often rows are shuffled: what the large tables' time goes into."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL, d, money, sub, usage

import __spark_entry__ as entry
from sublens.operators import extracts, state
from sublens.sources.fixture import derive_tables


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["account_activity_state", "preview_activity", "change_signals_3m_account", "change_signals_with_tier_calendar"])
def test_usage_is_not_shuffled_by_subscription_and_month(spark, name):
    """One shuffle to the subscriptions and one by account and month."""
    plan = planned(entry.queries()[name](spark, SF_SMALL))
    assert not re.search(r"hashpartitioning\(subscription_id#\d+, month_start#\d+, \d+\)", plan)


@pytest.mark.parametrize("name", ["account_activity_state", "preview_activity", "freeze_extract", "change_signals_3m_account"])
def test_subscriptions_are_shuffled_as_ranges(spark, name):
    """No month is made of a range before the shuffle that brings an account's rows together."""
    if name == "freeze_extract":
        plan = planned(entry.queries()["extract_scoreboard_trends"](spark, SF_SMALL))
    else:
        plan = planned(entry.queries()[name](spark, SF_SMALL))
    lines = plan.split("\n")
    made = [i for i, line in enumerate(lines) if "Generate explode(sequence(first_month" in line]
    assert made and all("Exchange hashpartitioning(account_id" in "\n".join(lines[i:i + 8]) for i in made)


def test_state_and_flows_of_gaps_marks_and_null_accounts(make_tables):
    t = make_tables([sub("S1", "A", "2024-01-10", "2024-02-29", mrr=10), sub("S2", "A", "2024-04-01", "2024-05-31", mrr=20),
                     sub("S3", "B", "2024-03-05", "2024-03-02"), sub("S4", None, "2024-01-01", "2024-06-15", mrr=5)],
                    [usage(1, "S1", "2024-03-03", 7), usage(2, "S3", "2024-06-01", 2), usage(3, "S4", "2024-02-01", 9),
                     usage(4, "S1", "2024-03-09", None), usage(5, "S2", "2024-07-01", 4), usage(6, "S9", "2024-01-01", 1)])
    months = [d(f"2024-0{m}-01") for m in range(1, 7)]
    dense = {(r.account_id, r.month_start): tuple(r)[2:] for r in state.account_activity_state(t).collect()}
    assert set(dense) == {(a, m) for a in ("A", "B", None) for m in months}
    paid, used = [10, 10, 0, 20, 20, 0], [0, 0, 7, 0, 0, 0]
    assert [dense["A", m] for m in months] == [
        (money(p), u, int(p > 0), int(u > 0), int(i > 0 and used[i - 1] > 0), int(i > 0 and paid[i - 1] > 0)) for i, (p, u) in enumerate(zip(paid, used))]
    assert [dense["B", m][1:5] for m in months] == [(0, 0, 0, 0)] * 5 + [(2, 0, 1, 0)]
    assert all(dense[None, m] == (money(0), 0, 0, 0, 0, 0) for m in months)
    flows = {(r.account_id, r.month_start): (r.mrr_amount, r.prev_mrr, r.total_usage_count, r.prev_usage_count) for r in state.account_month_flows(t).collect()}
    assert flows == {("A", months[0]): (money(10), None, None, None), ("A", months[1]): (money(10), money(10), None, None),
                     ("A", months[2]): (None, money(10), 7, None), ("A", months[3]): (money(20), None, None, 7),
                     ("A", months[4]): (money(20), money(20), None, None), ("A", months[5]): (None, money(20), None, None)}


def test_views_read_the_columns_they_use_of_the_written_snapshot(spark):
    views = extracts.register_all(spark, derive_tables(spark, SF_SMALL), materialize=True)
    assert "Scan parquet" in planned(views["v_account_mrr_month"]).replace("FileScan", "Scan")
    scan = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*snapshot-", planned(views["v_mix_shift_by_plan_month"]))
    assert scan and all("subscription_id" not in columns and "plan_tier" in columns for columns in scan)
