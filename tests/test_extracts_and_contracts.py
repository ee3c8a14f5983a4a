"""Extracts build lazily, fail as they run on what isn't there; contract counts; named views."""

from __future__ import annotations

import pytest
from conftest import d, money, sub, usage

from sublens.operators import extracts, lenses, quality, snapshot


@pytest.fixture
def tables(make_tables):
    return make_tables([sub("S1", "A1", "2024-01-01", None, 100), sub("S2", "A2", "2024-02-01", None, 40, tier="Pro"),
                        sub("S3", "A3", "2024-02-01", None, 7, tier=None)])


def test_extracts_run_no_job_while_built(spark, tables):
    spark.sparkContext.setJobGroup("building", "extracts")
    try:
        snap = snapshot.account_mrr_month(tables.subscriptions)
        mix = lenses.mix_shift_by_plan_month(snap)
        extracts.mix_pivot(mix, ["Basic", "Pro"])
        extracts.mix_stack_offsets(mix, ["Basic", "Pro"])
        extracts.waterfall_for_month(lenses.revenue_waterfall_month(tables), "2024-01-01")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_mix_reshapes(tables):
    mix = lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(tables.subscriptions))
    wide = {r.month_start: (r.Basic, r.Enterprise, r.Pro) for r in extracts.mix_pivot(mix, ["Pro", "Basic", "Enterprise"]).collect()}
    assert wide == {d("2024-01-01"): (money(100), money(0), money(0)), d("2024-02-01"): (money(100), money(0), money(40))}
    stacked = {(r.month_start, r.plan_tier): (r.total_mrr, r.bottom)
               for r in extracts.mix_stack_offsets(mix, ["Pro", "Basic", "Enterprise"]).collect()}
    assert stacked[d("2024-02-01"), "Pro"] == (money(40), money(100))
    assert stacked[d("2024-01-01"), "Enterprise"] == (money(0), money(100)) and len(stacked) == 6


@pytest.mark.parametrize("reshape", [extracts.mix_pivot, extracts.mix_stack_offsets])
def test_unlisted_tier_fails(tables, reshape):
    mix = lenses.mix_shift_by_plan_month(snapshot.account_mrr_month(tables.subscriptions))
    with pytest.raises(Exception, match="plan tier not listed: Pro"):
        reshape(mix, ["Basic"]).collect()


def test_waterfall_for_month(tables):
    waterfall = lenses.revenue_waterfall_month(tables)
    (row,) = extracts.waterfall_for_month(waterfall, "2024-02-01").collect()
    assert row.asDict() == next(r.asDict() for r in waterfall.collect() if r.month_start == d("2024-02-01"))
    with pytest.raises(Exception, match="month 2030-01-01 not found"):
        extracts.waterfall_for_month(waterfall, "2030-01-01").collect()


def test_contract_violations_are_counted(make_tables):
    subs = [sub("S1", "A1", "2024-01-01"), sub("S1", "A1", "2024-02-01"), sub("S1", "A9", "2024-02-01"),
            sub(None, "A1", "2024-02-01"), sub(None, None, "2024-02-01")]
    undated = list(sub("S2", "A1", "2024-01-01"))
    undated[2] = None
    use = [usage(1, "S1", "2024-01-05"), usage(2, "S7", "2024-01-05"), usage(2, None, "2024-01-06")]
    accounts = [("A1", "A1", "x", "y", d("2020-01-01"), "organic", "Basic", 1, False, False)]
    t = make_tables([*subs, tuple(undated)], use, accounts=accounts)
    got = {(r.table_name, r.constraint_name): r.violations for r in quality.validate_contracts(t).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("subscriptions", "primary_key:subscription_id:duplicates"): 1, ("subscriptions", "primary_key:subscription_id:nulls"): 2,
        ("subscriptions", "not_null:start_date"): 1, ("subscriptions", "foreign_key:account_id->accounts.account_id"): 1,
        ("feature_usage_raw", "primary_key:row_id:duplicates"): 1,
        ("feature_usage_raw", "foreign_key:subscription_id->subscriptions.subscription_id"): 1}
    empty = make_tables()
    assert {r.violations for r in quality.validate_contracts(empty).collect()} == {0} and len(got) == 17


@pytest.mark.parametrize("materialize", [False, True])
def test_every_view_is_read_by_name(spark, tables, materialize):
    views = extracts.register_all(spark, tables, materialize=materialize)
    for name, df in views.items():
        assert spark.table(name).schema == df.schema
    assert spark.table("v_account_mrr_month").count() == 4
    assert spark.table("v_mix_shift_by_plan_month").count() == 4
