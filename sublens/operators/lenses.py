"""The three monthly churn lenses, the scoreboard, mix shift and checks.

All three lenses aggregate the same sparse account-month state (sublens.operators.state),
so the scoreboard computes them in one pass: a single groupBy(month_start) whose result
has one row per calendar month.  Months without any contributing account still appear
(with zero counts and NULL rates) because the result is laid onto the calendar, which is
bounded by the calendar span and is joined as the small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sublens.functions.columns import average, count_if, money_total, ratio
from sublens.operators.calendar import month_calendar
from sublens.operators.state import account_month_flows
from sublens.sources.tables import Tables


def zero_total() -> Column:
    return F.lit(0).cast("decimal(18,2)")


LOGO_COLUMNS = ("month_start", "customers_start", "new_customers", "churned_customers", "customers_end",
                "logo_churn_rate", "net_customer_change", "net_growth_rate")
WATERFALL_COLUMNS = ("month_start", "starting_mrr", "new_mrr", "expansion_mrr", "contraction_mrr",
                     "churned_mrr", "ending_mrr", "gross_revenue_churn_rate", "net_revenue_retention")
ACTIVITY_COLUMNS = ("month_start", "paying_accounts", "active_paying_accounts", "inactive_but_paying_accounts",
                    "activity_churned_accounts", "activity_churn_rate")
SCOREBOARD_COLUMNS = ("month_start", "new_customers", "churned_customers", "customers_end", "logo_churn_rate",
                      "starting_mrr", "new_mrr", "expansion_mrr", "contraction_mrr", "churned_mrr", "ending_mrr",
                      "gross_revenue_churn_rate", "net_revenue_retention", "paying_accounts",
                      "active_paying_accounts", "inactive_but_paying_accounts", "activity_churned_accounts",
                      "activity_churn_rate")


def _monthly_measures(flows: DataFrame, with_activity: bool) -> DataFrame:
    """Raw monthly counts and sums (NULL sums where nothing matched)."""
    mrr = F.coalesce("mrr_amount", F.lit(0).cast("decimal(12,2)"))
    prev = F.coalesce("prev_mrr", F.lit(0).cast("decimal(12,2)"))
    aggs: list[Column] = [
        count_if(prev > 0).alias("customers_start"),
        count_if((prev == 0) & (mrr > 0)).alias("new_customers"),
        count_if((prev > 0) & (mrr == 0)).alias("churned_customers"),
        count_if(mrr > 0).alias("customers_end"),
        money_total(prev, prev > 0).alias("m_start"),
        money_total(mrr, (prev == 0) & (mrr > 0)).alias("m_new"),
        money_total(mrr - prev, (prev > 0) & (mrr > prev)).alias("m_exp"),
        money_total(prev - mrr, (prev > 0) & (mrr > 0) & (mrr < prev)).alias("m_con"),
        money_total(prev, (prev > 0) & (mrr == 0)).alias("m_churn"),
        money_total(mrr, mrr > 0).alias("m_end"),
    ]
    if with_activity:
        paying, prev_paying = mrr > 0, prev > 0
        active = F.coalesce("total_usage_count", F.lit(0)) > 0
        prev_active = F.coalesce("prev_usage_count", F.lit(0)) > 0
        aggs += [
            count_if(paying).alias("paying_accounts"),
            count_if(paying & active).alias("active_paying_accounts"),
            count_if(paying & ~active).alias("inactive_but_paying_accounts"),
            count_if(prev_paying & prev_active & paying & ~active).alias("activity_churned_accounts"),
            count_if(prev_paying & prev_active).alias("activity_base"),
        ]
    return flows.groupBy("month_start").agg(*aggs)


def _on_calendar(tables: Tables, measures: DataFrame) -> DataFrame:
    """Every calendar month, with the measures of that month (zero-filled counts)."""
    cal = month_calendar(tables.subscriptions).select("month_start")
    j = cal.join(measures, "month_start", "left")
    counts = [c for c in measures.columns if c != "month_start" and not c.startswith("m_")]
    sums = [c for c in measures.columns if c.startswith("m_")]
    return j.select("month_start",
                    *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
                    *[F.coalesce(c, zero_total()).alias(c) for c in sums])


def _logo(m: DataFrame) -> list[Column]:
    return [F.col("customers_start"), F.col("new_customers"), F.col("churned_customers"), F.col("customers_end"),
            ratio("churned_customers", "customers_start").alias("logo_churn_rate"),
            (F.col("new_customers") - F.col("churned_customers")).alias("net_customer_change"),
            ratio(F.col("customers_end") - F.col("customers_start"), "customers_start").alias("net_growth_rate")]


def _waterfall(m: DataFrame) -> list[Column]:
    s, e, c, ch = F.col("m_start"), F.col("m_exp"), F.col("m_con"), F.col("m_churn")
    return [s.alias("starting_mrr"), F.col("m_new").alias("new_mrr"), e.alias("expansion_mrr"),
            c.alias("contraction_mrr"), ch.alias("churned_mrr"), F.col("m_end").alias("ending_mrr"),
            ratio(c + ch, s).alias("gross_revenue_churn_rate"),
            ratio(s + e - c - ch, s).alias("net_revenue_retention")]


def _activity(m: DataFrame) -> list[Column]:
    return [F.col("paying_accounts"), F.col("active_paying_accounts"), F.col("inactive_but_paying_accounts"),
            F.col("activity_churned_accounts"),
            ratio("activity_churned_accounts", "activity_base").alias("activity_churn_rate")]


def _lens(tables: Tables, snapshot: DataFrame | None, with_activity: bool) -> DataFrame:
    flows = account_month_flows(tables, snapshot, with_usage=with_activity)
    return _on_calendar(tables, _monthly_measures(flows, with_activity))


def logo_churn_month(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """Customers at start, new, churned, at end, churn and net growth rates per month."""
    m = _lens(tables, snapshot, False)
    return m.select("month_start", *_logo(m)).select(*LOGO_COLUMNS)


def revenue_waterfall_month(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """C11 + C12: MRR movements per month, gross revenue churn and net revenue retention."""
    m = _lens(tables, snapshot, False)
    return m.select("month_start", *_waterfall(m)).select(*WATERFALL_COLUMNS)


def activity_churn_month(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """Paying, active-paying, inactive-but-paying, activity-churned accounts and rate."""
    m = _lens(tables, snapshot, True)
    return m.select("month_start", *_activity(m)).select(*ACTIVITY_COLUMNS)


def churn_scoreboard_month(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """C17: the three lenses side by side, computed from one aggregate."""
    m = _lens(tables, snapshot, True)
    return m.select("month_start", *_logo(m), *_waterfall(m), *_activity(m)).select(*SCOREBOARD_COLUMNS)


def mix_shift_by_plan_month(snapshot: DataFrame) -> DataFrame:
    """Paying accounts, total and average MRR by month x plan tier (NULL tier is a group)."""
    paying = F.col("mrr_amount") > 0
    return (snapshot.groupBy("month_start", "plan_tier")
            .agg(count_if(paying).alias("paying_accounts"),
                 money_total("mrr_amount", paying).alias("total_mrr"),
                 average("mrr_amount", paying).alias("avg_mrr_per_account")))


def check_mrr_reconciliation(waterfall: DataFrame) -> DataFrame:
    """Starting + new + expansion - contraction - churned against ending."""
    re = (F.col("starting_mrr") + F.col("new_mrr") + F.col("expansion_mrr")
          - F.col("contraction_mrr") - F.col("churned_mrr")).cast("decimal(18,2)")
    return waterfall.select("month_start", re.alias("recomputed_ending_mrr"), "ending_mrr",
                            (re - F.col("ending_mrr")).cast("decimal(18,2)").alias("diff"))


def check_customer_reconciliation(logo: DataFrame) -> DataFrame:
    """C20: customers_start + new - churned against customers_end."""
    re = F.col("customers_start") + F.col("new_customers") - F.col("churned_customers")
    return logo.select("month_start", re.alias("recomputed_customers_end"), "customers_end",
                       (re - F.col("customers_end")).alias("diff"))


def preview(df: DataFrame, n: int | None) -> DataFrame:
    """Rows in month order, first n (all when n is None)."""
    keys = [F.col("month_start").asc_nulls_last()]
    if "plan_tier" in df.columns:
        keys.append(F.col("plan_tier").asc_nulls_last())
    out = df.orderBy(*keys)
    return out.limit(n) if n is not None else out
