"""P1-P15 profiling and integrity checks, plus the generic grain / range checks.

Every check is an aggregate with a map-side partial step and returns a handful of rows;
`validate_contracts` reads a table once for its keys and NULLs and once per foreign key.  Orphan checks are left-anti joins (the plan of a
LEFT JOIN + IS NULL keeps the outer join and a filter).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sublens.functions.columns import count_if
from sublens.sources.schemas import CONTRACTS, Contract
from sublens.sources.tables import Tables

# Fixed labels of the duplicate-key report (P2), in report order.
KEY_CHECKS = (
    ("accounts", "account_id", "accounts.account_id duplicates"),
    ("subscriptions", "subscription_id", "subscriptions.subscription_id duplicates"),
    ("feature_usage_raw", "row_id", "feature_usage_raw.row_id duplicates"),
    ("support_tickets", "ticket_id", "support_tickets.ticket_id duplicates"),
    ("churn_events", "churn_event_id", "churn_events.churn_event_id duplicates"),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_count(col: str) -> F.Column:
    """SUM(CASE WHEN col IS NULL THEN 1 ELSE 0 END): NULL on an empty table, like SQL SUM."""
    return F.sum(F.when(F.col(col).isNull(), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def duplicate_key_values(df: DataFrame, *keys: str) -> DataFrame:
    """Number of key values that occur more than once (not the surplus rows)."""
    return (df.groupBy(*keys).count().filter(F.col("count") > 1)
            .agg(F.count(F.lit(1)).alias("dupes")))


def grain_check(df: DataFrame, *keys: str) -> DataFrame:
    """(bad_rows): groups of `keys` that hold more than one row; 0 when the grain holds."""
    return duplicate_key_values(df, *keys).withColumnRenamed("dupes", "bad_rows")


def row_counts(t: Tables) -> DataFrame:
    """(table_name, row_count) for the five tables."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
                   for name, df in t.items()])


def key_duplicates(t: Tables) -> DataFrame:
    """(check_name, dupes) for the five primary keys."""
    return _union([duplicate_key_values(getattr(t, table), key).select(F.lit(label).alias("check_name"), "dupes")
                   for table, key, label in KEY_CHECKS])


def nulls_subscriptions(t: Tables) -> DataFrame:
    """P3."""
    return t.subscriptions.agg(F.lit("subscriptions").alias("table_name"),
                               null_count("start_date").alias("null_start_date"),
                               null_count("account_id").alias("null_account_id"))


def nulls_usage(t: Tables) -> DataFrame:
    """P4."""
    return t.feature_usage_raw.agg(F.lit("feature_usage_raw").alias("table_name"),
                                   null_count("usage_date").alias("null_usage_date"),
                                   null_count("subscription_id").alias("null_subscription_id"))


def nulls_churn_events(t: Tables) -> DataFrame:
    """P5."""
    return t.churn_events.agg(F.lit("churn_events").alias("table_name"),
                              null_count("churn_date").alias("null_churn_date"),
                              null_count("account_id").alias("null_account_id"))


def nulls_support(t: Tables) -> DataFrame:
    """P6."""
    return t.support_tickets.agg(F.lit("support_tickets").alias("table_name"),
                                 null_count("account_id").alias("null_account_id"))


def bad_intervals(t: Tables) -> DataFrame:
    """Subscriptions ending before they start."""
    s = t.subscriptions
    return (s.filter(F.col("end_date").isNotNull() & (F.col("end_date") < F.col("start_date")))
            .agg(F.count(F.lit(1)).alias("bad_end_before_start")))


def subscription_range(t: Tables) -> DataFrame:
    """P8."""
    return t.subscriptions.agg(F.min("start_date").alias("min_start_date"),
                               F.max(F.coalesce("end_date", "start_date")).alias("max_end_date"))


def usage_range(t: Tables) -> DataFrame:
    """P9."""
    return t.feature_usage_raw.agg(F.min("usage_date").alias("min_usage_date"),
                                   F.max("usage_date").alias("max_usage_date"))


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str = "orphans") -> DataFrame:
    """Number of child rows whose key finds no parent.  The child is first reduced to one
    row per key value with its row count (map-side partial aggregate), so a key holding a
    large share of the rows reaches the anti join as a single row."""
    per_key = child.groupBy(F.col(fk).alias("__fk")).agg(F.count(F.lit(1)).alias("__n"))
    missing = per_key.join(parent.select(F.col(pk).alias("__pk")), F.col("__fk") == F.col("__pk"), "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias(label))


def orphans_subscriptions(t: Tables) -> DataFrame:
    """P10."""
    return orphan_count(t.subscriptions, "account_id", t.accounts, "account_id", "subscriptions_missing_account")


def orphans_usage(t: Tables) -> DataFrame:
    """P11."""
    return orphan_count(t.feature_usage_raw, "subscription_id", t.subscriptions, "subscription_id",
                         "usage_missing_subscription")


def orphans_churn_events(t: Tables) -> DataFrame:
    """P12."""
    return orphan_count(t.churn_events, "account_id", t.accounts, "account_id", "churn_missing_account")


def orphans_support(t: Tables) -> DataFrame:
    """P13."""
    return orphan_count(t.support_tickets, "account_id", t.accounts, "account_id", "support_missing_account")


def usage_duplicates(t: Tables) -> DataFrame:
    """Rows, distinct usage_id (NULL not counted) and their difference."""
    return (t.feature_usage_raw
            .agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("usage_id").alias("distinct_usage_id"))
            .withColumn("usage_id_duplicate_rows", F.col("total_rows") - F.col("distinct_usage_id")))


def _contract_checks(t: Tables, c: Contract) -> list[DataFrame]:
    df, pk = getattr(t, c.table), F.col(c.primary_key)
    # One pass per table: rows and NULLs per key value give every count but the foreign keys'.
    per_key = df.groupBy(pk.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), *[count_if(F.col(col).isNull()).alias(f"missing_{col}") for col in c.not_null])
    counts = {f"primary_key:{c.primary_key}:duplicates": F.when(F.col("key").isNotNull() & (F.col("n") > 1), 1),
              f"primary_key:{c.primary_key}:nulls": F.when(F.col("key").isNull(), F.col("n")),
              **{f"not_null:{col}": F.col(f"missing_{col}") for col in c.not_null}}
    found = F.array(*[F.struct(F.lit(name).alias("constraint_name"),
                               F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("violations"))
                      for name, n in counts.items()])
    out = [per_key.agg(F.explode(found).alias("c")).select(F.lit(c.table).alias("table_name"), "c.*")]
    for col, parent, pcol in c.foreign_keys:
        # A NULL foreign key satisfies the constraint (SQL semantics); only dangling values violate it.
        dangling = orphan_count(df.filter(F.col(col).isNotNull()), col, getattr(t, parent), pcol, "violations")
        out.append(dangling.select(F.lit(c.table).alias("table_name"),
                                   F.lit(f"foreign_key:{col}->{parent}.{pcol}").alias("constraint_name"), "violations"))
    return out


def validate_contracts(t: Tables) -> DataFrame:
    """(table_name, constraint_name, violations) for every declared constraint."""
    return _union([f for c in CONTRACTS for f in _contract_checks(t, c)])


def range_check(df: DataFrame, col: str = "month_start") -> DataFrame:
    """(min_month, max_month, row_count) of a monthly view."""
    return df.agg(F.min(col).alias("min_month"), F.max(col).alias("max_month"),
                  F.count(F.lit(1)).alias("row_count"))


class TrustGateError(AssertionError):
    """Raised when the reconciliation or grain invariants do not hold."""


def trust_gate(tables: Tables) -> None:
    """Stop the pipeline when the numbers do not reconcile (the published 'stop and debug'
    rule): MRR and customer reconciliation diffs must be 0, and the support, usage and
    cohort views must hold one row per (month, account).  All checks are computed in one
    job over one union of tiny per-check results; only their (name, failures) rows reach
    the driver."""
    from sublens.operators import drivers, lenses
    from sublens.operators.snapshot import account_mrr_month

    snap = account_mrr_month(tables.subscriptions)
    checks = [
        lenses.check_mrr_reconciliation(lenses.revenue_waterfall_month(tables, snap))
        .agg(F.count(F.when(F.col("diff") != 0, 1)).alias("failures")).select(F.lit("mrr_reconciliation").alias("check"), "failures"),
        lenses.check_customer_reconciliation(lenses.logo_churn_month(tables, snap))
        .agg(F.count(F.when(F.col("diff") != 0, 1)).alias("failures")).select(F.lit("customer_reconciliation").alias("check"), "failures"),
        grain_check(drivers.support_account_month(tables.support_tickets), "month_start", "account_id")
        .select(F.lit("support_grain").alias("check"), F.col("bad_rows").alias("failures")),
        grain_check(drivers.usage_account_month(tables), "month_start", "account_id")
        .select(F.lit("usage_grain").alias("check"), F.col("bad_rows").alias("failures")),
        grain_check(drivers.account_month_cohorts(snap), "month_start", "account_id")
        .select(F.lit("cohort_grain").alias("check"), F.col("bad_rows").alias("failures")),
    ]
    failed = [(r["check"], r["failures"]) for r in _union(checks).filter(F.col("failures") > 0).collect()]
    if failed:
        raise TrustGateError(f"invariants violated: {failed}")
