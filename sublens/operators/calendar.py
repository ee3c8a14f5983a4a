"""The month calendar of the subscription data.

The calendar runs from the month of the earliest start_date to the month of the latest
COALESCE(end_date, start_date).  It has one row per month, so its size is bounded by the
calendar span (at most 12 rows per year covered), never by the number of subscriptions;
that bound is what makes it safe to broadcast or inline as a scalar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sublens.functions.columns import month_of


def month_bounds(subscriptions: DataFrame) -> DataFrame:
    """One row (min_month, max_month); both NULL for an empty table."""
    return subscriptions.agg(
        month_of(F.min("start_date")).alias("min_month"),
        month_of(F.max(F.coalesce("end_date", "start_date"))).alias("max_month"),
    )


def _bounds_struct(subscriptions: DataFrame) -> Column:
    """One bounds subquery per subscriptions frame, kept on the frame: every operator of a query
    that needs the calendar refers to the same scalar subquery, so Spark evaluates the global
    aggregate once instead of planning a separate scan of the source for each use."""
    if "_month_bounds" not in subscriptions.__dict__:
        subscriptions.__dict__["_month_bounds"] = month_bounds(subscriptions).select(F.struct("min_month", "max_month").alias("b")).scalar()
    return subscriptions.__dict__["_month_bounds"]


def bound_scalars(subscriptions: DataFrame) -> tuple[Column, Column]:
    """(min_month, max_month) as scalar-subquery columns: computed once per query by a
    global aggregate and inlined into every row that uses them, without a join."""
    b = _bounds_struct(subscriptions)
    return b.getField("min_month"), b.getField("max_month")


def month_calendar(subscriptions: DataFrame) -> DataFrame:
    """(month_start, month_end) for every calendar month; 0 rows when there are no bounds."""
    lo, hi = bound_scalars(subscriptions)
    return (subscriptions.sparkSession.range(1)
            .select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
            .select("month_start", F.last_day("month_start").alias("month_end")))
