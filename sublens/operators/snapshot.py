"""The month-end account snapshot.

A subscription is active in a month when it is active on the month's last day:
start_date <= month_end <= COALESCE(end_date, +inf) (end inclusive).  Instead of a theta
join between months and subscriptions (a nested-loop join in Spark) each subscription
computes its own first and last active month and explodes that range, so the work is
linear in the number of active (subscription, month) rows.

The winner per (month, account) is the subscription with the latest start_date, then
the higher MRR (NULL taken as 0), then the higher subscription_id.  Start day and cents fit
in one long that keeps their order (`winner_key`), so the winner is MAX over a long: a
hash aggregate on both sides of the shuffle, whose map-side step reduces a hot account to
one row per month inside each task.

Ties of the long are settled before the months are exploded.  Tied subscriptions of an
account begin in the same month, so of two the one with the lower id can only win after
the other's last month; cutting its range there (`_winning_ranges`) leaves at most one
subscription for each key, account and month.  The winner's other columns come back by an
equi-join on (account, key).  `account_mrr` needs neither: the MRR is in the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sublens.functions.columns import month_of
from sublens.operators.calendar import bound_scalars

MONEY = "decimal(12,2)"
CENTS_SPAN = 1 << 41  # cents of a decimal(12,2), negative ones too
CENTS_ZERO = 1 << 40


def _mrr() -> Column:
    return F.coalesce("mrr_amount", F.lit(0).cast(MONEY)).cast(MONEY)


def _active_ranges(subscriptions: DataFrame) -> DataFrame:
    """`subscriptions` with the first and last month it is active at the end of; others dropped."""
    _, max_month = bound_scalars(subscriptions)
    # Last month whose final day is <= end_date: the month of (end_date + 1 day), minus one.
    last = F.when(F.col("end_date").isNull(), max_month).otherwise(F.add_months(month_of(F.date_add("end_date", 1)), -1))
    return subscriptions.withColumns({"first_month": month_of("start_date"), "last_month": last}).where("first_month <= last_month")


def months_of_range() -> Column:
    return F.explode(F.sequence("first_month", "last_month", F.expr("INTERVAL 1 MONTH"))).alias("month_start")


def active_month_rows(subscriptions: DataFrame) -> DataFrame:
    """One row per (subscription, month) in which the subscription is active at month end."""
    return (_active_ranges(subscriptions)
            .select("account_id", "subscription_id", "plan_tier", "seats", _mrr().alias("mrr_amount"),
                    "start_date", "end_date", months_of_range())
            .withColumn("month_end", F.last_day("month_start")))


def winner_key() -> Column:
    """(start_date, MRR) as one long in their order: days of any year up to 13000, 41 bits of cents."""
    return (F.unix_date("start_date").cast("bigint") * F.lit(CENTS_SPAN) + (_mrr() * 100).cast("bigint") + F.lit(CENTS_ZERO))


def mrr_of_key(key: str) -> Column:
    return ((F.pmod(F.col(key), F.lit(CENTS_SPAN)) - F.lit(CENTS_ZERO)).cast("decimal(14,0)") / F.lit(100)).cast(MONEY)


def _best_keys(ranges: DataFrame) -> DataFrame:
    return ranges.select("account_id", "winner_key", months_of_range()).groupBy("month_start", "account_id").agg(F.max("winner_key").alias("winner_key"))


def _winning_ranges(ranges: DataFrame) -> DataFrame:
    """Month ranges of tied subscriptions (same account and key) cut to the months each wins: those
    after the last month of every tied one with a higher id.  Rows without a month left go."""
    higher = Window.partitionBy("account_id", "winner_key").orderBy(F.desc("subscription_id")).rowsBetween(Window.unboundedPreceding, -1)
    free = F.add_months(F.max("last_month").over(higher), 1)
    return ranges.withColumn("first_month", F.greatest("first_month", free)).where("first_month <= last_month")


def keyed_ranges(subscriptions: DataFrame) -> DataFrame:
    """account_id, first_month, last_month, winner_key: the best key of each account and month range.
    An account has at most as many rows as the calendar has ranges, however many subscriptions."""
    return (_active_ranges(subscriptions).select("account_id", "first_month", "last_month", winner_key().alias("winner_key"))
            .groupBy("account_id", "first_month", "last_month").agg(F.max("winner_key").alias("winner_key")))


def together(rows: DataFrame) -> DataFrame:
    """All rows of an account in one task.  The number of tasks is given, so AQE doesn't merge them by
    their size in the shuffle: ranges grow when they become months."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account_id")


def account_mrr(subscriptions: DataFrame) -> DataFrame:
    """The MRR part of C5, without a join: month_start, account_id, mrr_amount.  Ranges become months
    behind a shuffle by account, which serves windows and joins by account too."""
    best = _best_keys(together(keyed_ranges(subscriptions)))
    return best.select("month_start", "account_id", mrr_of_key("winner_key").alias("mrr_amount"))


def account_mrr_month(subscriptions: DataFrame) -> DataFrame:
    """One row per (month_start, account_id) with the winning subscription."""
    ranges = _winning_ranges(_active_ranges(subscriptions).select(
        "account_id", "subscription_id", "plan_tier", "seats", winner_key().alias("winner_key"), "first_month", "last_month"))
    best, own = _best_keys(ranges).alias("best"), ranges.alias("own")
    same = (F.col("best.account_id").eqNullSafe(F.col("own.account_id")) & (F.col("best.winner_key") == F.col("own.winner_key"))
            & F.col("month_start").between(F.col("first_month"), F.col("last_month")))
    return best.join(own, same).select("month_start", "best.account_id", "subscription_id", "plan_tier", "seats",
                                       mrr_of_key("best.winner_key").alias("mrr_amount"))


def account_mrr_month_top(snapshot: DataFrame, n: int = 10) -> DataFrame:
    """First n snapshot rows by (month_start, account_id)."""
    return snapshot.orderBy(F.col("month_start").asc_nulls_last(), F.col("account_id").asc_nulls_last()).limit(n)
