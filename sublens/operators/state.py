"""Account-month state for the churn lenses.

The published definitions build a dense spine (every account in scope x every calendar
month), LEFT JOIN the snapshot and usage onto it and read the previous calendar month
with LAG.  Every lens count needs the account to be paying in the month or in the one
before, so only account-months next to a snapshot row can contribute.  The lenses
therefore run on a sparse state: snapshot and usage rows are brought together by account
(`account_cells`, one shuffle, one aggregation), where a window reads the month before and
adds the month after a row that has none of its own.

The dense state (C9, C15) lays the same rows on the whole calendar in one explode.  The
calendar churn basis is run-length coded: an account's rows and the gaps between them are
runs of months (`calendar_runs`), as many as twice its rows and one, however long the
calendar.  Runs become months only where a result has a row for every month (`run_months`),
and then only for the months asked for.  The dense spine itself is offered too (C8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from sublens.functions.columns import month_of
from sublens.operators.calendar import bound_scalars
from sublens.operators.snapshot import keyed_ranges, months_of_range, mrr_of_key, together
from sublens.sources.tables import Tables


def zero_money() -> F.Column:
    return F.lit(0).cast("decimal(12,2)")


def accounts_in_scope(subscriptions: DataFrame) -> DataFrame:
    """Distinct account_id of the subscriptions (NULL included, as DISTINCT keeps it)."""
    return subscriptions.select("account_id").distinct()


def account_month_spine(subscriptions: DataFrame) -> DataFrame:
    """Every account in scope x every calendar month, generated per account."""
    min_month, max_month = bound_scalars(subscriptions)
    return (accounts_in_scope(subscriptions)
            .select("account_id",
                    F.explode(F.sequence(min_month, max_month, F.expr("INTERVAL 1 MONTH"))).alias("month_start")))


def usage_by_account_month(tables: Tables) -> DataFrame:
    """(account_id, month_start, total_usage_count); inner join, so orphan usage drops.

    Usage rows meet the subscriptions as they are (a key with most rows is split by AQE) and are
    summed once, in the tasks of the join before they are shuffled by account and month."""
    usage = tables.feature_usage_raw.select("subscription_id", month_of("usage_date").alias("month_start"),
                                            F.coalesce("usage_count", F.lit(0)).alias("usage_sum"))
    return (usage.join(tables.subscriptions.select("subscription_id", "account_id"), "subscription_id", "inner")
            .groupBy("account_id", "month_start")
            .agg(F.sum("usage_sum").cast("bigint").alias("total_usage_count")))


def account_cells(tables: Tables, snapshot: DataFrame | None = None, with_usage: bool = True, marked: bool = False) -> DataFrame:
    """account_id, month_start, mrr_amount[, total_usage_count]: one row per account and month that has
    a snapshot or usage row, all rows of an account in one task, so LAG and LEAD need no other shuffle.

    Without a snapshot, subscriptions are shuffled as ranges of months, one row for those of an
    account with the same range, and become months behind the shuffle: an account's rows there
    are bounded by the calendar.  NULL values where the dense spine would have no row; rows of a
    NULL account and months beyond the calendar are left out.  marked: one more row for each
    account in scope (NULL too), in the month before the calendar.
    """
    subs = tables.subscriptions
    min_month, max_month = bound_scalars(subs)
    if snapshot is None:
        rows, mrr = keyed_ranges(subs).withColumnRenamed("winner_key", "best"), mrr_of_key("best")
    else:
        rows = (snapshot.where(F.col("month_start") <= max_month)
                .select("account_id", F.col("month_start").alias("first_month"), F.col("month_start").alias("last_month"), F.col("mrr_amount").alias("best")))
        mrr = F.col("best")
    if with_usage:
        use = usage_by_account_month(tables).where((F.col("month_start") >= min_month) & (F.col("month_start") <= max_month))
        rows = rows.unionByName(use.select("account_id", F.col("month_start").alias("first_month"), F.col("month_start").alias("last_month"), "total_usage_count"),
                                allowMissingColumns=True)
    rows = rows.where("account_id is not null")
    if marked:
        month = F.add_months(min_month, -1)
        rows = rows.unionByName(accounts_in_scope(subs).select("account_id", month.alias("first_month"), month.alias("last_month")), allowMissingColumns=True)
    values = ["best", *["total_usage_count"] * with_usage]
    # Each (account, month) has at most one usage value, so MAX just picks it; of the keys it is the winner.
    cells = (together(rows).select("account_id", months_of_range(), *values)
             .groupBy("account_id", "month_start").agg(*[F.max(v).alias(v) for v in values]))
    return cells.select("account_id", "month_start", mrr.alias("mrr_amount"), *values[1:])


def _by_account() -> WindowSpec:
    return Window.partitionBy("account_id").orderBy("month_start")


def _of_month_before(value: str) -> F.Column:
    """`value` of the account's row of the calendar month before, NULL if there is none."""
    before = F.lag("month_start").over(_by_account())
    return F.when(before == F.add_months("month_start", -1), F.lag(value).over(_by_account()))


def account_month_flows(tables: Tables, snapshot: DataFrame | None = None,
                        with_usage: bool = True, paying_rows_only: bool = True) -> DataFrame:
    """Sparse state: (account_id, month_start, mrr_amount, prev_mrr[, total_usage_count,
    prev_usage_count]) for account-months of the calendar next to a snapshot row.

    Values are NULL where the dense spine would have no snapshot / usage row; callers
    coalesce.  With paying_rows_only=False the usage-only account-months are kept too.
    """
    _, max_month = bound_scalars(tables.subscriptions)
    cells = account_cells(tables, snapshot, with_usage)
    previous = {"mrr_amount": "prev_mrr", **({"total_usage_count": "prev_usage_count"} if with_usage else {})}
    following = F.add_months("month_start", 1)
    gap = (F.coalesce(F.lead("month_start").over(_by_account()) > following, F.lit(True)) & (following <= max_month))
    known = cells.select("*", *[_of_month_before(v).alias(p) for v, p in previous.items()], gap.alias("gap"))
    own, after = [F.col("month_start")], [following.alias("month_start")]
    for value, prev in previous.items():
        own += [F.col(value), F.col(prev)]
        after += [F.lit(None).cast(cells.schema[value].dataType).alias(value), F.col(value).alias(prev)]
    months = F.when(F.col("gap"), F.array(F.struct(*own), F.struct(*after))).otherwise(F.array(F.struct(*own)))
    state = known.select("account_id", F.explode(months).alias("r")).select("account_id", "r.*")
    if paying_rows_only:
        state = state.filter(F.col("mrr_amount").isNotNull() | F.col("prev_mrr").isNotNull())
    return state


def calendar_runs(tables: Tables, cells: DataFrame) -> DataFrame:
    """The whole calendar of every account in scope as runs of months: columns of `cells` with
    `month_start` (first month) and `run_end` (last month).

    cells: at most one row per account and calendar month.  Each is a run of one month; every
    stretch of months around and between them is one run with NULL in the other columns.  A
    NULL account's cells are left out (an equality with the spine never meets them); its
    calendar is one empty run.  A mark per account in the month before the calendar makes the
    gap at its start, and that of an account without cells, a gap like all others.
    """
    min_month, max_month = bound_scalars(tables.subscriptions)
    marks = accounts_in_scope(tables.subscriptions).select("account_id", F.add_months(min_month, -1).alias("month_start"))
    rows = cells.where("account_id is not null").unionByName(marks, allowMissingColumns=True)
    following = F.lead("month_start").over(Window.partitionBy("account_id").orderBy("month_start"))
    values = [c for c in cells.columns if c not in ("account_id", "month_start")]
    own = F.struct(F.col("month_start").alias("first"), F.col("month_start").alias("last"), *values)
    gap = F.struct(F.add_months("month_start", 1).alias("first"), F.add_months(F.coalesce(following, F.add_months(max_month, 1)), -1).alias("last"),
                   *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in values])
    return (rows.select("account_id", F.array(own, gap).alias("runs")).select("account_id", F.explode("runs").alias("run"))
            .where((F.col("run.first") <= F.col("run.last")) & (F.col("run.first") >= min_month))
            .select("account_id", F.col("run.first").alias("month_start"), F.col("run.last").alias("run_end"), *[f"run.{c}" for c in values]))


def run_end(rows: DataFrame) -> F.Column:
    """Last month of a row: `run_end` of runs, the row's own month of a snapshot."""
    return F.col("run_end") if "run_end" in rows.columns else F.col("month_start")


def run_months(rows: DataFrame, first: F.Column | None = None, last: F.Column | None = None) -> DataFrame:
    """One row per month of each run, from `first` to `last` (NULL: unbounded); `prev_mrr`, if there,
    becomes the MRR of the month before.  Rows that aren't runs are only filtered."""
    begin = F.col("month_start") if first is None else F.greatest("month_start", first)
    end = run_end(rows) if last is None else F.least(run_end(rows), last)
    rows = rows.where(begin <= end)
    if "run_end" not in rows.columns:
        return rows
    others = [c for c in rows.columns if c not in ("month_start", "run_end")]
    every = rows.select(*others, F.col("month_start").alias("run_start"), F.explode(F.sequence(begin, end, F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    if "prev_mrr" in others:
        every = every.withColumn("prev_mrr", F.when(F.col("month_start") == F.col("run_start"), F.col("prev_mrr")).otherwise(F.col("mrr_amount")))
    return every.drop("run_start")


def _on_every_month(tables: Tables, cells: DataFrame) -> DataFrame:
    """Marked cells laid on every calendar month of every account in scope; their values and those of
    the month before (`prev_` and the name), NULL where there is no cell."""
    min_month, max_month = bound_scalars(tables.subscriptions)
    values = [c for c in cells.columns if c not in ("account_id", "month_start")]
    until = F.coalesce(F.add_months(F.lead("month_start").over(_by_account()), -1), max_month)
    known = cells.select("account_id", F.col("month_start").alias("cell"), F.greatest("month_start", min_month).alias("first"), until.alias("until"),
                         *values, *[_of_month_before(v).alias(f"before_{v}") for v in values])
    every = (known.where("first <= until")
             .select("*", F.add_months("cell", 1).alias("following"), F.explode(F.sequence("first", "until", F.expr("INTERVAL 1 MONTH"))).alias("month_start")))
    own, following = F.col("month_start") == F.col("cell"), F.col("month_start") == F.col("following")
    return every.select("month_start", "account_id", *[F.when(own, F.col(v)).alias(v) for v in values],
                        *[F.when(own, F.col(f"before_{v}")).when(following, F.col(v)).alias(f"prev_{v}") for v in values])


def account_month_state(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """Dense (month_start, account_id, mrr_amount, prev_mrr) over the spine, 0 where absent."""
    dense = _on_every_month(tables, account_cells(tables, snapshot, with_usage=False, marked=True))
    return dense.select("month_start", "account_id", F.coalesce("mrr_amount", zero_money()).alias("mrr_amount"),
                        F.coalesce("prev_mrr_amount", zero_money()).alias("prev_mrr"))


def calendar_snapshot(tables: Tables, snapshot: DataFrame) -> DataFrame:
    """The snapshot laid on every calendar month of every account, as runs: 0 MRR where it has no
    row, plan_tier (if the snapshot has it) of the last month paid so far.  Cohorts, anchors,
    signals and reasons built on it take the calendar churn basis (an account that disappears
    churns); built on the snapshot itself they take the published observed one."""
    runs = calendar_runs(tables, snapshot.select("account_id", "month_start", "mrr_amount", *(["plan_tier"] if "plan_tier" in snapshot.columns else [])))
    if "plan_tier" in runs.columns:
        paid = F.when(F.col("mrr_amount") > 0, F.struct("month_start", "plan_tier"))
        so_far = Window.partitionBy("account_id").orderBy("month_start")
        runs = runs.withColumn("plan_tier", F.max(paid).over(so_far)["plan_tier"])
    return runs.withColumn("mrr_amount", F.coalesce("mrr_amount", zero_money()))


def _flag(c) -> F.Column:
    return F.when(c > 0, F.lit(1)).otherwise(F.lit(0))


def account_activity_state(tables: Tables, snapshot: DataFrame | None = None) -> DataFrame:
    """C14 + C15: dense paying / active flags with their previous-month values."""
    j = _on_every_month(tables, account_cells(tables, snapshot, marked=True))
    mrr = F.coalesce("mrr_amount", zero_money())
    use = F.coalesce("total_usage_count", F.lit(0).cast("bigint"))
    return j.select(
        "month_start", "account_id",
        mrr.alias("mrr_amount"),
        use.alias("total_usage_count"),
        _flag(mrr).alias("is_paying"),
        _flag(use).alias("is_active"),
        _flag(F.coalesce("prev_total_usage_count", F.lit(0))).alias("prev_is_active"),
        _flag(F.coalesce("prev_mrr_amount", zero_money())).alias("prev_is_paying"),
    )
