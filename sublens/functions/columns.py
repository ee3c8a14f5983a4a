"""

* months are DATE values at the first of the month;
* rates divide doubles and yield NULL for a zero denominator (never raise under ANSI);
* averages are a sum divided once by the count, unrounded: sums of integers and decimals are
  exact, so the quotient depends neither on the order partial sums are combined in nor on
  the engine (round6 is for comparing averages of doubles, in registered queries only);
* money totals are decimal(18,2): numeric(12,2) overflows once totals pass 10^10.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AVG_DIGITS = 6
SCALE = 10.0 ** AVG_DIGITS
WHOLE = 2.0 ** 53  # doubles from here on are whole numbers
MONEY_TOTAL = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_of(c) -> Column:
    """First day of the month of a date or timestamp, as DATE."""
    return F.trunc(F.to_date(_c(c)), "MM")


def month_diff(later, earlier) -> Column:
    """Whole calendar months from `earlier` to `later` (int)."""
    a, b = _c(later), _c(earlier)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def ratio(num, den) -> Column:
    """num / den as double, NULL when den is 0 or NULL."""
    d = _c(den).cast("double")
    return _c(num).cast("double") / F.when(d != 0, d)


def count_if(cond: Column) -> Column:
    """COUNT(*) FILTER (WHERE cond): rows where cond is true (NULL counts as false)."""
    return F.count(F.when(cond, F.lit(1)))


def round6(x) -> Column:
    """x rounded half-up to 6 decimals with plain IEEE operations (floor(x*1e6 + 0.5) / 1e6),
    so any engine computing the same formula from the same double gets the same result.
    From WHOLE / 1e6 on a double has no such decimals left and stays as it is (floor would
    saturate at the largest bigint)."""
    v = _c(x).cast("double")
    return F.when(F.abs(v) < F.lit(WHOLE / SCALE), F.floor(v * F.lit(SCALE) + F.lit(0.5)) / F.lit(SCALE)).otherwise(v)


def _filtered(c, where: Column | None) -> Column:
    v = _c(c)
    return v if where is None else F.when(where, v)


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n)


def average(c, where: Column | None = None) -> Column:
    """AVG of a numeric column as double, unrounded; NULL when no row has a value."""
    v = _filtered(c, where)
    return _mean(F.sum(v), F.count(v))


def share(cond: Column) -> Column:
    """Share of rows where cond is true; NULL cond counts as 0 (AVG(CASE .. 1 ELSE 0))."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def money_total(c, where: Column | None = None) -> Column:
    """SUM of a money column (optionally filtered) as decimal(18,2); NULL when no row matches."""
    v = _c(c)
    if where is not None:
        v = F.when(where, v)
    return F.sum(v).cast(MONEY_TOTAL)
