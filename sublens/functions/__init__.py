"""Column-level helpers shared by the operators (all built-in Spark expressions)."""

from sublens.functions.columns import (  # noqa: F401
    average, count_if, money_total, month_diff, month_of, ratio, round6, share,
)
