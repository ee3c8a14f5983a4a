"""sublens: subscription churn and retention analytics as lazy Spark DataFrame transforms.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to the
driver.  The five input tables (accounts, subscriptions, feature_usage_raw,
support_tickets, churn_events) travel together in :class:`sublens.sources.tables.Tables`.
"""

from sublens.sources.tables import Tables

__all__ = ["Tables"]
