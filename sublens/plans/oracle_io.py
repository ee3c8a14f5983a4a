"""Oracle SQL for loaders, reload, views, extracts, notebook frames and profiling checks."""

from sublens.plans.oracle import final, fragment
from sublens.sources.schemas import CONTRACTS

TABLES = ("accounts", "subscriptions", "feature_usage_raw", "support_tickets", "churn_events")

final("load_accounts", "SELECT * FROM accounts", "accounts")
final("load_subscriptions", "SELECT * FROM subscriptions", "subscriptions")
final("load_feature_usage", """
SELECT usage_id, subscription_id, usage_date, feature_name, usage_count, usage_duration_secs, error_count,
       is_beta_feature
FROM feature_usage_raw""", "feature_usage_raw")
final("load_support_tickets", "SELECT * FROM support_tickets", "support_tickets")
final("load_churn_events", "SELECT * FROM churn_events", "churn_events")

fragment("row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES), *TABLES)
final("profile_row_counts", "SELECT * FROM row_counts", "row_counts")
final("reload_idempotent", "SELECT * FROM row_counts", "row_counts")
final("reload_streaming", "SELECT * FROM row_counts", "row_counts")
final("registered_views", "SELECT * FROM scoreboard_v", "scoreboard_v")

# What each published view holds a row for.
VIEWS = (("v_account_mrr_month", "snap"), ("v_logo_churn_month", "cal"), ("v_revenue_waterfall_month", "cal"),
         ("v_activity_churn_month", "cal"), ("v_churn_scoreboard_month", "cal"), ("v_mix_shift_by_plan_month", "mix_v"),
         ("v_support_account_month", "sup"), ("v_usage_account_month", "usg"), ("v_account_month_cohorts", "cohort"),
         ("v_churn_driver_table_3m", "dtable"), ("v_change_signals_3m_account", "sig"),
         ("v_change_signals_3m_summary", "(SELECT DISTINCT anchor_type FROM sig)"),
         ("v_change_signals_3m_summary_by_tier", "(SELECT DISTINCT anchor_type, plan_tier FROM sig_tier)"),
         ("v_reason_code_by_tier", "rbt"))
final("registered_view_counts", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS view_name, count(*) AS row_count FROM {of}" for v, of in VIEWS + tuple(zip(TABLES, TABLES))),
    "snap", "cal", "mix_v", "sup", "usg", "cohort", "dtable", "sig", "sig_tier", "rbt", *TABLES)

fragment("trends", """
SELECT month_start, logo_churn_rate, net_revenue_retention, activity_churn_rate FROM scoreboard_v""",
         "scoreboard_v")
final("extract_scoreboard_trends", "SELECT * FROM trends ORDER BY month_start", "trends")
final("freeze_extract", "SELECT * FROM trends ORDER BY month_start", "trends")
final("extract_scoreboard_trends_timestamp", "SELECT * REPLACE (CAST(month_start AS TIMESTAMP) AS month_start) FROM trends", "trends")
final("extract_waterfall_inputs", """
SELECT month_start, starting_mrr, new_mrr, expansion_mrr, contraction_mrr, churned_mrr, ending_mrr
FROM waterfall_v ORDER BY month_start""", "waterfall_v")
final("extract_mix_shift", """
SELECT month_start, plan_tier, paying_accounts, total_mrr, avg_mrr_per_account
FROM mix_v ORDER BY month_start, plan_tier""", "mix_v")
final("waterfall_for_month", """
SELECT month_start, starting_mrr, new_mrr, expansion_mrr, contraction_mrr, churned_mrr, ending_mrr
FROM waterfall_v WHERE month_start = DATE '1998-09-01'""", "waterfall_v")

STEPS = (("Starting", "starting_mrr", ""), ("New", "new_mrr", ""), ("Expansion", "expansion_mrr", ""),
         ("Contraction", "contraction_mrr", "-"), ("Churned", "churned_mrr", "-"), ("Ending", "ending_mrr", ""))
fragment("wf_long", "\nUNION ALL\n".join(
    f"SELECT month_start, {i} AS step, '{label}' AS label, CAST({sign}{col} AS DECIMAL(18,2)) AS value FROM waterfall_v"
    for i, (label, col, sign) in enumerate(STEPS, start=1)), "waterfall_v")
final("waterfall_long", "SELECT month_start, CAST(step AS INTEGER) AS step, label, value FROM wf_long", "wf_long")
for key, offset in (("waterfall_bases", ""),
                    ("waterfall_bases_as_published",
                     " - sum(CASE WHEN step = 1 THEN value END) OVER (PARTITION BY month_start ORDER BY step "
                     "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")):
    final(key, f"""
SELECT month_start, CAST(step AS INTEGER) AS step, label, value,
       CAST(CASE WHEN step IN (1, 6) THEN 0
                 ELSE sum(value) OVER (PARTITION BY month_start ORDER BY step
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING){offset} END
            AS DECIMAL(18,2)) AS base
FROM wf_long""", "wf_long")

TIERS = ("Basic", "Enterprise", "Pro")
fragment("mix_wide", "SELECT month_start, " + ", ".join(
    f"CAST(coalesce(sum(total_mrr) FILTER (WHERE plan_tier = '{t}'), 0) AS DECIMAL(18,2)) AS \"{t}\"" for t in TIERS)
    + "\nFROM mix_v WHERE plan_tier IS NOT NULL GROUP BY month_start", "mix_v")
final("mix_pivot", "SELECT * FROM mix_wide ORDER BY month_start", "mix_wide")
fragment("mix_long", "\nUNION ALL\n".join(
    f"SELECT month_start, '{t}' AS plan_tier, \"{t}\" AS total_mrr FROM mix_wide" for t in TIERS), "mix_wide")
final("mix_stack_offsets", """
SELECT month_start, plan_tier, total_mrr,
       CAST(coalesce(sum(total_mrr) OVER (PARTITION BY month_start ORDER BY plan_tier
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2))
         AS bottom
FROM mix_long""", "mix_long")
SERIES = (("Logo churn rate", "logo_churn_rate"), ("Net revenue retention (NRR)", "net_revenue_retention"),
          ("Activity churn rate", "activity_churn_rate"))
final("scoreboard_trend_long", "\nUNION ALL\n".join(
    f"SELECT month_start, '{col}' AS series, '{title}' AS title, {col} AS value FROM trends"
    for title, col in SERIES), "trends")

KEYS = (("accounts", "account_id"), ("subscriptions", "subscription_id"), ("feature_usage_raw", "row_id"),
        ("support_tickets", "ticket_id"), ("churn_events", "churn_event_id"))
final("profile_key_duplicates", "\nUNION ALL\n".join(
    f"SELECT '{t}.{k} duplicates' AS check_name, count(*) AS dupes "
    f"FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1) d" for t, k in KEYS), *TABLES)


def nulls(table: str, cols: tuple[str, ...]) -> str:
    parts = ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_{c}" for c in cols)
    return f"SELECT '{table}' AS table_name, {parts} FROM {table}"


final("profile_nulls_subscriptions", nulls("subscriptions", ("start_date", "account_id")), "subscriptions")
final("profile_nulls_usage", nulls("feature_usage_raw", ("usage_date", "subscription_id")), "feature_usage_raw")
final("profile_nulls_churn_events", nulls("churn_events", ("churn_date", "account_id")), "churn_events")
final("profile_nulls_support", nulls("support_tickets", ("account_id",)), "support_tickets")
final("profile_bad_intervals", """
SELECT count(*) AS bad_end_before_start FROM subscriptions WHERE end_date IS NOT NULL AND end_date < start_date""",
      "subscriptions")
final("profile_subscription_range", """
SELECT min(start_date) AS min_start_date, max(coalesce(end_date, start_date)) AS max_end_date FROM subscriptions""",
      "subscriptions")
final("profile_usage_range", """
SELECT min(usage_date) AS min_usage_date, max(usage_date) AS max_usage_date FROM feature_usage_raw""",
      "feature_usage_raw")


def orphan(child: str, fk: str, parent: str, pk: str, label: str) -> str:
    return (f"SELECT count(*) AS {label} FROM {child} c LEFT JOIN {parent} p ON p.{pk} = c.{fk} "
            f"WHERE p.{pk} IS NULL")


final("orphans_subscriptions", orphan("subscriptions", "account_id", "accounts", "account_id",
                                      "subscriptions_missing_account"), "subscriptions", "accounts")
final("orphans_usage", orphan("feature_usage_raw", "subscription_id", "subscriptions", "subscription_id",
                              "usage_missing_subscription"), "feature_usage_raw", "subscriptions")
final("orphans_churn_events", orphan("churn_events", "account_id", "accounts", "account_id",
                                     "churn_missing_account"), "churn_events", "accounts")
final("orphans_support", orphan("support_tickets", "account_id", "accounts", "account_id",
                                "support_missing_account"), "support_tickets", "accounts")
final("profile_usage_duplicates", """
SELECT count(*) AS total_rows, count(DISTINCT usage_id) AS distinct_usage_id,
       count(*) - count(DISTINCT usage_id) AS usage_id_duplicate_rows
FROM feature_usage_raw""", "feature_usage_raw")

_checks = []
for c in CONTRACTS:
    t, k = c.table, c.primary_key
    _checks.append(f"SELECT '{t}' AS table_name, 'primary_key:{k}:duplicates' AS constraint_name, count(*) AS violations "
                   f"FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1) d")
    _checks.append(f"SELECT '{t}', 'primary_key:{k}:nulls', count(*) FROM {t} WHERE {k} IS NULL")
    for col in c.not_null:
        _checks.append(f"SELECT '{t}', 'not_null:{col}', count(*) FROM {t} WHERE {col} IS NULL")
    for col, parent, pcol in c.foreign_keys:
        _checks.append(f"SELECT '{t}', 'foreign_key:{col}->{parent}.{pcol}', count(*) FROM {t} x "
                       f"WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = x.{col})")
for key in ("validate_contracts", "validate_contracts_landed"):
    final(key, "\nUNION ALL\n".join(_checks), *TABLES)
