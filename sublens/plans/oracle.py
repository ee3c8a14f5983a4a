"""DuckDB oracle SQL for every registered query.

The oracle is an independent, literal statement of each definition: theta joins, dense
spines, LAG and ROW_NUMBER exactly as the definitions read, so it checks the rewritten
Spark plans (exploded intervals, sparse state, struct maxima, merged aggregates).

DuckDB sees only the driver's tables, so each statement starts with the fixture
derivation (FIXTURES.md section 2) as CTEs.  Fragments are named CTE bodies with their
dependencies; `sql_for(name)` emits `WITH <needed fragments in order> <final select>`.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}
FINAL: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, sql: str, *deps: str) -> None:
    FRAGMENTS[name] = (sql, deps)


def final(name: str, sql: str, *deps: str) -> None:
    FINAL[name] = (sql, deps)


def _order(deps: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in FRAGMENTS[n][1]:
            visit(d)
        seen.append(n)

    for d in deps:
        visit(d)
    return seen


def sql_for(name: str) -> str:
    body, deps = FINAL[name]
    names = _order(deps)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS (\n{FRAGMENTS[n][0]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"


def all_sql() -> dict[str, str]:
    from sublens.plans import oracle_core, oracle_drivers, oracle_io  # noqa: F401
    return {k: sql_for(k) for k in FINAL}


# ---------------------------------------------------------------------------------------
# Fixture tables (FIXTURES.md section 2), derived from the driver's views.
# ---------------------------------------------------------------------------------------

def _key(letter: str, expr: str) -> str:
    return f"('{letter}-' || lpad(CAST({expr} AS VARCHAR), 9, '0'))"


fragment("accounts", f"""
SELECT {_key('A', 'c.c_custkey')} AS account_id,
       c.c_name AS account_name,
       c.c_mktsegment AS industry,
       n.n_name AS country,
       DATE '1995-01-01' + CAST((c.c_custkey * 11) % 2400 AS INTEGER) AS signup_date,
       CASE c.c_custkey % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'ads' WHEN 2 THEN 'partner' WHEN 3 THEN 'event' END
         AS referral_source,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' WHEN 2 THEN 'Enterprise' END AS plan_tier,
       CAST(1 + c.c_custkey % 200 AS INTEGER) AS seats,
       (c.c_custkey % 17 = 0) AS is_trial,
       (c.c_custkey % 5 = 0) AS churn_flag
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")

fragment("subscriptions", f"""
SELECT subscription_id, account_id, start_date, end_date, plan_tier, seats, mrr_amount,
       CAST(mrr_amount * 12 AS DECIMAL(12,2)) AS arr_amount,
       is_trial, upgrade_flag, downgrade_flag, (end_date IS NOT NULL) AS churn_flag,
       billing_frequency, auto_renew_flag
FROM (
  SELECT {_key('S', 'o_orderkey')} AS subscription_id,
         {_key('A', 'o_custkey')} AS account_id,
         CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderkey % 1000 = 3 THEN CAST(o_orderdate AS DATE) - 1
              WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(20 + (o_orderkey * 13) % 180 AS INTEGER) END AS end_date,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL
              ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' WHEN 2 THEN 'Enterprise' END END
           AS plan_tier,
         CAST(1 + o_orderkey % 200 AS INTEGER) AS seats,
         CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DECIMAL(12,2))
              WHEN o_orderkey % 97 = 0 THEN NULL
              ELSE CAST(19 + (o_orderkey * 37) % 4000 AS DECIMAL(12,2)) END AS mrr_amount,
         (o_orderkey % 9 = 0) AS is_trial,
         (o_orderkey % 6 = 1) AS upgrade_flag,
         (o_orderkey % 6 = 2) AS downgrade_flag,
         CASE o_orderkey % 2 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' END AS billing_frequency,
         (o_orderkey % 2 = 0) AS auto_renew_flag
  FROM orders) o""")

fragment("feature_usage_raw", f"""
SELECT row_number() OVER () AS row_id,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS usage_id,
       {_key('S', 'l_orderkey')} AS subscription_id,
       CAST(l_shipdate AS DATE) AS usage_date,
       'feature_' || CAST(l_partkey % 40 AS VARCHAR) AS feature_name,
       CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 0
            ELSE CAST(l_quantity AS INTEGER) END AS usage_count,
       CAST(60 + (l_partkey * 7) % 3600 AS INTEGER) AS usage_duration_secs,
       CAST(l_linenumber % 3 AS INTEGER) AS error_count,
       (l_partkey % 10 = 0) AS is_beta_feature
FROM lineitem""")

fragment("support_tickets", f"""
SELECT {_key('T', 'event_id')} AS ticket_id,
       CASE WHEN event_id % 500 = 7 THEN 'A-unknown'
            WHEN event_id % 500 = 8 THEN NULL
            ELSE {_key('A', 'user_id * 10 + event_id % 10')} END AS account_id,
       CAST(DATE '1995-01-01' + CAST((event_id * 7) % 2600 AS INTEGER) AS TIMESTAMP) AS submitted_at,
       CASE WHEN event_id % 6 = 0 THEN NULL
            ELSE CAST(DATE '1995-01-01' + CAST((event_id * 7) % 2600 + 1 + event_id % 9 AS INTEGER) AS TIMESTAMP)
       END AS closed_at,
       CAST(4 + event_id % 200 AS DECIMAL(12,2)) AS resolution_time_hours,
       CASE event_type WHEN 'error' THEN ' Urgent ' WHEN 'purchase' THEN 'HIGH' WHEN 'view' THEN 'low'
                       WHEN 'click' THEN 'medium' END AS priority,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 3) % 500 AS INTEGER) END
         AS first_response_time_minutes,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS DECIMAL(6,2)) END AS satisfaction_score,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type = 'error' END AS escalation_flag
FROM events""")

fragment("churn_events", f"""
SELECT {_key('C', 'o_orderkey')} AS churn_event_id,
       {_key('A', 'o_custkey')} AS account_id,
       CAST(o_orderdate AS DATE) + CAST(21 + (o_orderkey * 13) % 180 AS INTEGER) AS churn_date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'pricing' WHEN '2-HIGH' THEN 'support'
                            WHEN '3-MEDIUM' THEN 'features' WHEN '5-LOW' THEN 'budget' END AS reason_code,
       CAST(o_orderkey % 300 AS DECIMAL(12,2)) AS refund_amount_usd,
       (o_orderkey % 6 = 1) AS preceding_upgrade_flag,
       (o_orderkey % 6 = 2) AS preceding_downgrade_flag,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 = 0 END AS is_reactivation,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'said "too dear", order ' || CAST(o_orderkey AS VARCHAR) END
         AS feedback_text
FROM orders
WHERE o_orderstatus = 'F'""")
