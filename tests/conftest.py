from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sublens.sources.schemas import (  # noqa: E402
    ACCOUNTS, CHURN_EVENTS, FEATURE_USAGE, SUBSCRIPTIONS, SUPPORT_TICKETS,
)
from sublens.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark():
    from sublens.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app="sublens-tests")
    yield s
    s.stop()


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def sub(sid, account, start, end=None, mrr=100, tier="Basic", seats=1):
    """A subscriptions row with the less interesting columns filled in."""
    return (sid, account, d(start), d(end) if end else None, tier, seats, money(mrr),
            money(mrr * 12) if mrr is not None else None, False, False, False, end is not None, "monthly", True)


def usage(row_id, sid, day, count=1, feature="f1", usage_id=None):
    return (row_id, usage_id or f"u{row_id}", sid, d(day), feature, count, 60, 0, False)


def ticket(tid, account, day, closed=True, priority="high", escalated=False, hours=5, minutes=10, score=4):
    t = dt.datetime.fromisoformat(day)
    return (tid, account, t, t + dt.timedelta(days=1) if closed else None, money(hours), priority, minutes,
            money(score), escalated)


def churn(cid, account, day, reason="pricing", reactivation=False):
    return (cid, account, d(day), reason, money(0), False, False, reactivation, None)


@pytest.fixture
def make_tables(spark):
    def build(subscriptions=(), usage_rows=(), tickets=(), churn_rows=(), accounts=None):
        if accounts is None:
            ids = sorted({r[1] for r in subscriptions if r[1] is not None})
            accounts = [(a, a, "x", "y", d("2020-01-01"), "organic", "Basic", 1, False, False) for a in ids]
        return Tables(
            accounts=spark.createDataFrame(list(accounts), ACCOUNTS),
            subscriptions=spark.createDataFrame(list(subscriptions), SUBSCRIPTIONS),
            feature_usage_raw=spark.createDataFrame(list(usage_rows), FEATURE_USAGE),
            support_tickets=spark.createDataFrame(list(tickets), SUPPORT_TICKETS),
            churn_events=spark.createDataFrame(list(churn_rows), CHURN_EVENTS),
        )
    return build
