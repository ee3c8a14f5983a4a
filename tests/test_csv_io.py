"""CSV readers and writers: RFC 4180 text, kept spaces, FAILFAST on malformed rows."""

from __future__ import annotations

import os

import pytest
from conftest import churn, sub, ticket

from sublens.session import scratch_path
from sublens.sources import csv_io


def test_free_text_round_trips(spark, make_tables):
    events = [churn("C1", "A1", "2024-03-05", "pricing")]
    text = 'said "too dear",\nthen left'
    events = [e[:-1] + (text,) for e in events]
    t = make_tables([sub("S1", "A1", "2024-01-01")], churn_rows=events,
                    tickets=[ticket("T1", "A1", "2024-01-05", priority=" Urgent ")])
    (c,) = csv_io.round_trip(spark, t, "churn_events").collect()
    assert c.feedback_text == text
    (k,) = csv_io.round_trip(spark, t, "support_tickets").collect()
    assert k.priority == " Urgent "


def test_malformed_row_fails_the_load(spark):
    folder = scratch_path(spark, "bad-csv")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "part-0.csv"), "w") as f:
        f.write("subscription_id,account_id,start_date\nS1,A1,not-a-date,,,,,,,,,,,\n")
    with pytest.raises(Exception):
        csv_io.load_table(spark, "subscriptions", folder).collect()
