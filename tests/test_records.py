"""Quoted CSV in many tasks against the one-task reader; keys that stay; versions that switch whole."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sublens.session import scratch_path
from sublens.sources import csv_io, records, warehouse
from sublens.sources.schemas import CHURN_EVENTS
from sublens.sources.tables import Tables

HEADER = ",".join(f.name for f in CHURN_EVENTS.fields)


def put(spark, name, *files):
    folder = scratch_path(spark, name)
    os.makedirs(folder, exist_ok=True)
    for i, content in enumerate(files):
        with open(os.path.join(folder, f"part-{i}.csv"), "wb") as f:
            f.write(content.encode())
    return folder


def event(i, feedback):
    return f"C{i},A{i % 7},2024-01-{1 + i % 28:02d},pricing,{i}.50,true,false,,{feedback}"


def quoted(rng, newline):
    parts = ["plain", "", '""', ", ", newline, newline * 2, '""""', "é" * 5, "x" * rng.randint(1, 300)]
    return '"' + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + '"'


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that records, quotes and CRLF lie across their borders."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_reader_equals_the_multi_line_reader(spark, tiny_splits, newline):
    rng = random.Random(3)
    rows = [event(i, rng.choice([quoted(rng, newline), "bare text", "", '"a ""quote"" here"'])) for i in range(150)]
    rows.insert(40, event(999, '"' + ("long " + newline) * 400 + '"'))  # over many whole splits
    text = newline.join([HEADER, *rows[:70], "", *rows[70:]])
    folder = put(spark, "quoted", text + newline, newline.join([HEADER, *rows[:5]]), HEADER + newline, "")
    want = sorted(map(tuple, csv_io.read_csv(spark, folder, CHURN_EVENTS, multi_line=True).collect()), key=str)
    assert len(want) == 156
    for size in (61, 173, 1000, 1 << 27):
        tiny_splits(size)
        got = csv_io.load_table(spark, "churn_events", folder)
        assert sorted(map(tuple, got.collect()), key=str) == want
    tiny_splits(173)
    lines = records.text_lines(spark, folder)
    assert lines.rdd.getNumPartitions() > 50 and records.splits(lines).where("crossed").count() > 20
    assert csv_io.load_table(spark, "churn_events", folder).where("feedback_text like '%long%'").count() == 1


def test_a_quote_or_line_end_at_any_split_border(spark, tiny_splits):
    folder = put(spark, "border", "\n".join([HEADER, event(1, '"a\n""b""\r\n\n"'), event(2, '"""\n"'), event(3, '"\n"'), event(4, "end")]))
    want = sorted(map(tuple, csv_io.read_csv(spark, folder, CHURN_EVENTS, multi_line=True).collect()), key=str)
    assert len(want) == 4
    for size in range(20, 90, 7):
        tiny_splits(size)
        assert sorted(map(tuple, csv_io.load_table(spark, "churn_events", folder).collect()), key=str) == want


def test_malformed_records_fail_the_load(spark):
    with pytest.raises(Exception):
        csv_io.load_table(spark, "churn_events", put(spark, "bad", HEADER + "\n" + event(1, "x") + "\nC2,A2,not a date,,,,,,\n")).collect()
    with pytest.raises(Exception):
        csv_io.load_table(spark, "churn_events", put(spark, "short", HEADER + "\nC2,A2\n")).collect()
    assert csv_io.load_table(spark, "churn_events", put(spark, "none", HEADER + "\n")).count() == 0


USAGE = "usage_id,subscription_id,usage_date,feature_name,usage_count,usage_duration_secs,error_count,is_beta_feature"


def test_row_ids_stay_over_actions_reruns_and_splits(spark, tiny_splits):
    files = [USAGE + "\n" + "".join(f"u{k},S{k},2024-01-01,f,{k},1,0,false\n" for k in range(f, 400, 3)) for f in range(3)]
    folder = put(spark, "usage", *files)

    def ids():
        return sorted((r.row_id, r.usage_id) for r in csv_io.load_table(spark, "feature_usage_raw", folder).collect())
    want = ids()
    assert len({i for i, _ in want}) == 400 and ids() == want
    assert want[0] == (1, "u0") and want[-1] == (2 << 36 | 133, "u398")
    tiny_splits(97)
    assert ids() == want
    held = csv_io.load_table(spark, "feature_usage_raw", folder)
    assert held.join(held.select(F.col("row_id"), F.col("usage_id").alias("other")), "row_id").where("usage_id = other").count() == 400


def versioned(make_tables, n):
    from conftest import sub
    return make_tables([sub(f"S{i}", "A1", "2024-01-01") for i in range(n)])


def folders(place):
    return sorted(os.listdir(os.path.join(place, "data")))


def test_a_reader_sees_one_whole_version(spark, make_tables, monkeypatch):
    place = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        warehouse.current(spark, place)
    assert warehouse.replace(spark, place, versioned(make_tables, 2)) == 1
    reader = warehouse.current(spark, place)
    # a load that dies between two tables, and one that dies before it is published
    write = warehouse._write

    def dying(spark, place, folder, name, rows):
        if name == "support_tickets":
            raise KeyboardInterrupt
        return write(spark, place, folder, name, rows)
    for what, broken in (("_write", dying), ("publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))):
        with monkeypatch.context() as m:
            m.setattr(warehouse, what, broken)
            with pytest.raises(KeyboardInterrupt):
                warehouse.replace(spark, place, versioned(make_tables, 9))
        assert warehouse.current(spark, place).subscriptions.count() == 2
    # a load that completes: the reader of before keeps its version
    assert warehouse.replace(spark, place, versioned(make_tables, 5)) == 2
    assert reader.subscriptions.count() == 2 and warehouse.current(spark, place).subscriptions.count() == 5
    assert warehouse.current(spark, place, version=1).subscriptions.count() == 2
    with pytest.raises(Exception):
        warehouse.publish(spark, place, 2, [("accounts", "", "data/other")])
    assert len(folders(place)) == 4 and len(warehouse.expire(spark, place, keep=1)) == 3
    assert warehouse.versions(spark, place) == [2] and len(folders(place)) == 1
    assert warehouse.current(spark, place).subscriptions.count() == 5


def test_a_late_file_rewrites_only_its_months(spark):
    place, first, late = (scratch_path(spark, n) for n in ("monthly", "first", "late"))
    day = lambda k, m: f"u{k},S1,{m},f,{k},1,0,false\n"
    os.makedirs(first)
    os.makedirs(late)
    for name, schema in csv_io.FILE_SCHEMAS.items():
        with open(os.path.join(first, f"{name}.csv"), "w") as f:
            f.write(",".join(schema.fieldNames()) + "\n")
            if name == "feature_usage_raw":
                f.write(day(1, "2024-01-31") + day(2, "2024-02-01") + day(3, "2024-02-29") + day(4, "2024-03-01"))
    with open(os.path.join(late, "usage.csv"), "w") as f:
        f.write(USAGE + "\n" + day(5, "2024-02-10") + day(6, "2024-05-10"))
    csv_io.reload(spark, first, place)
    before = dict((m, f) for t, m, f in warehouse.published(spark, place, 1) if t == "feature_usage_raw")
    assert sorted(before) == ["2024-01", "2024-02", "2024-03"]
    whole = csv_io.add_late_file(spark, "feature_usage_raw", late, place)
    after = dict((m, f) for t, m, f in warehouse.published(spark, place, 2) if t == "feature_usage_raw")
    assert sorted(after) == ["2024-01", "2024-02", "2024-03", "2024-05"]
    assert {m for m in before if before[m] == after[m]} == {"2024-01", "2024-03"}
    rows = whole.feature_usage_raw.collect()
    assert sorted(r.usage_id for r in rows) == [f"u{k}" for k in range(1, 7)] and len({r.row_id for r in rows}) == 6
    february = warehouse.current(spark, place, first="2024-02", last="2024-02").feature_usage_raw
    assert sorted(r.usage_id for r in february.collect()) == ["u2", "u3", "u5"]
    assert all("event_month=2024-02" in f for f in february.inputFiles())
    assert warehouse.current(spark, place, version=1).feature_usage_raw.count() == 4
    assert len(warehouse.expire(spark, place, keep=1)) == 0  # the new version still names folders of the old
    assert warehouse.current(spark, place).feature_usage_raw.count() == 6 and warehouse.current(spark, place, first="2025-01").feature_usage_raw.count() == 0


def _planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_load_hands_its_lines_to_python_once_for_the_records(spark):
    """Splits are measured without Python, and a file's name doesn't go there with every line."""
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("u1,S1,2024-03-03,f,1,1,1,true",)], "value string").write.text(path)
    assert "MapInArrow" not in _planned(records.splits(records.text_lines(spark, path)))
    plan = _planned(csv_io.load_table(spark, "feature_usage_raw", path))
    assert plan.count("MapInArrow") == 2 and not re.search(r"MapInArrow cut\([^)]*file#", plan)
