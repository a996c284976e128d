"""Sweep, erasure and pages on stored tables: equal to the whole-table operators, and which days they touch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explorer, maintenance
from tidemark.operators.filters import EventFilter
from tidemark.plans import queries
from tidemark.sources import parts, stored, testdata

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return queries._stored_tables(spark, SMALL)


def folders(table):
    return dict(table._now()[1])


def test_sweep_leaves_later_days_alone(spark, tables):
    # Only two events of one expired day are still pending.
    inbox = tables["inbox"]
    spared = [r.event_id for r in inbox.read(["2024-01-04"]).limit(2).collect()]
    done = F.when(F.col("event_id").isin(spared), F.lit(None)).otherwise(F.coalesce("processed_at", "received_at"))
    inbox.rewrite(inbox.read().withColumn("processed_at", done), inbox.parts())
    before = {name: folders(t) for name, t in tables.items()}
    whole = maintenance.retention_sweep({n: t.read().drop(parts.PART) for n, t in tables.items()}, maintenance.RetentionPolicy(15, 20), queries.NOW)
    expected = {n: sorted((r.project_id, r.event_id) for r in whole[n].select("project_id", "event_id").collect()) for n in tables}
    looked = stored.sweep(tables, maintenance.RetentionPolicy(15, 20), queries.NOW, "sweep", 1)
    for name, table in tables.items():
        assert sorted((r.project_id, r.event_id) for r in table.read().collect()) == expected[name]
        border = "2024-01-17" if name in ("events", "inbox") else "2024-01-12"
        after = folders(table)
        assert all(after[p] == f for p, f in before[name].items() if p > border) and max(looked[name]) == border
        assert {p for p in after if p <= border} == {"2024-01-04", border}
    stored.sweep(tables, maintenance.RetentionPolicy(15, 20), queries.NOW, "sweep", 1)  # repeated
    assert tables["events"].read().count() == len(expected["events"])


def test_erasure_writes_the_subjects_days_only(spark, tables):
    before = {name: folders(t) for name, t in tables.items()}
    mine = testdata.events(spark, SMALL).where("project_id = 'p1' AND user_id = 'u7'")
    expected = {r.d for r in mine.select(F.date_format("occurred_at", "yyyy-MM-dd").alias("d")).distinct().collect()}
    days = stored.erase(tables, "p1", "u7")
    assert set(days) == expected and 0 < len(days) < len(before["events"])
    for name, table in tables.items():
        after = folders(table)
        assert {p for p in before[name] if after.get(p) != before[name][p]} <= expected
        assert table.read().join(mine, ["project_id", "event_id"], "left_semi").isEmpty()
    assert stored.erase(tables, "p1", "nobody") == []


def test_page_reads_few_days(spark, tables):
    scope, seen = EventFilter("p1", datetime(2024, 1, 1), datetime(2024, 2, 1)), []
    after = explorer.Cursor(explorer.scope_hash(scope), datetime(2024, 1, 15), "000000000000")
    rows = stored.timeline(tables["events"], scope, 4, after, seen.append)
    events = testdata.events(spark, SMALL)
    assert rows == explorer.timeline(events, scope, 4, after).collect() and seen == [["2024-01-15"]]
    seen.clear()
    rows = stored.timeline(tables["events"], scope, 40, None, seen.append)
    assert rows == explorer.timeline(events, scope, 40).collect() and sum(map(len, seen)) <= 15
    nobody = EventFilter("p1", datetime(2024, 1, 1), datetime(2024, 1, 9), user_id="nobody")
    assert stored.timeline(tables["events"], nobody, 10) == []
