"""Brute force checks of the operators built for skew, and plan shapes."""

import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import budgets, funnel, reports, skew
from tidemark.operators.filters import EventFilter
from tidemark.plans.queries import QUERIES
from tidemark.sources import testdata

BASE = datetime(2026, 9, 1)
SMALL = "/root/testdata/sf0.001"


def greedy(events, steps, window):
    previous, reached = None, 0
    for step in steps:
        match = [t for kind, t in events if kind == step and (previous is None or previous <= t <= previous + window)]
        if not match:
            break
        previous, reached = min(match), reached + 1
    return reached


@pytest.mark.parametrize("seed", [1, 2])
def test_funnel_same_as_fold(spark, monkeypatch, seed):
    # A tiny task size forces the division of hot users.
    monkeypatch.setattr(funnel, "found_hot", lambda rows, keys: skew.found_hot(rows, keys, rows_per_task=20))
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        user = "hot" if rng.random() < 0.35 else f"u{rng.randint(0, 25)}"
        rows.append((rng.choice("pq"), user, rng.choice("abcd"), BASE + timedelta(minutes=rng.randint(0, 3000))))
    frame = spark.createDataFrame(rows, "project_id STRING, user_id STRING, event_type STRING, occurred_at TIMESTAMP_NTZ")
    for steps, hours in ((["a", "b", "c"], 3), (["a", "a", "b", "a"], 10)):
        window = timedelta(hours=hours)
        found = funnel.funnel(frame, steps, BASE, BASE + timedelta(days=3), window).collect()
        expected = {}
        for p in "pq":
            users = {r[1] for r in rows if r[0] == p}
            depth = [greedy([(k, t) for pp, u, k, t in rows if (pp, u) == (p, user)], steps, window) for user in users]
            for i in range(len(steps)):
                expected[p, i + 1] = sum(d > i for d in depth)
        assert {(r.project_id, r.step): r.users for r in found} == expected


def test_percentiles(spark):
    rng = random.Random(3)
    data = {"a": [rng.randint(-5, 9_000_000) for _ in range(400)], "b": [7], "c": [rng.choice([1, 2_000_000]) for _ in range(50)]}
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k STRING, v BIGINT")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    disc = {r.k: r for r in skew.percentiles(frame, ["k"], "v", wanted, interpolate=False).collect()}
    cont = {r.k: r for r in skew.percentiles(frame, ["k"], "v", wanted, interpolate=True).collect()}
    for key, values in data.items():
        values.sort()
        for name, p in wanted.items():
            assert disc[key][name] == values[max(0, math.ceil(round(len(values) * p, 9)) - 1)]
            at = (len(values) - 1) * p
            low = math.floor(at)
            high = min(low + 1, len(values) - 1)
            assert cont[key][name] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k STRING, o INT, v BIGINT")
    found = {(r.k, r.o): r.cum_v for r in skew.running_totals(frame, ["k"], ["o"], ["v"]).collect()}
    for k, o, _ in rows:
        assert found[k, o] == sum(v for kk, oo, v in rows if kk == k and oo <= o)


def test_hot_keys_are_bounded_and_split(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    hot = skew.hot_keys(frame, ["k"], rows_per_task=100).collect()
    assert len(hot) == 1 and hot[0]["__slices"] >= 10
    small = frame.select("k").distinct().withColumn("x", F.lit(1))
    left, right, on = skew.split_hot(frame, small, ["k"], ["id"], skew.hot_keys(frame, ["k"], 100))
    joined = left.join(right, on)
    assert joined.count() == 3000
    assert joined.where("k = 'hot'").select("__slice").distinct().count() >= 10


def fold_windows(attempts, limit, width):
    """attempts: (time, id) in order; returns the allowed ids."""
    start, used, allowed = None, 0, set()
    for t, i in sorted(attempts):
        if start is not None and start > t - width:
            used += 1
        else:
            start, used = t, 1
        if used <= limit:
            allowed.add(i)
    return allowed


@pytest.mark.parametrize("seed,spread", [(1, 400), (2, 4000)])
def test_attempt_budget_same_as_fold(spark, seed, spread):
    rng = random.Random(seed)
    rows = [(f"a{i:03}", rng.choice(["ann", " Ann", "bob", "x" * 70]), BASE + timedelta(seconds=rng.randint(0, spread))) for i in range(220)]
    frame = spark.createDataFrame(rows, "attempt_id STRING, username STRING, attempted_at TIMESTAMP_NTZ")
    decided = {r.attempt_id: r for r in budgets.acquire(frame, global_limit=9, bucket_limit=3).collect()}
    width = timedelta(seconds=60)
    passed = fold_windows([(t, i) for i, _, t in rows], 9, width)
    expected = set()
    for bucket in {r.bucket for r in decided.values()}:
        expected |= fold_windows([(t, i) for i, _, t in rows if i in passed and decided[i].bucket == bucket], 3, width)
    assert {i for i, r in decided.items() if r.allowed} == expected
    assert len({decided[i].bucket for i, u, _ in rows if u.strip().lower() == "ann"}) == 1


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans(spark):
    for name in ("funnel_conversion", "retention_cohorts", "revenue_by_currency", "property_filter_summary", "canonical_fingerprint"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_what_it_needs(spark, tmp_path):
    from tidemark.sources import store

    store.write_events(testdata.events(spark, SMALL), str(tmp_path / "events"))
    events = store.read_events(spark, str(tmp_path / "events"))
    scope = EventFilter("p1", datetime(2024, 1, 3), datetime(2024, 1, 5), "view")
    report = reports.time_series(events, scope, "hour")
    text = plan(report)
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(occurred_date" in scan
    assert "EqualTo(event_type,view)" in scan and "GreaterThanOrEqual(occurred_at" in scan
    assert "properties" not in scan and "session_id" not in scan
    direct = reports.time_series(testdata.events(spark, SMALL), scope, "hour")
    assert report.collect() == direct.collect()


def test_summary_shuffles_once_per_sort(spark):
    text = plan(reports.event_summary(testdata.events(spark, SMALL)))
    assert text.count("Exchange hashpartitioning") == 1


def test_funnel_of_a_silent_project_and_one_scan(spark, tmp_path):
    rows = [("p", "u", "a", BASE), ("p", "u", "b", BASE)]
    schema = "project_id STRING, user_id STRING, event_type STRING, occurred_at TIMESTAMP_NTZ"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    projects = spark.createDataFrame([("p",), ("silent",)], "project_id STRING")
    found = funnel.funnel(events, ["a", "b", "a", "b"], BASE, BASE + timedelta(days=3), timedelta(hours=1), projects=projects)
    assert [(r.project_id, r.step, r.users) for r in found.collect()] == [*[("p", k, 1) for k in (1, 2, 3, 4)], *[("silent", k, 0) for k in (1, 2, 3, 4)]]
    assert str(tmp_path / "events") not in found._jdf.queryExecution().executedPlan().toString()  # read once, before


def test_crowded_minutes_take_time_in_proportion(spark):
    def seconds(n):
        attempts = spark.range(n).selectExpr("id AS attempt_id", "concat('u', id % 5) AS username", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id % 59 + id * 1e-6) AS attempted_at")
        started = time.perf_counter()
        assert budgets.acquire(attempts).where("allowed").count() > 0
        return time.perf_counter() - started

    seconds(1000)
    few, many = seconds(10_000), seconds(80_000)
    assert many < 4 * few + 5
