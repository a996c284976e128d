"""Streaming jobs: exactly-once effect, receipts, carried windows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas, session
from tidemark.operators import admission, delivery
from tidemark.sources import store, testdata
from tidemark.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_inbox_projection_is_idempotent(spark, tmp_path):
    inbox = testdata.inbox(spark, SMALL)
    inbox.repartition(3).write.parquet(str(tmp_path / "inbox"))
    target = str(tmp_path / "events")

    def run(checkpoint):
        stream = jobs.table_stream(spark, str(tmp_path / "inbox"), schemas.INBOX, max_files=1)
        query = jobs.project_inbox(stream, target, str(tmp_path / checkpoint))
        query.awaitTermination()
        return query

    query = run("c1")
    assert store.read_events(spark, target).count() == inbox.count()
    gauges = jobs.progress_rows(query)
    assert sum(g.input_rows for g in gauges) == inbox.count() and gauges[0].observed["projection"].rows > 0
    run("c1")
    run("c2")  # a lost checkpoint replays everything
    inbox.limit(5).write.mode("append").parquet(str(tmp_path / "inbox"))
    run("c1")
    stored = store.read_events(spark, target).drop("occurred_date")
    assert stored.count() == inbox.count()
    assert stored.exceptAll(testdata.events(spark, SMALL)).count() == 0


def guid(n):
    return f"00000000-0000-4000-8000-{n:012}"


def wire(n, kind="login", **changes):
    return {"eventId": guid(n), "eventType": kind, "schemaVersion": 1, "occurredAt": "2026-09-10T10:00:00Z", "userId": "u1", **changes}


def send(spark, folder, *batches):
    rows = [("a", b, datetime(2026, 9, 10, 12) + timedelta(seconds=i), json.dumps({"events": e})) for b, i, e in batches]
    schema = "project_id STRING, batch_id STRING, batch_at TIMESTAMP_NTZ, value STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return schema


def test_ingest(spark, tmp_path):
    frames, root = tmp_path / "frames", str(tmp_path / "root")
    equal = wire(1, " login ", occurredAt="2026-09-10T17:00:00+07:00", properties={})
    schema = send(
        spark, frames,
        ("b1", 1, [wire(1), wire(2), wire(2)]),
        ("b2", 2, [wire(3), wire(4, " ")]),
        ("b3", 3, [wire(3), None]),
    )

    def run():
        jobs.ingest(jobs.table_stream(spark, str(frames), schema), root, str(tmp_path / "c"), admission.Limits(4, None)).awaitTermination()

    run()
    send(
        spark, frames,
        ("b4", 4, [equal, wire(5)]),
        ("b5", 5, [wire(6), wire(1, "logout")]),
        ("b6", 6, [wire(6), wire(7)]),
        ("b7", 7, [wire(6)]),
    )
    run()
    decisions = {r.batch_id: r.reason for r in spark.read.parquet(f"{root}/decisions").collect()}
    assert decisions == {"b1": None, "b2": "validation", "b3": "validation", "b4": None, "b5": "conflict", "b6": "quota", "b7": None}
    receipts = spark.read.parquet(f"{root}/receipts").orderBy("batch_id", "ordinal").collect()
    assert [(r.batch_id, r.event_id[-1], r.already_accepted) for r in receipts] == [
        ("b1", "1", False), ("b1", "2", False), ("b1", "2", True), ("b4", "1", True), ("b4", "5", False), ("b7", "6", False),
    ]
    assert receipts[3].received_at == receipts[0].received_at
    inbox = spark.read.parquet(f"{root}/inbox").drop("batch")
    assert sorted(r.event_id[-1] for r in inbox.collect()) == ["1", "2", "5", "6"]
    projected = jobs.inbox_events(inbox)
    assert {r.event_type for r in projected.collect()} == {"login"}
    rejects = spark.read.parquet(f"{root}/rejects")
    assert rejects.where("batch_id = 'b2'").select(F.explode("errors").alias("e")).select("e.field").collect()[0].field == "eventType"


def test_direct_mode(spark, tmp_path):
    frames, root = tmp_path / "frames", str(tmp_path / "root")
    schema = send(spark, frames, ("b1", 1, [wire(1), wire(2, properties={"b": 1.50, "a": 1})]))
    jobs.ingest(jobs.table_stream(spark, str(frames), schema), root, str(tmp_path / "c"), mode="direct").awaitTermination()
    stored = {r.event_id: r.properties for r in store.read_events(spark, f"{root}/events").collect()}
    assert stored == {guid(1): "{}", guid(2): '{"a":1,"b":1.5}'}
    assert {r.status for r in spark.read.parquet(f"{root}/receipts").collect()} == {"persisted"}


def test_budget_windows_are_carried(spark, tmp_path):
    folder, root = tmp_path / "attempts", str(tmp_path / "root")
    schema = "attempt_id STRING, username STRING, attempted_at TIMESTAMP_NTZ"
    base = datetime(2026, 9, 10)

    def run(*rows):
        frame = spark.createDataFrame([(i, "ann", base + timedelta(seconds=s)) for i, s in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        jobs.attempt_budget(jobs.table_stream(spark, str(folder), schema), root, str(tmp_path / "c"), limit=2).awaitTermination()

    run(("a", 0), ("b", 10))
    run(("c", 59), ("d", 60), ("e", 61))
    run(("f", 119), ("g", 120), ("h", 121))
    decided = {r.attempt_id: r.allowed for r in spark.read.parquet(f"{root}/decisions").collect()}
    assert decided == {"a": True, "b": True, "c": False, "d": True, "e": True, "f": False, "g": True, "h": True}


def test_late_events_update_their_bucket(spark, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "counts")

    def add(*days):
        at = [datetime(2026, 9, d) for d in days]
        rows = [("a", f"{d}-{i}", "login", 1, None, None, None, t, t, "{}") for i, (d, t) in enumerate(zip(days, at))]
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        jobs.event_counts(jobs.table_stream(spark, folder, schemas.EVENTS), target, str(tmp_path / "c")).awaitTermination()

    add(10, 10, 11)
    add(10)
    found = {r.bucket.day: r.events for r in jobs.latest_counts(spark, target).collect()}
    assert found == {10: 3, 11: 1}


def test_mirror_replay(spark, tmp_path):
    testdata.events(spark, SMALL).write.parquet(str(tmp_path / "events"))
    for checkpoint in ("c1", "c2"):
        stream = jobs.table_stream(spark, str(tmp_path / "events"), schemas.EVENTS)
        jobs.mirror_events(stream, str(tmp_path / "mirror"), str(tmp_path / checkpoint)).awaitTermination()
    events = testdata.events(spark, SMALL).count()
    assert spark.read.parquet(str(tmp_path / "mirror")).count() == 2 * events
    assert store.read_mirror(spark, str(tmp_path / "mirror")).count() == events


def newest_first(spark, tmp_path, layout):
    """The events in three files, newest days first, beside each other or as one folder."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy(F.col("ts").desc())
    rows = events.collect()
    third = len(rows) // 3 + 1
    if layout == "folder":
        for i in range(0, len(rows), third):
            spark.createDataFrame(rows[i : i + third], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    else:
        import shutil

        shutil.copy(f"{SMALL}/events.parquet", tmp_path / "events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_streams_lose_nothing_that_comes_late(spark, tmp_path, layout):
    (tmp_path / "in").mkdir()
    folder, root = newest_first(spark, tmp_path / "in", layout), str(tmp_path)
    tables = testdata.StreamingTables(spark, max_files=1)
    jobs.event_counts(testdata.events(tables, folder), f"{root}/counts", f"{root}/c1").awaitTermination()
    counted = jobs.latest_counts(spark, f"{root}/counts")
    events = testdata.events(spark, folder)
    expected = events.groupBy("project_id", F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("events"))
    assert counted.exceptAll(expected).isEmpty() and expected.exceptAll(counted).isEmpty()

    twice = testdata.events(tables, folder).select("project_id", "event_id", "received_at")
    for run in ("c2", "c2"):
        jobs.deduplicate(twice, f"{root}/once", f"{root}/{run}").awaitTermination()
    keys = spark.read.parquet(f"{root}/once").select("project_id", "event_id")
    assert keys.count() == keys.distinct().count() == events.select("project_id", "event_id").distinct().count()
    batches = spark.read.parquet(f"{root}/once").select("batch").distinct().count()
    assert batches == (3 if layout == "folder" else 1)


def test_deduplicate_over_micro_batches(spark, tmp_path):
    schema = "project_id STRING, event_id STRING, received_at TIMESTAMP_NTZ"
    for day in (20, 3, 11):
        rows = [("a", f"e{n}", datetime(2024, 1, day, 1, n)) for n in range(6)] + [("a", f"d{day}", datetime(2024, 1, day))] * 3
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    jobs.deduplicate(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    stored = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(stored) == sorted([f"e{n}" for n in range(6)] + ["d20", "d3", "d11"])


def test_deployment_limits_reach_over_micro_batches(spark, tmp_path):
    frames, root = tmp_path / "frames", str(tmp_path / "root")
    schema = send(spark, frames, ("b1", 1, [wire(1), wire(2)]))
    limits = admission.Limits(None, None, max_outbox_pending=2)

    def run(outbox_now=None):
        stream = jobs.table_stream(spark, str(frames), schema)
        jobs.ingest(stream, root, str(tmp_path / "c"), limits, outbox_now=outbox_now).awaitTermination()
        return {r.batch_id: r.reason for r in spark.read.parquet(f"{root}/decisions").collect()}

    run()
    send(spark, frames, ("b2", 2, [wire(3), wire(4)]))
    assert run() == {"b1": None, "b2": "quota"}
    outbox = spark.read.parquet(f"{root}/outbox").select(*schemas.struct(schemas.OUTBOX).names)
    assert outbox.count() == 2 and spark.read.parquet(f"{root}/mirror_queue").count() == 2
    send(spark, frames, ("b3", 3, [wire(3), wire(4)]))
    done = delivery.complete(outbox, outbox.select("project_id", "event_id"), datetime(2026, 9, 11))
    assert run(lambda _: done)["b3"] is None


def test_scratch_is_left_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path / "scratch"))
    store.insert_absent(testdata.events(spark, SMALL), str(tmp_path / "events"))
    assert store.read_events(spark, str(tmp_path / "events")).count() == testdata.events(spark, SMALL).count()
    assert not [p for p in (tmp_path / "scratch" / "tidemark").iterdir()]
