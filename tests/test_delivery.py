"""Outbox state machine, retention, erasure, mirror and registry."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import delivery, maintenance, mirror, registry, status

NOW = datetime(2026, 9, 10, 12)


def outbox(spark, *rows):
    """(event, attempts, published, completed, dead)"""
    return spark.createDataFrame(
        [("a", e, json.dumps({"eventId": e}), NOW, p, c, NOW, d, n, None) for e, n, p, c, d in rows], schemas.OUTBOX
    )


def failure(spark, *rows):
    return spark.createDataFrame(
        [("a", e, kind, "m" * 2000, permanent, NOW) for e, kind, permanent in rows],
        "project_id STRING, event_id STRING, error_type STRING, message STRING, permanent BOOLEAN, failed_at TIMESTAMP_NTZ",
    )


def rows(frame):
    return {r.event_id: r for r in frame.collect()}


def test_permanent_failure_is_dead_at_once(spark):
    found = rows(delivery.record_failures(outbox(spark, ("x", 0, NOW, None, None)), failure(spark, ("x", "JsonException", True))))
    assert found["x"].dead_lettered_at == NOW and found["x"].attempts == 1
    assert found["x"].last_error.startswith("JsonException: mmm") and len(found["x"].last_error) == 1000


def test_transient_failures_retry_then_die(spark):
    state = outbox(spark, ("x", 0, NOW, None, None), ("y", 0, NOW, None, None))
    for attempt in (1, 2):
        state = delivery.record_failures(state, failure(spark, ("x", "IOException", False), ("unknown", "IOException", False)), max_attempts=3)
        x = rows(state)["x"]
        wait = (x.next_attempt_at - NOW).total_seconds()
        assert x.attempts == attempt and x.dead_lettered_at is None and x.published_at is None
        assert 2**attempt <= wait <= 2**attempt * 1.2
    state = delivery.record_failures(state, failure(spark, ("x", "IOException", False)), max_attempts=3)
    found = rows(state)
    assert found["x"].dead_lettered_at == NOW and found["y"].published_at == NOW and len(found) == 2


def test_retry_delay_is_capped(spark):
    (row,) = spark.range(1).select(delivery.retry_seconds(F.lit(20), F.lit(1.0)).alias("s")).collect()
    assert row.s == pytest.approx(360.0)


def test_replay(spark):
    state = outbox(spark, ("x", 8, NOW, None, NOW), ("y", 8, NOW, None, NOW), ("z", 0, None, NOW, None))
    one, changed = delivery.replay_dead_letters(state, NOW, "a", "x")
    assert changed.count() == 1 and rows(one)["x"].attempts == 0 and rows(one)["y"].attempts == 8
    everything, changed = delivery.replay_dead_letters(one, NOW)
    assert changed.count() == 1 and all(r.dead_lettered_at is None for r in everything.collect()) and everything.count() == 3


def test_publish_and_complete(spark):
    state = outbox(spark, ("x", 0, None, None, None), ("y", 0, NOW, None, None))
    claimed = delivery.claim(state, NOW)
    assert [r.event_id for r in claimed.collect()] == ["x"]
    state = delivery.mark_published(state, claimed, NOW)
    assert delivery.envelopes(state, NOW).count() == 0
    inbox = spark.createDataFrame([("a", e, "{}", NOW, None) for e in "xy"], schemas.INBOX)
    sent = [
        {"project_id": "a", "event_id": "x", "payload": '{"eventId":"x"}'},
        {"project_id": "a", "event_id": "x", "payload": '{"eventId":"x"}'},
        {"project_id": "a", "event_id": "y", "payload": '{"eventId":"z"}'},
        {"project_id": "b", "event_id": "x", "payload": '{"eventId":"x"}'},
        {"project_id": "a", "event_id": "y", "payload": "{"},
    ]
    messages = spark.createDataFrame([(json.dumps(m),) for m in sent], "value STRING")
    read = delivery.read_deliveries(messages, state, inbox)
    assert sorted((r.project_id, r.event_id, r.error_type or "") for r in read.collect()) == [
        ("a", "x", ""), ("a", "y", "InvalidOperationException"), ("a", "y", "JsonException"), ("b", "x", "InvalidOperationException"),
    ]
    done = rows(delivery.complete(state, read.where("error_type IS NULL"), NOW))
    assert done["x"].completed_at == NOW and done["y"].completed_at is None


def event(e, user, at, **changes):
    row = dict(zip(schemas.struct(schemas.EVENTS).names, ("a", e, "login", 1, user, None, None, at, at, "{}")))
    row.update(changes)
    return tuple(row.values())


def test_retention_keeps_pending_work(spark):
    ages = {"old": (40, True), "identityOnly": (10, True), "pending": (40, False)}
    at = {e: NOW - timedelta(days=d) for e, (d, _) in ages.items()}
    tables = {
        "events": spark.createDataFrame([event(e, "u", at[e]) for e in ("old", "identityOnly")], schemas.EVENTS),
        "inbox": spark.createDataFrame([("a", e, "{}", at[e], at[e] if done else None) for e, (_, done) in ages.items()], schemas.INBOX),
        "identity": spark.createDataFrame([("a", e, "h", at[e], at[e], 10) for e in ages], schemas.IDENTITY),
        "outbox": outbox(spark, ("old", 0, None, None, None), ("pending", 0, None, None, None)),
        "projects": spark.createDataFrame([("a", "A", 3, 30), ("b", "B", 5, 5)], schemas.PROJECTS),
    }
    result = maintenance.retention_sweep(tables, maintenance.RetentionPolicy(8, 30), NOW)
    assert result["removed"].count() == 1 and result["events"].count() == 0
    assert [r.event_id for r in result["inbox"].collect()] == ["pending"]
    assert sorted(r.event_id for r in result["identity"].collect()) == ["identityOnly", "pending"]
    assert [r.event_id for r in result["outbox"].collect()] == ["pending"]
    assert [(r.id, r.event_count, r.stored_bytes) for r in result["projects"].collect()] == [("a", 2, 20), ("b", 0, 0)]


def test_retention_policy():
    for bad in ((5, 30), (30, 20), (30, 5000)):
        with pytest.raises(ValueError):
            maintenance.RetentionPolicy(*bad)


def test_erasure(spark):
    people = {"s1": "gdpr-user-1", "s2": "gdpr-user-1", "s3": "keep-user-2"}
    tables = {
        "events": spark.createDataFrame([event("s1", "gdpr-user-1", NOW)], schemas.EVENTS),
        "inbox": spark.createDataFrame([("a", e, json.dumps({"userId": u}), NOW, None) for e, u in people.items()], schemas.INBOX),
        "identity": spark.createDataFrame([("a", e, "h", NOW, NOW, 10) for e in people], schemas.IDENTITY),
        "outbox": outbox(spark, *[(e, 8, None, None, NOW) for e in people]),
        "projects": spark.createDataFrame([("a", "A", 3, 30), ("b", "B", 5, 5)], schemas.PROJECTS),
    }
    result = maintenance.erase_subject(tables, "a", "gdpr-user-1")
    assert result["erased"].count() == 2 and result["events"].count() == 0
    for name in ("inbox", "identity", "outbox"):
        assert [r.event_id for r in result[name].collect()] == ["s3"]
    assert sorted((r.id, r.event_count) for r in result["projects"].collect()) == [("a", 1), ("b", 5)]
    reopened, _ = delivery.replay_dead_letters(result["outbox"], NOW)
    assert [r.event_id for r in reopened.collect()] == ["s3"]


def test_mirror(spark):
    copies = [event("x", "u", NOW) + (NOW,), event("x", "v", NOW) + (NOW + timedelta(1),), event("y", None, NOW) + (NOW,)]
    copies = spark.createDataFrame(copies, schemas.MIRROR_EVENTS)
    newest = rows(mirror.latest(copies))
    assert newest["x"].user_id == "v" and newest["y"].user_id is None
    events = spark.createDataFrame([event(e, "u", NOW) for e in "xyz"], schemas.EVENTS)
    queue = spark.createDataFrame([("a", "x", NOW, None)], schemas.MIRROR_QUEUE)
    added = mirror.backfill(queue, events, NOW, NOW, NOW)
    assert sorted(r.event_id for r in added.collect()) == ["y", "z"]
    assert mirror.backfill(queue.unionByName(added), events, NOW, NOW, NOW).count() == 0
    (bucket,) = mirror.reconcile(events, copies).collect()
    assert (bucket.source_events, bucket.mirror_events, bucket.discrepancy, bucket.matches) == (3, 2, 1, False)


def test_registry(spark):
    known = spark.createDataFrame([("a", "login", 1, "{}", NOW)], schemas.EVENT_SCHEMAS)
    wanted = spark.createDataFrame(
        [("a", "login", 1, '{"x":1}'), ("a", "login", 2, "{}"), ("a", " ", 1, "{}"), ("a", "z", 0, "{}"), ("a", "z", 1, "[]")],
        "project_id STRING, event_type STRING, version INT, definition STRING",
    )
    fresh, refused = registry.publish_schemas(known, wanted, NOW)
    assert [(r.event_type, r.version) for r in fresh.collect()] == [("login", 2)] and refused.count() == 4
    views = spark.createDataFrame([("1", "a", "u", "mine", "{}", NOW, NOW)], schemas.SAVED_VIEWS)
    later = NOW + timedelta(hours=1)
    row = {"id": "1", "project_id": "a", "user_id": "u", "name": " new ", "definition": '{"eventType":"login"}'}
    (changed,) = registry.save_view(views, row, later).collect()
    assert (changed.name, changed.created_at, changed.updated_at) == ("new", NOW, later)
    with pytest.raises(ValueError):
        registry.save_view(views, {**row, "id": "2", "name": "mine"}, later)
    assert registry.view_filter(row["definition"]).event_type == "login"


def test_counters_overflow(spark):
    seen = spark.createDataFrame([(k, 1, i) for i, k in enumerate("abcabd")], "reason STRING, amount INT, at INT")
    found = {r.reason: r.total for r in status.bounded_counters(seen, "reason", "amount", "at", 2).collect()}
    assert found == {"a": 2, "b": 2, "_other": 2}


def test_fingerprints(spark):
    left = spark.createDataFrame([("events", 1), ("inbox", 2)], "measure STRING, amount BIGINT")
    right = spark.createDataFrame([("events", 1), ("inbox", 3)], "measure STRING, amount BIGINT")
    assert {r.measure: r.matches for r in status.compare_fingerprints(left, right).collect()} == {"events": True, "inbox": False}
