"""The running outbox: due times, retries, dead letters, repeated micro-batches, and gauges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import parts, store, testdata
from tidemark.streaming import broker, jobs

ARRIVALS = "at TIMESTAMP_NTZ, project_id STRING, event_id STRING, payload STRING"
START = datetime(2026, 9, 10)


def body(i):
    return f'{{"eventId":"{i}","eventType":"login","schemaVersion":1,"occurredAt":"2026-09-10T00:00:00Z","properties":{{}}}}'


def send(spark, folder, second, *ids):
    rows = [(START + timedelta(seconds=second), "a", i, body(i)) for i in ids] or [(START + timedelta(seconds=second), None, None, None)]
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, answers, root=None, checkpoint="c", max_attempts=3):
    stream = jobs.table_stream(spark, str(tmp_path / "in"), ARRIVALS, max_files=1)
    root = root or str(tmp_path / "root")
    broker.deliver(stream, root, str(tmp_path / checkpoint), answers, max_attempts, F.lit(0.0)).awaitTermination()
    return {r.event_id: r for r in broker.outbox_now(spark, root).collect()}


def answers(sent):
    kind = F.when(F.col("event_id") == "bad", F.lit("FormatException")).when(
        (F.col("event_id") == "down") | ((F.col("event_id") == "slow") & (F.col("attempts") < 1)), F.lit("IOException")
    )
    once = sent.select("project_id", "event_id", kind.alias("error_type"), F.lit("m").alias("message"))
    return once.union(once).where("event_id <> 'mute'")  # the broker may answer twice, or not at all


def test_messages_come_due_and_end(spark, tmp_path):
    send(spark, tmp_path / "in", 0, "ok", "bad", "slow", "down", "mute")
    send(spark, tmp_path / "in", 1)  # two seconds' delay: nothing is due
    send(spark, tmp_path / "in", 2)
    found = run(spark, tmp_path, answers)
    assert found["ok"].completed_at == START and found["ok"].attempts == 0
    assert found["bad"].dead_lettered_at == START and found["bad"].last_error == "FormatException: m"
    assert found["slow"].completed_at == START + timedelta(seconds=2) and found["slow"].attempts == 1
    assert found["down"].attempts == found["mute"].attempts == 2 and found["down"].next_attempt_at == START + timedelta(seconds=6)
    assert found["mute"].last_error.startswith("TimeoutException") and found["mute"].published_at is None
    send(spark, tmp_path / "in", 5, "late")
    send(spark, tmp_path / "in", 6)
    found = run(spark, tmp_path, answers)  # goes on after a restart
    assert {i: r.dead_lettered_at for i, r in found.items() if r.dead_lettered_at} == {"bad": START, "down": START + timedelta(seconds=6), "mute": START + timedelta(seconds=6)}
    root = str(tmp_path / "root")
    assert sorted(r.event_id for r in store.read_events(spark, f"{root}/events").collect()) == ["late", "ok", "slow"]
    assert spark.read.parquet(f"{root}/mirror_queue").count() == 3
    shown = {r.batch: r for r in broker.gauges(spark, root).collect()}
    assert [shown[b].outbox_pending for b in range(5)] == [3, 3, 2, 2, 0]
    assert [shown[b].inbox_pending for b in range(5)] == [4, 4, 3, 3, 3]
    assert shown[2].outbox_oldest_seconds == 2.0 and shown[4].outbox_oldest_seconds is None and shown[1].published == 0
    table = broker.outbox_table(spark, root)
    assert table.parts() == ["2026-09-10"] and len(table.versions()) == parts.KEPT


def test_a_micro_batch_that_fails_half_way_is_repeated(spark, tmp_path, monkeypatch):
    send(spark, tmp_path / "in", 0, "ok", "slow", "down")
    send(spark, tmp_path / "in", 2, "new")
    expected = run(spark, tmp_path, answers, str(tmp_path / "sound"), "c1")
    whole = parts.Parts.change
    failed = []

    def broken(self, rows, replaced=(), writer=None, number=0):
        if self.root.endswith("outbox") and number not in failed:
            failed.append(number)
            raise RuntimeError("lost before the commit")
        whole(self, rows, replaced, writer, number)

    monkeypatch.setattr(parts.Parts, "change", broken)
    for _ in range(2):
        with pytest.raises(Exception):
            run(spark, tmp_path, answers)
    found = run(spark, tmp_path, answers)
    assert found == expected and failed == [0, 1]
    root = str(tmp_path / "root")
    assert broker.gauges(spark, root).count() == 2 and store.read_events(spark, f"{root}/events").count() == 3
    # A replay under another checkpoint delivers again, but stores nothing twice.
    run(spark, tmp_path, answers, checkpoint="c2")
    assert store.read_events(spark, f"{root}/events").count() == 3


def test_state_is_bounded_by_live_keys(spark, tmp_path):
    """Fifty micro-batches and a restart: what a micro-batch reads does not grow."""
    schema = "attempt_id STRING, username STRING, attempted_at TIMESTAMP_NTZ"

    def attempts(numbers):
        for n in numbers:
            rows = [(f"{n}-{i}", f"user{i % 3}", START + timedelta(seconds=20 * n + i)) for i in range(4)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.table_stream(spark, str(tmp_path / "in"), schema, max_files=1)
        jobs.attempt_budget(stream, root, str(tmp_path / "c"), limit=2, global_limit=None).awaitTermination()

    root = str(tmp_path / "root")
    attempts(range(2))
    attempts(range(2, 7))
    state = parts.Parts(spark, f"{root}/open", "scope STRING, bucket STRING, t BIGINT, used BIGINT")
    assert state.read().count() == 3 and len(state.versions()) == parts.KEPT
    decided = spark.read.parquet(f"{root}/decisions")
    assert decided.count() == 28 and decided.where("allowed").count() < 28
    counts = str(tmp_path / "counts")
    table = jobs._counts(spark, counts)
    day = spark.createDataFrame([("a", START, "login", 1)], jobs.COUNTS).withColumn(parts.PART, F.lit("2026-09-10"))
    for n in range(50):
        table = jobs._counts(spark, counts) if n == 25 else table  # the job was started again
        table.append(day, "w", n)
        assert len(table._now()[1]["2026-09-10"]) <= 2 * parts.MOST
    assert [r.events for r in jobs.latest_counts(spark, counts, ["2026-09-10"]).collect()] == [50]
    assert jobs.latest_counts(spark, counts, ["2026-09-11"]).isEmpty()


def test_few_keys_read_few_buckets(spark, tmp_path):
    identities = store.key_table(spark, str(tmp_path / "identity"), schemas.IDENTITY)
    identity = testdata.identity(spark, "/root/testdata/sf0.001")
    identities.append(store.bucketed(identity, 64))
    keys = identity.limit(10)
    found = store.matching(identities, keys, buckets=64)
    assert len(found.inputFiles()) <= 10 < len(identities.parts())
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(event_id" in plan
    assert found.join(keys, ["project_id", "event_id"], "left_semi").count() == 10
    many = store.matching(identities, identity, buckets=64, pushed=20)  # too many to push: left to the join
    assert many.count() == identity.count()


def test_a_month_without_news_is_not_written(spark, tmp_path):
    events = testdata.events(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "mirror")
    store.merge_mirror(events, path)
    moved = events.limit(5).withColumn("occurred_at", F.col("occurred_at") + F.expr("INTERVAL '60' DAY")).withColumn("received_at", F.col("received_at") + F.expr("INTERVAL '61' DAY"))
    before = store.mirror_table(spark, path)._now()[1]
    store.merge_mirror(moved, path)
    after = store.mirror_table(spark, path)._now()[1]
    assert all(after[p] == before[p] for p in before if p == "202401") and set(after) > set(before)
    read = store.read_merged_mirror(spark, path)
    assert read.count() == events.count()
    assert read.join(moved, ["project_id", "event_id"], "left_semi").where("received_at > '2024-03-01'").count() == 5
