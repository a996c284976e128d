"""Batch admission against fixtures and a sequential model."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import admission

BASE = datetime(2026, 9, 10)


def batch_rows(spark, batches):
    """batches: (project, batch_id, second, [(event, hash, bytes)])"""
    rows = [
        (p, b, BASE + timedelta(seconds=s), i, e, h, n, BASE)
        for p, b, s, events in batches
        for i, (e, h, n) in enumerate(events)
    ]
    return spark.createDataFrame(rows, schemas.BATCH_EVENTS)


def identities(spark, rows):
    return spark.createDataFrame([(p, e, h, BASE, BASE, n) for p, e, h, n in rows], schemas.IDENTITY)


def sequential(batches, known, max_events, max_bytes, max_outbox=10**9):
    """The meaning of admission, one batch after another."""
    stored, decisions, receipts = {(p, e): (h, n, None) for p, e, h, n in known}, {}, []
    used, outbox = {}, 0
    for p, e, h, n in known:
        c, b = used.get(p, (0, 0))
        used[p] = (c + 1, b + n)
    for p, b, s, events in sorted(batches, key=lambda x: (x[2], x[1])):
        hashes = {}
        for e, h, _ in events:
            hashes.setdefault(e, set()).add(h)
        count, size = used.get(p, (0, 0))
        fresh, new_size, fault = {}, size, "conflict" if any(len(v) > 1 for v in hashes.values()) else None
        for e, h, n in events:  # the first fault in request order answers
            if fault or e in fresh:
                continue
            if (p, e) in stored:
                fault = "conflict" if stored[p, e][0] != h else None
            else:
                fresh[e] = (h, n)
                new_size += n
                fault = "quota" if count + len(fresh) > max_events or new_size > max_bytes else None
        if not fault and fresh and outbox + len(fresh) > max_outbox:
            fault = "quota"
        if fault:
            decisions[p, b] = fault
            continue
        decisions[p, b] = None
        used[p] = (count + len(fresh), new_size)
        outbox += len(fresh)
        done = set()
        for i, (e, h, n) in enumerate(events):
            receipts.append((p, b, i, e, (p, e) in stored or e in done))
            done.add(e)
        for e, (h, n) in fresh.items():
            stored[p, e] = (h, n, b)
    return decisions, sorted(receipts)


def run(spark, batches, known, max_events, max_bytes, max_outbox=None, **options):
    usage = identities(spark, known).groupBy("project_id").agg(
        F.count("*").alias("event_count"), F.sum("stored_bytes").alias("stored_bytes")
    )
    result = admission.admit(
        batch_rows(spark, batches), identities(spark, known), usage, admission.Limits(max_events, max_bytes, max_outbox), **options
    )
    decisions = {(r.project_id, r.batch_id): r.reason for r in result.decisions.collect()}
    receipts = sorted((r.project_id, r.batch_id, r.ordinal, r.event_id, r.already_accepted) for r in result.receipts.collect())
    return decisions, receipts, result


def test_repeats_in_batch(spark):
    batches = [("a", "b1", 1, [("old", "h", 1), ("x", "h", 1), ("x", "h", 1)])]
    decisions, receipts, result = run(spark, batches, [("a", "old", "h", 1)], 100, 10**6)
    assert decisions == {("a", "b1"): None}
    assert [r[4] for r in receipts] == [True, False, True]
    assert [r.event_id for r in result.identity.collect()] == ["x"]


def test_identical_deliveries_share_one_receipt(spark):
    batches = [("a", f"b{i:02}", i, [("e", "h", 1)]) for i in range(12)]
    decisions, receipts, result = run(spark, batches, [], 100, 10**6)
    assert set(decisions.values()) == {None} and [r[4] for r in receipts] == [False] + [True] * 11
    assert len({r.received_at for r in result.receipts.collect()}) == 1
    assert result.identity.count() == 1


def test_conflict_refuses_whole_batch(spark):
    batches = [("a", "b1", 1, [("e", "h", 1)]), ("a", "b2", 2, [("n", "h", 1), ("e", "other", 1)]), ("a", "b3", 3, [("n", "h2", 1)])]
    decisions, _, result = run(spark, batches, [], 100, 10**6)
    assert decisions == {("a", "b1"): None, ("a", "b2"): "conflict", ("a", "b3"): None}
    assert {r.event_id: r.payload_hash for r in result.identity.collect()} == {"e": "h", "n": "h2"}


def test_quota_after_sweep(spark):
    known = [("a", "pending", "h", 1), ("a", "identityOnly", "h", 1)]
    batches = [
        ("a", "b1", 1, [("n1", "h", 1), ("n2", "h", 1)]),
        ("a", "b2", 2, [("n3", "h", 1)]),
        ("a", "b3", 3, [("pending", "h", 1)]),
    ]
    decisions, receipts, _ = run(spark, batches, known, 3, 10**6)
    assert decisions == {("a", "b1"): "quota", ("a", "b2"): None, ("a", "b3"): None}
    assert receipts[-1] == ("a", "b3", 0, "pending", True)


def test_invalid_rows_refuse_their_batch(spark):
    rows = batch_rows(spark, [("a", "b1", 1, [("x", "h", 1), ("y", "h", 1)]), ("a", "b2", 2, [("x", "h", 1)])])
    rows = rows.withColumn("reject_reason", F.when(F.col("event_id") == "y", F.lit("validation")))
    result = admission.admit(rows, identities(spark, []))
    assert {r.batch_id: r.reason for r in result.decisions.collect()} == {"b1": "validation", "b2": None}
    assert [r.already_accepted for r in result.receipts.collect()] == [False]


def test_first_fault_in_request_order_answers(spark):
    known = [("a", "old", "h", 1)]
    batches = [
        ("a", "b1", 1, [("n1", "h", 1), ("n2", "h", 1), ("old", "other", 1)]),
        ("a", "b2", 2, [("n1", "h", 1), ("old", "other", 1), ("n2", "h", 1)]),
        ("a", "b3", 3, [("n1", "h", 1)]),
        ("a", "b4", 4, [("n1", "other", 1), ("n2", "h", 1)]),
        ("a", "b5", 5, [("n2", "h", 1), ("n1", "other", 1)]),
    ]
    decisions, _, _ = run(spark, batches, known, 2, 10**6)
    assert list(decisions[x] for x in sorted(decisions)) == ["quota", "conflict", None, "conflict", "quota"]


def test_outbox_room(spark):
    batches = [("a", "b1", 1, [("x", "h", 1)]), ("b", "b2", 2, [("y", "h", 1)]), ("a", "b3", 3, [("z", "h", 1)]), ("b", "b4", 4, [("y", "h", 1)])]
    decisions, _, _ = run(spark, batches, [], None, None, 2)
    assert list(decisions.values()).count("quota") == 1 and decisions["a", "b3"] == "quota"


@pytest.mark.parametrize("seed,hot,max_outbox", [(1, False, None), (3, True, 44), (5, False, 40)])
def test_same_as_one_after_another(spark, seed, hot, max_outbox):
    rng = random.Random(seed)
    batches = []
    for i in range(50):
        events = []
        for _ in range(rng.randint(1, 6)):
            e = "hot" if hot and rng.random() < 0.35 else f"e{rng.randint(0, 45)}"
            h = "h" if rng.random() < 0.96 else "changed"
            events.append((e, h, rng.choice([1, 1, 2, 7])))
        batches.append((rng.choice("ab"), f"b{i:03}", rng.randint(0, 40), events))
    # One size per event and fingerprint, as canonical text has.
    batches = [(p, b, s, [(e, h, sum(map(ord, e + h)) % 9 + 1) for e, h, _ in ev]) for p, b, s, ev in batches]
    known = [("a", f"e{i}", "h", 3) for i in range(5)]
    decisions, receipts, _ = run(spark, batches, known, 30, 130, max_outbox, rows_per_task=20 if hot else 1_000_000)
    assert (decisions, receipts) == sequential(batches, known, 30, 130, max_outbox or 10**9)
    assert {"quota", "conflict", None} <= set(decisions.values())


def test_first_arrivals_with_hot_id(spark):
    batches = [("a", f"b{i:03}", i, [("hot", "h" if i != 5 else "x", 1), (f"e{i}", "h", 1)]) for i in range(60)]
    found = admission.first_arrivals(batch_rows(spark, batches), ["batch_at", "batch_id", "ordinal"], rows_per_task=10).collect()
    assert len(found) == 120
    hot = [r for r in found if r.event_id == "hot"]
    assert sorted(r.arrival for r in hot) == ["conflict", "first"] + ["repeat"] * 58
    assert {r.first_received_at for r in hot} == {BASE}
