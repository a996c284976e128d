"""Processing, outbox and storage status; load summaries and counters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import temporal
from tidemark.operators.filters import at, utc
from tidemark.operators.skew import percentiles

MAX_SERIES = 1000  # fixed value: distinct counter keys kept apart
OVERFLOW_KEY = "_other"


def processing_status(inbox: DataFrame, identity: DataFrame, now: datetime, project: str | None = None) -> DataFrame:
    """Pending work, age of the oldest, p95 processing time of the last five minutes, newest receipt."""
    if project is not None:
        inbox = inbox.where(F.col("project_id") == project)
        identity = identity.where(F.col("project_id") == project)
    open_row = F.col("processed_at").isNull()
    backlog = inbox.groupBy("project_id").agg(
        F.count_if(open_row).alias("pending"), F.min(F.when(open_row, F.col("received_at"))).alias("oldest")
    )
    recent = inbox.where(F.col("processed_at") >= at(utc(now) - timedelta(minutes=5))).select(
        "project_id", (temporal.micros(F.col("processed_at")) - temporal.micros(F.col("received_at"))).alias("latency")
    )
    p95 = percentiles(recent, ["project_id"], "latency", {"p95": 0.95}, interpolate=True)
    newest = identity.groupBy("project_id").agg(F.max("received_at").alias("last_received_at"))
    return (
        backlog.join(newest, "project_id", "left")
        .join(p95, "project_id", "left")
        .select(
            "project_id",
            "pending",
            temporal.at_least_zero(temporal.seconds_between(at(now), F.col("oldest"))).alias("oldest_pending_seconds"),
            temporal.at_least_zero(F.col("p95") / 1e6).alias("processing_p95_seconds"),
            "last_received_at",
        )
        .orderBy("project_id")
    )


def outbox_is_pending():
    """Neither completed nor dead-lettered; published but unconfirmed rows count."""
    return F.col("completed_at").isNull() & F.col("dead_lettered_at").isNull()


def outbox_status(outbox: DataFrame, now: datetime, project: str | None = None) -> DataFrame:
    if project is not None:
        outbox = outbox.where(F.col("project_id") == project)
    pending = outbox_is_pending()
    return (
        outbox.groupBy("project_id")
        .agg(
            F.count_if(pending).alias("pending"),
            F.min(F.when(pending, F.col("created_at"))).alias("oldest"),
            F.count_if(F.col("completed_at").isNotNull()).alias("completed"),
            F.count_if(F.col("dead_lettered_at").isNotNull()).alias("dead_lettered"),
            F.count_if(pending & (F.col("attempts") > 0)).alias("retrying"),
        )
        .select(
            "project_id",
            "pending",
            temporal.seconds_between(at(now), F.col("oldest")).alias("oldest_pending_seconds"),
            "completed",
            "dead_lettered",
            "retrying",
        )
        .orderBy("project_id")
    )


def outbox_depth(outbox: DataFrame) -> DataFrame:
    """Open outbox rows of the whole deployment, the base of the outbox quota."""
    return outbox.agg(F.count_if(outbox_is_pending()).alias("pending"))


def storage_report(inbox: DataFrame, identity: DataFrame) -> DataFrame:
    """Pending events and logical bytes per project."""
    pending = inbox.groupBy("project_id").agg(F.count_if(F.col("processed_at").isNull()).alias("pending_events"))
    stored = identity.groupBy("project_id").agg(F.sum("stored_bytes").alias("logical_bytes"))
    return (
        pending.join(stored, "project_id", "full")
        .select(
            "project_id",
            F.coalesce("pending_events", F.lit(0)).alias("pending_events"),
            F.coalesce("logical_bytes", F.lit(0)).alias("logical_bytes"),
        )
        .orderBy("project_id")
    )


def inbox_claim(inbox: DataFrame, batch_size: int = 100) -> DataFrame:
    """The next batch of pending work, oldest receipt first (the batch size is the feature)."""
    if not 1 <= batch_size <= 1000:
        raise ValueError("A claim takes 1 to 1000 rows.")
    return (
        inbox.where(F.col("processed_at").isNull())
        .orderBy("received_at", "project_id", "event_id")
        .limit(batch_size)
        .select("project_id", "event_id", "payload", "received_at")
    )


def latency_percentiles(inbox: DataFrame) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of processing time per project, in milliseconds."""
    rows = inbox.select(
        "project_id", (temporal.micros(F.col("processed_at")) - temporal.micros(F.col("received_at"))).alias("latency")
    )
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = percentiles(rows, ["project_id"], "latency", wanted, interpolate=False)
    return found.select("project_id", *[(F.col(n) / 1000).alias(f"{n}_ms") for n in wanted]).orderBy("project_id")


def throughput(inbox: DataFrame) -> DataFrame:
    """Totals and rates over the receipt span of each project."""
    return (
        inbox.groupBy("project_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("processed_at").isNotNull()).alias("succeeded"),
            F.count_if(F.col("processed_at").isNull()).alias("open"),
            F.min("received_at").alias("__first"),
            F.max("received_at").alias("__last"),
        )
        .withColumn("elapsed_seconds", temporal.seconds_between(F.col("__last"), F.col("__first")))
        .select(
            "project_id",
            "total",
            "succeeded",
            "open",
            "elapsed_seconds",
            F.round(F.try_divide("total", "elapsed_seconds"), 6).alias("per_second"),
        )
        .orderBy("project_id")
    )


def bounded_counters(observations: DataFrame, key: str, amount: str, seen_at: str, max_series: int = MAX_SERIES) -> DataFrame:
    """Counts per key; keys first seen after the first ``max_series`` share one overflow row.

    The kept keys are at most ``max_series`` rows by definition, so broadcasting them is bounded.
    """
    per_key = observations.groupBy(key).agg(F.sum(amount).alias("total"), F.min(seen_at).alias("__seen"))
    kept = per_key.orderBy("__seen", key).limit(max_series).select(key, F.lit(True).alias("__kept"))
    return (
        per_key.join(F.broadcast(kept), key, "left")
        .groupBy(F.when(F.col("__kept"), F.col(key)).otherwise(F.lit(OVERFLOW_KEY)).alias(key))
        .agg(F.sum("total").cast("bigint").alias("total"))
        .orderBy(key)
    )


def projected_counts(batch: DataFrame) -> DataFrame:
    """What one micro-batch projected, by project."""
    return (
        batch.groupBy("project_id")
        .agg(F.count("*").alias("projected"), F.min("received_at").alias("oldest_receipt"))
        .orderBy("project_id")
    )


def dataset_fingerprint(events: DataFrame, identity: DataFrame, inbox: DataFrame) -> DataFrame:
    """Four totals that must survive a copy of the tables."""
    parts = [
        events.agg(F.count("*").alias("amount")).withColumn("measure", F.lit("events")),
        identity.agg(F.count("*").alias("amount")).withColumn("measure", F.lit("identities")),
        identity.agg(F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("amount")).withColumn("measure", F.lit("bytes")),
        inbox.agg(F.count("*").alias("amount")).withColumn("measure", F.lit("inbox")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("measure", "amount")


def compare_fingerprints(before: DataFrame, after: DataFrame) -> DataFrame:
    left = before.withColumnRenamed("amount", "before")
    right = after.withColumnRenamed("amount", "after")
    return left.join(right, "measure", "full").withColumn(
        "matches", F.col("before").eqNullSafe(F.col("after"))
    )
