"""Analytical mirror: pending work, latest versions, backfill and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import temporal
from tidemark.operators.filters import at

EVENT = ["project_id", "event_id"]


def mirror_rows(events: DataFrame) -> DataFrame:
    """Event rows in mirror form: receipt time is the version, month is the folder."""
    return events.withColumn("version", F.col("received_at")).withColumn(
        "yyyymm", temporal.month_key(F.col("occurred_at"))
    )


def mirror_json(events: DataFrame) -> DataFrame:
    """One JSON line per event as the mirror ingests it."""
    stamp = [temporal.mirror_text(F.col(c)).alias(c) for c in ("occurred_at", "received_at")]
    return events.select(
        temporal.month_key(F.col("occurred_at")).alias("yyyymm"),
        F.to_json(
            F.struct(
                "project_id",
                "event_id",
                "event_type",
                "schema_version",
                "user_id",
                "anonymous_id",
                "session_id",
                *stamp,
                "properties",
                temporal.mirror_text(F.col("received_at")).alias("version"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )


def latest(mirror: DataFrame) -> DataFrame:
    """One row per event, the highest version. Copies combine map-side, so a hot id stays cheap."""
    rest = [c for c in mirror.columns if c not in EVENT]
    newest = F.max(F.struct("version", *[c for c in rest if c != "version"])).alias("__row")
    return mirror.groupBy(*EVENT).agg(newest).select(*EVENT, *[F.col(f"__row.{c}").alias(c) for c in rest])


def pending(queue: DataFrame, events: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Queued events not yet delivered; a bounded claim takes the oldest entries."""
    work = queue.where(F.col("completed_at").isNull()).select(*EVENT, "created_at")
    rows = work.join(events, EVENT)
    if batch_size is not None:
        rows = rows.orderBy("created_at", *EVENT).limit(batch_size)
    return rows.drop("created_at")


def enqueue(inbox: DataFrame) -> DataFrame:
    """Mirror work for newly accepted events."""
    return inbox.select(*EVENT, F.col("received_at").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))


def mark_delivered(queue: DataFrame, delivered: DataFrame, now: datetime) -> DataFrame:
    hit = delivered.select(*EVENT, F.lit(True).alias("__hit")).distinct()
    return queue.join(hit, EVENT, "left").select(
        *EVENT,
        "created_at",
        F.when(F.col("__hit"), at(now)).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def backfill(queue: DataFrame, events: DataFrame, start: datetime, end: datetime, now: datetime) -> DataFrame:
    """New queue entries for the closed range [start, end]; what is queued already stays as it is."""
    wanted = events.where((F.col("occurred_at") >= at(start)) & (F.col("occurred_at") <= at(end))).select(*EVENT)
    return wanted.join(queue.select(*EVENT), EVENT, "left_anti").select(
        *EVENT, at(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at")
    )


def counts_by_project(mirror: DataFrame) -> DataFrame:
    """Distinct mirrored events per project: version copies collapse, only keys are read."""
    return (
        mirror.select(*EVENT).distinct().groupBy("project_id").agg(F.count("*").alias("mirror_events"))
        .orderBy("project_id")
    )


def reconcile(events: DataFrame, mirror: DataFrame, by: Sequence[str] = ("project_id", "event_type", "day")) -> DataFrame:
    """Source and mirror counts per bucket with the difference; ``by`` may drop the type, the UTC day or both."""
    buckets = list(by)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return (
            rows.withColumn("day", F.to_date("occurred_at")).groupBy(*buckets).agg(F.count("*").alias(name))
        )

    newest = latest(mirror.select(*EVENT, "event_type", "occurred_at", "version"))
    joined = counted(events, "source_events").join(counted(newest, "mirror_events"), buckets, "full")
    source, copy = F.coalesce("source_events", F.lit(0)), F.coalesce("mirror_events", F.lit(0))
    return joined.select(
        *buckets,
        source.alias("source_events"),
        copy.alias("mirror_events"),
        (source - copy).alias("discrepancy"),
        (source == copy).alias("matches"),
    ).orderBy(*buckets)
