"""Event counts, time series, active users, sessions and revenue.

Each report takes the event table and returns a DataFrame with ``project_id``.
Counting is map-side combined, so one hot project or event type does not
concentrate rows in a task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal
from tidemark.functions.once import compute_once
from tidemark.operators.filters import EventFilter, at, scoped
from tidemark.operators.status import processing_status


def event_summary(events: DataFrame, filter: EventFilter = EventFilter()) -> DataFrame:
    """Events per type, most frequent first, ties in byte order."""
    return (
        filter.apply(events)
        .groupBy("project_id", "event_type")
        .agg(F.count("*").alias("events"))
        .orderBy("project_id", F.desc("events"), "event_type")
    )


def event_share(summary: DataFrame) -> DataFrame:
    """Each type's share of its project's events in whole percent (half up)."""
    whole = Window.partitionBy("project_id")
    total = F.greatest(F.sum("events").over(whole), F.lit(1))
    return summary.select(
        "project_id",
        "event_type",
        "events",
        F.floor(F.col("events") * 100 / total + 0.5).cast("bigint").alias("percent"),
    )


def time_series(events: DataFrame, filter: EventFilter, interval: str) -> DataFrame:
    """Counts per UTC bucket and type; empty buckets are absent."""
    return (
        filter.apply(events)
        .groupBy("project_id", temporal.bucket(F.col("occurred_at"), interval).alias("bucket"), "event_type")
        .agg(F.count("*").alias("events"))
        .orderBy("project_id", "bucket", "event_type")
    )


def dense_series(series: DataFrame, start: datetime, end: datetime, interval: str, projects: DataFrame | None = None) -> DataFrame:
    """Total per bucket over [start, end) with zeros where a project had no events.

    ``projects`` (ids in ``project_id``) adds the projects without any event in the window.
    """
    step = f"INTERVAL 1 {interval.upper()}"
    totals = series.groupBy("project_id", "bucket").agg(F.sum("events").alias("events"))
    last = F.timestamp_add("MICROSECOND", F.lit(-1), at(end))
    named = totals if projects is None else projects
    axis = named.select("project_id").distinct().select(
        "project_id", F.explode(F.sequence(at(start), last, F.expr(step))).alias("bucket")
    )
    return (
        axis.join(totals, ["project_id", "bucket"], "left")
        .select("project_id", "bucket", F.coalesce("events", F.lit(0)).alias("events"))
        .orderBy("project_id", "bucket")
    )


def active_users(events: DataFrame, filter: EventFilter = EventFilter(), approximate: bool = False) -> DataFrame:
    """Distinct identified users, and distinct anonymous ids on rows without a user."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        filter.apply(events)
        .groupBy("project_id")
        .agg(
            count(F.col("user_id")).alias("identified_users"),
            count(F.when(F.col("user_id").isNull(), F.col("anonymous_id"))).alias("anonymous_users"),
        )
    )


def sessions(events: DataFrame, start: datetime, end: datetime, project: str | None = None) -> DataFrame:
    """Explicit sessions clipped to the window, by start."""
    return (
        scoped(events, project, start, end)
        .where(F.col("session_id").isNotNull())
        .groupBy("project_id", "session_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("occurred_at").alias("started_at"),
            F.max("occurred_at").alias("ended_at"),
            F.count("*").alias("events"),
        )
        .orderBy("project_id", "started_at", "session_id")
    )


def revenue(events: DataFrame, start: datetime, end: datetime, project: str | None = None) -> DataFrame:
    """Gross, refunds and net per currency over purchases and refunds with an integer amount."""
    money = F.from_json("properties", "currency STRING, amountMinor STRING")
    amount = F.col("__money.amountMinor")
    sales = scoped(events, project, start, end).where(F.col("event_type").isin("purchase", "refund"))
    rows = (
        compute_once(sales.select("project_id", "event_type", "properties"), __money=money)
        .select(
            "project_id",
            "event_type",
            F.col("__money.currency").alias("currency"),
            F.when(amount.rlike(jsondoc.INTEGER_TEXT), amount).cast("bigint").alias("amount"),
        )
        .where(F.col("currency").isNotNull() & F.col("amount").isNotNull())
    )
    is_purchase, is_refund = F.col("event_type") == "purchase", F.col("event_type") == "refund"

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("amount").cast("decimal(38,0)"))), F.lit(0)).cast("bigint")

    return (
        rows.groupBy("project_id", "currency")
        .agg(
            total(is_purchase).alias("gross_minor"),
            total(is_refund).alias("refund_minor"),
            F.count_if(is_purchase).alias("purchases"),
            F.count_if(is_refund).alias("refunds"),
        )
        .select(
            "project_id",
            "currency",
            "gross_minor",
            "refund_minor",
            (F.col("gross_minor") - F.col("refund_minor")).alias("net_minor"),
            "purchases",
            "refunds",
        )
        .orderBy("project_id", "currency")
    )


def overview(events: DataFrame, inbox: DataFrame, identity: DataFrame, filter: EventFilter, now: datetime) -> dict[str, DataFrame]:
    """Summary, series, active users and processing status of one scope.

    The summary is folded from the series, so the counts share one scan and one shuffle.
    """
    filter.check(window_required=True)
    series = time_series(events, filter, filter.interval())
    summary = (
        series.groupBy("project_id", "event_type")
        .agg(F.sum("events").alias("events"))
        .orderBy("project_id", F.desc("events"), "event_type")
    )
    return {
        "summary": summary,
        "series": series,
        "users": active_users(events, filter),
        "status": processing_status(inbox, identity, now, filter.project),
    }
