"""Exact-day retention cohorts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import scoped, utc


def retention(
    events: DataFrame,
    cohort_start: date,
    cohort_end: date,
    entry_event: str,
    return_event: str,
    now: datetime,
    project: str | None = None,
) -> DataFrame:
    """Returned users per cohort day and day offset.

    A user joins a cohort on every day with the entry event. A return counts on
    the cohort day or any later day, without an upper bound. Days without
    returns are absent. Events become (user, day) before the join, so its input
    is bounded by days per user and not by events per user, and the pairs are
    distinct already: counting them needs no second distinct.
    """
    if not timedelta(0) < cohort_end - cohort_start <= timedelta(days=31) or not (
        (entry_event or "").strip() and (return_event or "").strip()
    ):
        raise ValueError("Use a 1–31 day UTC cohort range and event types.")

    def user_days(kind: str, end: date | None, name: str) -> DataFrame:
        first = datetime.combine(cohort_start, datetime.min.time())
        last = end and datetime.combine(end, datetime.min.time())
        return (
            scoped(events, project, first, last)
            .where((F.col("event_type") == kind) & F.col("user_id").isNotNull())
            .select("project_id", "user_id", F.to_date("occurred_at").alias(name))
            .distinct()
        )

    entries = user_days(entry_event, cohort_end, "cohort_date")
    returns = user_days(return_event, None, "return_date")
    sizes = entries.groupBy("project_id", "cohort_date").agg(F.count("*").alias("cohort_users"))
    returned = (
        entries.join(returns, ["project_id", "user_id"])
        .where(F.col("return_date") >= F.col("cohort_date"))
        .groupBy("project_id", "cohort_date", F.date_diff("return_date", "cohort_date").alias("day"))
        .agg(F.count("*").alias("returned_users"))
    )
    today = F.lit(utc(now).date())
    return (
        sizes.join(returned, ["project_id", "cohort_date"])
        .select(
            "project_id",
            "cohort_date",
            "day",
            "cohort_users",
            "returned_users",
            (F.date_add("cohort_date", F.col("day") + 1) <= today).alias("complete"),
        )
        .orderBy("project_id", "cohort_date", "day")
    )
