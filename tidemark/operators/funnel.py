"""Ordered conversion funnel.

Step 1 is a user's first event of that type in the window. Step k is the first
event of its type between the previous step and the previous step plus the
conversion window, both ends included. There is no backtracking, and only
timestamps decide, so one event may satisfy two equal steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import scoped, window_errors
from tidemark.operators.skew import found_hot, split_hot
from tidemark.session import materialize

USER = ["project_id", "user_id"]


def check_funnel(steps: Sequence[str], start: datetime, end: datetime, window: timedelta) -> None:
    hours = window / timedelta(hours=1)
    named = all(s and s.strip() and len(s) <= 100 for s in steps)
    if window_errors(start, end) or not (2 <= len(steps) <= 8 and named and 1 <= hours <= 24 * 31):
        raise ValueError(
            "A funnel covers 1 to 31 days and has 2 to 8 steps, reached within 1 to 744 hours."
        )


def reached_steps(rows: DataFrame, steps: Sequence[str], window: timedelta) -> DataFrame:
    """One row per user with ``t1..tn``: the time each step was reached, or NULL.

    Users never become arrays: each step joins that step's events to the users
    who reached the previous one and keeps a minimum, which combines map-side. A
    user with a large share of the rows is divided over tasks.
    """
    reached = rows.groupBy(*USER).agg(
        F.min(F.when(F.col("event_type") == steps[0], F.col("occurred_at"))).alias("t1")
    )
    later_rows = rows.where(F.col("event_type").isin(*steps[1:]))
    hot = found_hot(later_rows, USER)
    reached = reached.where("t1 IS NOT NULL")  # nobody else reaches a later step
    micros = window // timedelta(microseconds=1)
    for k, step in enumerate(steps[1:], start=2):
        later = rows.where(F.col("event_type") == step).select(*USER, F.col("occurred_at").alias("__at"))
        later, users, on = split_hot(later, reached, USER, ["__at"], hot=hot)
        previous = f"t{k - 1}"
        candidate = F.expr(f"__at >= {previous} AND __at <= timestampadd(MICROSECOND, {micros}, {previous})")
        same_user = [users[c].eqNullSafe(later[c]) if c == "__slice" else users[c] == later[c] for c in on]
        condition = candidate
        for part in same_user:
            condition = part & condition
        reached = (
            users.join(later, condition, "left")
            .groupBy(*[users[c] for c in USER])
            .agg(
                *[F.min(f"t{i}").alias(f"t{i}") for i in range(1, k)],
                F.min("__at").alias(f"t{k}"),
            )
        )
    return reached


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    start: datetime,
    end: datetime,
    window: timedelta,
    project: str | None = None,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Users per step, one row per step, steps nobody reached included.

    With ``projects`` (ids in ``project_id``) every project gets its steps, also one without any event.
    The filtered events are written once, so the event table is scanned once whatever the number of steps.
    """
    check_funnel(steps, start, end, window)
    rows = (
        scoped(events, project, start, end)
        .where(F.col("user_id").isNotNull() & F.col("event_type").isin(*dict.fromkeys(steps)))
        .select(*USER, "event_type", "occurred_at")
    )
    rows = materialize(rows, "funnel")
    counts = [F.count(f"t{k}").alias(f"n{k}") for k in range(1, len(steps) + 1)]
    reached = reached_steps(rows, steps, window)
    if project is None:
        totals = reached.groupBy("project_id").agg(*counts)
        silent = (rows if projects is None else projects).select("project_id").distinct()
        totals = silent.join(totals, "project_id", "left").na.fill(0)
    else:
        totals = reached.agg(*counts).withColumn("project_id", F.lit(project))
    result = F.array(
        *[
            F.struct(F.lit(k).alias("step"), F.lit(s).alias("event_type"), F.col(f"n{k}").alias("users"))
            for k, s in enumerate(steps, start=1)
        ]
    )
    return totals.select("project_id", F.inline(result)).orderBy("project_id", "step")
