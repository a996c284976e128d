"""Attempt budgets over fixed windows that open at the first attempt.

A window opens with the first attempt after the previous window has fully
passed; attempts inside it count against the limit. Finding the openings looks
sequential, because each depends on the one before. It is done here by pointer
doubling: every attempt time knows the first time a new window could open after
it, and following those links 1, 2, 4, ... steps at once marks all openings in a
logarithmic number of joins, with no key handled in one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import temporal, text
from tidemark.operators import skew
from tidemark.session import materialize

GLOBAL_LIMIT = 120  # fixed value: attempts per window for everybody together
BUCKET_LIMIT = 10  # fixed value: attempts per window and account bucket
WINDOW_SECONDS = 60
CHUNK_SLOTS = 10_000


def window_starts(points: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Opening times per key among distinct ``t`` (microseconds).

    Times are cut into slots one window wide. A slot of a key holds at most
    ``width`` distinct times and at most one opening, so the windows below are
    bounded by the resolution of time and not by the number of attempts.
    """
    points = materialize(
        points.select(*keys, "t").distinct().withColumn("slot", F.floor(F.col("t") / F.lit(width)).cast("bigint")), "points"
    )
    slots = materialize(_slots(points, keys), "slots")
    # Only the first time of a slot can follow a gap of a whole window: there a window opens for certain.
    roots = slots.where(F.col("before").isNull() | (F.col("low") - F.col("before") >= width)).select(
        *keys, F.col("low").alias("t")
    )
    # The first time at or after t + width lies in the next slot, or is the first time beyond it.
    seek = points.select(*keys, (F.col("slot") + 1).alias("slot"), (F.col("t") + width).alias("at"), F.col("t").alias("origin"))
    data = points.select(*keys, "slot", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("origin"))
    # Later times first: a frame that begins at the partition's start is kept up row by row.
    onward = (
        Window.partitionBy(*keys, "slot")
        .orderBy(F.col("at").desc(), F.col("origin").isNull().desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.last(F.when(F.col("origin").isNull(), F.col("at")), ignorenulls=True).over(onward)
    links = (
        seek.unionByName(data)
        .withColumn("in_slot", found)
        .where(F.col("origin").isNotNull())
        .select(*keys, (F.col("slot") - 1).alias("slot"), F.col("origin").alias("t"), "in_slot")
        .join(slots.select(*keys, "slot", "beyond"), [*keys, "slot"])
        .select(*keys, "t", F.coalesce("in_slot", "beyond").alias("next"))
        .where(F.col("next").isNotNull())
    )
    # A link to a certain opening adds nothing: that opening starts a chain of its own.
    links = links.join(roots.withColumnRenamed("t", "next"), [*keys, "next"], "left_anti")
    links = materialize(links.select(*keys, "t", "next"), "links")
    starts = materialize(roots, "starts")
    while True:
        reached = (
            starts.join(links, [*keys, "t"])
            .select(*keys, F.col("next").alias("t"))
            .distinct()
            .join(starts, [*keys, "t"], "left_anti")
        )
        reached = materialize(reached, "reached")
        if reached.isEmpty():
            return starts
        starts = materialize(starts.unionByName(reached), "starts")
        second = links.select(*keys, F.col("t").alias("next"), F.col("next").alias("__far"))
        links = materialize(links.join(second, [*keys, "next"]).select(*keys, "t", F.col("__far").alias("next")), "links")


def _slots(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per slot: first and last time, the last time before it, and the first time two or more slots on.

    A key may hold all slots there are. It is divided into chunks of slots, and a chunk
    knows its neighbours from a summary with one row per chunk.
    """
    slots = points.groupBy(*keys, "slot").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    slots = materialize(slots.withColumn("chunk", F.floor(F.col("slot") / F.lit(CHUNK_SLOTS)).cast("bigint")), "slots")
    head = F.struct("slot", "low")
    first = slots.groupBy(*keys, "chunk").agg(F.min(head).alias("one"), F.max(F.struct("slot", "high")).alias("last"))
    rest = slots.join(first.select(*keys, "chunk", F.col("one.slot").alias("begin")), [*keys, "chunk"]).where("slot > begin")
    second = rest.groupBy(*keys, "chunk").agg(F.min(head).alias("two"))
    by_chunk = Window.partitionBy(*keys).orderBy("chunk")
    around = first.join(second, [*keys, "chunk"], "left").select(
        *keys,
        "chunk",
        F.lag("last.high").over(by_chunk).alias("earlier"),
        F.array(F.lead("one").over(by_chunk), F.lead("two").over(by_chunk), F.lead("one", 2).over(by_chunk)).alias("later"),
    )
    within = Window.partitionBy(*keys, "chunk").orderBy("slot")
    ahead = F.concat(F.array(F.lead(head).over(within), F.lead(head, 2).over(within)), F.col("later"))
    far = F.filter(ahead, lambda x: x["slot"] >= F.col("slot") + 2)
    return slots.join(around, [*keys, "chunk"]).select(
        *keys,
        "slot",
        "low",
        "high",
        F.coalesce(F.lag("high").over(within), "earlier").alias("before"),
        F.array_min(F.transform(far, lambda x: x["low"])).alias("beyond"),
    )


def windowed(attempts: DataFrame, keys: Sequence[str], spread_by: Sequence[str], carried: DataFrame | None = None, width_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``window_start`` (microseconds) to attempts with a ``t`` column.

    ``carried`` holds windows still open from earlier input as ``keys, t``.
    """
    width = width_seconds * 1_000_000
    points = attempts.select(*keys, "t")
    if carried is not None:
        points = points.unionByName(carried.select(*keys, "t"))
    starts = window_starts(points, keys, width)
    slot = F.floor(F.col("t") / F.lit(width)).cast("bigint")
    near = starts.select(*keys, slot.alias("slot"), F.col("t").alias("own"), F.lit(None).cast("bigint").alias("previous"))
    far = starts.select(*keys, (slot + 1).alias("slot"), F.lit(None).cast("bigint").alias("own"), F.col("t").alias("previous"))
    around = near.unionByName(far).groupBy(*keys, "slot").agg(F.max("own").alias("own"), F.max("previous").alias("previous"))
    slotted = attempts.withColumn("slot", slot)
    place = [*keys, "slot"]
    placed = skew.lookup(slotted, around, place, spread_by, skew.found_hot(slotted, place))
    return placed.withColumn(
        "window_start", F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("previous"))
    ).drop("slot", "own", "previous")


def within_limit(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, used: Column | None = None) -> DataFrame:
    """The first attempts of each window up to the limit.

    Ranking with a bound keeps only ``limit`` rows per window and partition before
    the shuffle, so a crowded window stays small.
    """
    by_window = Window.partitionBy(*keys, "window_start").orderBy(*order)
    ranked = attempts.withColumn("__rank", F.row_number().over(by_window)).where(F.col("__rank") <= limit)
    if used is not None:
        ranked = ranked.where(F.col("__rank") + used <= limit)
    return ranked.drop("__rank")


def acquire(
    attempts: DataFrame,
    global_limit: int = GLOBAL_LIMIT,
    bucket_limit: int = BUCKET_LIMIT,
    width_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Decide ``attempt_id, username, attempted_at``: the global budget first, then the account bucket's.

    Attempts refused by the global budget never reach a bucket's counter.
    """
    timed = attempts.select(
        "attempt_id",
        text.account_bucket(F.col("username")).alias("bucket"),
        temporal.micros(F.col("attempted_at")).alias("t"),
        F.lit("global").alias("scope"),
    )
    order = ["t", "attempt_id"]
    overall = windowed(timed, ["scope"], order, width_seconds=width_seconds)
    passed = materialize(within_limit(overall, ["scope"], order, global_limit).drop("window_start"), "passed")
    per_bucket = windowed(passed, ["bucket"], order, width_seconds=width_seconds)
    allowed = within_limit(per_bucket, ["bucket"], order, bucket_limit).select(
        "attempt_id", F.lit(True).alias("__allowed")
    )
    return timed.join(allowed, "attempt_id", "left").select(
        "attempt_id",
        "bucket",
        temporal.from_micros(F.col("t")).alias("attempted_at"),
        F.coalesce("__allowed", F.lit(False)).alias("allowed"),
    )


def bucket_usage(decided: DataFrame) -> DataFrame:
    return (
        decided.groupBy("bucket")
        .agg(F.count("*").alias("attempts"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))
        .orderBy("bucket")
    )


def request_budget(requests: DataFrame, keys: Sequence[str], at: str, limit: int) -> DataFrame:
    """Aligned one-minute request counts against a budget."""
    minute = temporal.plus_micros(F.col(at), -F.pmod(temporal.micros(F.col(at)), F.lit(60_000_000)))
    return (
        requests.groupBy(*keys, minute.alias("minute"))
        .agg(F.count("*").alias("requests"))
        .withColumn("over", F.greatest(F.col("requests") - limit, F.lit(0)))
        .orderBy(*keys, "minute")
    )
