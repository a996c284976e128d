"""Atomic batch admission: idempotent, conflict-free, within quota.

A batch of a project is admitted or refused as a whole, in arrival order.
Repeats of a stored event with the same fingerprint are answered with the first
receipt; a different fingerprint is a conflict; new events count against the
project's limits. Ids of a refused batch are never seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import skew
from tidemark.session import materialize, scratch_path

EVENT = ["project_id", "event_id"]
BATCH = ["project_id", "batch_at", "batch_id"]


@dataclass(frozen=True)
class Limits:
    """Storage limits; None means no limit of that kind.

    The project limits count stored events and logical bytes of each project, the
    others the open outbox rows and logical bytes of the whole deployment.
    """

    max_project_events: int | None = 100_000
    max_project_bytes: int | None = 100 * 1024 * 1024
    max_outbox_pending: int | None = None
    max_total_bytes: int | None = None

    @property
    def per_project(self) -> bool:
        return self.max_project_events is not None or self.max_project_bytes is not None

    @property
    def overall(self) -> bool:
        return self.max_outbox_pending is not None or self.max_total_bytes is not None


NO_LIMITS = Limits(None, None)


@dataclass(frozen=True)
class Admission:
    """``decisions``: one row per batch. ``receipts``: one row per event of an admitted batch,
    in request order. ``identity``: newly stored events."""

    decisions: DataFrame
    receipts: DataFrame
    identity: DataFrame


def first_arrivals(deliveries: DataFrame, arrival: Sequence[str], rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Mark each delivery as first, repeat or conflict of its event.

    The first arrival is a map-side combined minimum; a hot id's copies are
    divided when they look it up.
    """
    order = F.struct(*arrival)
    first = deliveries.groupBy(*EVENT).agg(
        F.min(F.struct(*arrival, "payload_hash")).alias("__first"),
    )
    looked = skew.lookup(deliveries, first, EVENT, list(arrival), skew.hot_keys(deliveries, EVENT, rows_per_task))
    same = F.col("payload_hash") == F.col("__first.payload_hash")
    is_first = order == F.struct(*[F.col(f"__first.{c}").alias(c) for c in arrival])
    return looked.select(
        *deliveries.columns,
        F.col(f"__first.{arrival[0]}").alias("first_received_at"),
        F.when(is_first, F.lit("first")).when(same, F.lit("repeat")).otherwise(F.lit("conflict")).alias("arrival"),
    )


def batch_conflicts(rows: DataFrame) -> DataFrame:
    """Events that occur in one batch with more than one fingerprint."""
    return (
        rows.groupBy(*BATCH, "event_id")
        .agg(F.min("payload_hash").alias("__low"), F.max("payload_hash").alias("__high"), F.count("*").alias("copies"))
        .where("__low <> __high")
        .drop("__low", "__high")
    )


def stored_state(rows: DataFrame, identity: DataFrame, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Compare deliveries with the identity table: ``new``, ``repeat`` or ``conflict``."""
    known = identity.select(
        *EVENT, F.col("payload_hash").alias("__hash"), F.col("received_at").alias("stored_received_at")
    )
    looked = skew.lookup(rows, known, EVENT, [*BATCH, "ordinal"], skew.hot_keys(rows, EVENT, rows_per_task))
    state = (
        F.when(F.col("__hash").isNull(), F.lit("new"))
        .when(F.col("__hash") == F.col("payload_hash"), F.lit("repeat"))
        .otherwise(F.lit("conflict"))
    )
    return looked.withColumn("state", state).drop("__hash")


def admit(
    rows: DataFrame,
    identity: DataFrame,
    usage: DataFrame | None = None,
    limits: Limits = Limits(),
    mode: str = "staged",
    outbox_pending: int = 0,
    total_bytes: int = 0,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> Admission:
    """Decide all batches exactly as if they had arrived one after another.

    ``rows`` follows ``schemas.BATCH_EVENTS``; an optional ``reject_reason`` column
    refuses the batch of any row where it is set. ``usage`` holds ``project_id,
    event_count, stored_bytes`` before the first batch; ``outbox_pending`` and
    ``total_bytes`` are the deployment's figures then. A batch holds at most a few
    hundred events; the wire decoder refuses larger ones.

    Whether a batch fits depends on the batches before it, so the decision is
    iterated over all projects at once. Each round settles every batch whose
    outcome no undecided batch can change:

    * a batch whose certain-new events exceed what is left is refused, because
      what is left only shrinks; only those before its first conflict or doubtful event count;
    * a fingerprint that differs from a stored one refuses the batch, once even the largest
      possible use leaves room for the new events before it;
    * a batch is admitted when even the largest possible use by all undecided
      batches up to it fits, and none of its events waits for an earlier
      undecided batch.

    The first undecided batch always meets one of these, so the rounds end. Usual data needs a few: one per link in chains of refused repeats.
    """
    spark = rows.sparkSession
    has_reason = "reject_reason" in rows.columns
    reason = F.col("reject_reason") if has_reason else F.lit(None).cast("string")
    rows = rows.select(*BATCH, "ordinal", "event_id", "payload_hash", "stored_bytes", "occurred_at", reason.alias("__bad"))

    per_event = rows.groupBy(*BATCH, "event_id").agg(
        F.min("payload_hash").alias("payload_hash"),
        F.max("payload_hash").alias("__high"),
        F.min("stored_bytes").alias("stored_bytes"),
        F.min("occurred_at").alias("occurred_at"),
        F.min("ordinal").alias("ordinal"),
        F.max("__bad").alias("__bad"),
    )
    faults = per_event.groupBy(*BATCH).agg(
        F.max("__bad").alias("__bad"),
        F.bool_or(F.col("payload_hash") != F.col("__high")).alias("__clash"),
    )
    early = faults.select(
        *BATCH,
        F.coalesce(F.col("__bad"), F.when(F.col("__clash"), F.lit("conflict"))).alias("reason"),
    )
    pending = materialize(per_event.drop("__high").join(early, BATCH), "pending")
    refused = pending.where(F.col("reason").isNotNull()).select(*BATCH, F.lit(False).alias("accepted"), "reason").distinct()
    pending = pending.where(F.col("reason").isNull()).drop("__bad", "reason")
    # The heaviest ids of the whole input stay the reference for every round.
    hot = skew.found_hot(pending, EVENT, rows_per_task)
    # Only the identities these batches mention: with few batches the large table is scanned, not shuffled.
    known_before = materialize(
        identity.select(*EVENT, "payload_hash", "received_at").join(pending.select(*EVENT).distinct(), EVENT, "left_semi"),
        "known",
    )

    paths: list[str] = []
    round_schema = _add(pending.schema, "fresh BOOLEAN, verdict STRING")

    def rounds() -> DataFrame:
        if not paths:
            return spark.createDataFrame([], round_schema)
        return spark.read.schema(round_schema).parquet(*paths)

    def stored() -> DataFrame:
        return rounds().where("verdict = 'accept' AND fresh")

    while True:
        path = scratch_path(spark, "round")
        base = (outbox_pending, total_bytes)
        _settle(pending, known_before, stored(), usage, base, limits, hot).write.parquet(path)
        paths.append(path)
        pending = spark.read.schema(round_schema).parquet(path).where("verdict = 'wait'").drop("fresh", "verdict")
        if pending.isEmpty():
            break

    settled = (
        rounds()
        .where("verdict <> 'wait'")
        .select(
            *BATCH,
            (F.col("verdict") == "accept").alias("accepted"),
            F.when(F.col("verdict") != "accept", F.col("verdict")).alias("reason"),
        )
        .distinct()
        .unionByName(refused)
    )
    new_identity = stored().select(
        *EVENT, "payload_hash", "occurred_at", F.col("batch_at").alias("received_at"), "stored_bytes", "batch_id", "ordinal"
    )
    sources = known_before.select(
        *EVENT, "received_at", F.lit(None).cast("string").alias("first_batch"), F.lit(None).cast("int").alias("first_ordinal")
    ).unionByName(
        new_identity.select(
            *EVENT, "received_at", F.col("batch_id").alias("first_batch"), F.col("ordinal").alias("first_ordinal")
        )
    )
    admitted = rows.join(settled.where("accepted").select(*BATCH), BATCH, "left_semi")
    receipts = (
        skew.lookup(admitted, sources, EVENT, [*BATCH, "ordinal"], hot=hot)
        .select(
            *BATCH,
            "ordinal",
            "event_id",
            F.lit("persisted" if mode == "direct" else "accepted").alias("status"),
            "received_at",
            F.lit("durable").alias("durability"),
            (
                ~(F.col("first_batch").eqNullSafe(F.col("batch_id")) & F.col("first_ordinal").eqNullSafe(F.col("ordinal")))
            ).alias("already_accepted"),
        )
        .repartition(*BATCH)
        .sortWithinPartitions(*BATCH, "ordinal")
    )
    return Admission(settled, receipts, new_identity.drop("batch_id", "ordinal"))


def _add(schema: StructType, ddl: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def _settle(
    pending: DataFrame,
    known_before: DataFrame,
    stored: DataFrame,
    usage: DataFrame | None,
    base: tuple[int, int],
    limits: Limits,
    hot: DataFrame | None,
) -> DataFrame:
    """One round: pending batch events with ``fresh`` and the batch's ``verdict``."""
    known = known_before.select(*EVENT, F.col("payload_hash").alias("__hash")).unionByName(
        stored.select(*EVENT, F.col("payload_hash").alias("__hash"))
    )
    spread = ["batch_at", "batch_id"]
    looked = skew.lookup(pending, known, EVENT, spread, hot=hot)
    unknown = F.col("__hash").isNull()
    firsts = (
        looked.where(unknown)
        .groupBy(*EVENT)
        .agg(F.min(F.struct("batch_at", "batch_id")).alias("__first"))
    )
    by_ordinal = Window.partitionBy(*BATCH)  # a batch holds at most a few hundred events
    marked = skew.lookup(looked, firsts, EVENT, spread, hot=hot).select(
        *pending.columns,
        (unknown & (F.col("__first") == F.struct("batch_at", "batch_id"))).alias("fresh"),
        unknown.alias("unknown"),
        (~unknown & (F.col("__hash") != F.col("payload_hash"))).alias("clash"),
    )
    marked = materialize(marked.withColumn("fresh", F.coalesce("fresh", F.lit(False))), "marked")
    clash_at = F.min(F.when(F.col("clash"), F.col("ordinal"))).over(by_ordinal)
    doubt_at = F.min(F.when(F.col("clash") | (F.col("unknown") & ~F.col("fresh")), F.col("ordinal"))).over(by_ordinal)
    placed = marked.withColumns({"__clash_at": clash_at, "__doubt_at": doubt_at})
    sure = F.col("fresh") & (F.col("__doubt_at").isNull() | (F.col("ordinal") < F.col("__doubt_at")))
    ahead = F.col("unknown") & (F.col("ordinal") < F.col("__clash_at"))
    batches = placed.groupBy(*BATCH).agg(
        F.count_if(sure).alias("sure_n"),
        F.coalesce(F.sum(F.when(sure, F.col("stored_bytes"))), F.lit(0)).alias("sure_b"),
        F.count_if(ahead).alias("ahead_n"),
        F.coalesce(F.sum(F.when(ahead, F.col("stored_bytes"))), F.lit(0)).alias("ahead_b"),
        F.bool_or("clash").alias("clash"),
        F.bool_or(F.col("unknown") & ~F.col("fresh")).alias("echo"),
        F.count_if("fresh").alias("new_n"),
        F.coalesce(F.sum(F.when(F.col("fresh"), F.col("stored_bytes"))), F.lit(0)).alias("new_b"),
        F.count_if("unknown").alias("most_n"),
        F.coalesce(F.sum(F.when(F.col("unknown"), F.col("stored_bytes"))), F.lit(0)).alias("most_b"),
    )
    # A refused batch uses nothing. A batch without new events is free even when limits are exceeded already.
    judged = batches.withColumns(
        {c: F.when(F.col("clash"), F.lit(0)).otherwise(F.col(c)) for c in ("most_n", "most_b")}
    )
    # Events are looked at in request order, and the first fault answers. New events before a conflict may exceed the
    # project's limits first; a repeat of an undecided batch's event is in doubt, because it may turn out a conflict.
    too_big, safe, calm, overall = F.lit(False), F.lit(True), F.lit(True), F.lit(False)
    if limits.per_project:
        judged = skew.running_totals(judged, ["project_id"], ["batch_at", "batch_id"], ["most_n", "most_b"])
        used = stored.groupBy("project_id").agg(F.count("*").alias("__n"), F.sum("stored_bytes").alias("__b"))
        judged = judged.join(used, "project_id", "left")
        if usage is not None:
            before = usage.select("project_id", F.col("event_count").alias("__n0"), F.col("stored_bytes").alias("__b0"))
            judged = judged.join(before, "project_id", "left")
        else:
            judged = judged.withColumns({"__n0": F.lit(0), "__b0": F.lit(0)})
        used_n = F.coalesce("__n", F.lit(0)) + F.coalesce("__n0", F.lit(0))
        used_b = F.coalesce("__b", F.lit(0)) + F.coalesce("__b0", F.lit(0))
        judged = judged.withColumns(
            {
                "__big": _exceeds("sure_n", used_n, limits.max_project_events)
                | _exceeds("sure_b", used_b, limits.max_project_bytes),
                "__calm": ~_exceeds("ahead_n", used_n + F.col("cum_most_n"), limits.max_project_events)
                & ~_exceeds("ahead_b", used_b + F.col("cum_most_b"), limits.max_project_bytes),
                "__safe": ~_exceeds("cum_most_n", used_n, limits.max_project_events)
                & ~_exceeds("cum_most_b", used_b, limits.max_project_bytes),
            }
        ).drop("cum_most_n", "cum_most_b")
        too_big, safe, calm = F.col("__big"), F.col("__safe"), F.col("__calm")
    if limits.overall:
        judged = skew.running_totals(judged, [], ["batch_at", "batch_id", "project_id"], ["most_n", "most_b"])
        taken = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("b")).first()
        used_n, used_b = F.lit(base[0] + taken.n), F.lit(base[1] + taken.b)
        overall = _exceeds("new_n", used_n, limits.max_outbox_pending) | _exceeds("new_b", used_b, limits.max_total_bytes)
        safe = (
            safe
            & ~_exceeds("cum_most_n", used_n, limits.max_outbox_pending)
            & ~_exceeds("cum_most_b", used_b, limits.max_total_bytes)
        )
    judged = judged.withColumn(
        "verdict",
        F.when((F.col("sure_n") > 0) & too_big, F.lit("quota"))
        .when(F.col("clash") & (calm | (F.col("ahead_n") == 0)), F.lit("conflict"))
        .when(F.col("clash"), F.lit("wait"))
        .when((F.col("new_n") > 0) & overall & ~F.col("echo"), F.lit("quota"))
        .when((safe | (F.col("most_n") == 0)) & ~F.col("echo"), F.lit("accept"))
        .otherwise(F.lit("wait")),
    )
    return marked.join(judged.select(*BATCH, "verdict"), BATCH).select(*pending.columns, "fresh", "verdict")


def _exceeds(amount: str, used: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else F.col(amount) + used > F.lit(limit)


def counters(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Accepted and rejected events per project and reason."""
    sizes = rows.groupBy(*BATCH).agg(F.count("*").alias("__events"))
    return (
        sizes.join(decisions, BATCH)
        .groupBy("project_id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))
        .agg(F.sum("__events").alias("events"))
        .orderBy("project_id", "outcome")
    )
