"""Structured Streaming jobs.

Each job is a micro-batch query with a checkpoint; a repeated micro-batch leaves
the same result. ``trigger`` defaults to "process what is there and stop".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import schemas
from tidemark.functions import canonical, temporal, text
from tidemark.operators import admission, budgets, delivery, mirror, validation
from tidemark.operators.status import outbox_is_pending
from tidemark.session import materialize, scratch_space
from tidemark.sources import parts, store, wire

AVAILABLE_NOW = {"availableNow": True}
EVENT = ["project_id", "event_id"]


def run_steps(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], trigger: dict | None, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .foreachBatch(step)
        .start()
    )


def table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def inbox_events(inbox: DataFrame) -> DataFrame:
    """Inbox payloads (canonical JSON) as event rows."""
    wire_schema = (
        "eventId STRING, eventType STRING, schemaVersion INT, occurredAt STRING, userId STRING, "
        "anonymousId STRING, sessionId STRING"
    )
    body = F.from_json("payload", wire_schema)
    properties = F.try_variant_get(F.try_parse_json("payload"), "$.properties", "variant")
    return inbox.select(
        "project_id",
        "event_id",
        body.alias("__b"),
        F.to_json(properties).alias("properties"),
        "received_at",
    ).select(
        "project_id",
        "event_id",
        F.col("__b.eventType").alias("event_type"),
        F.col("__b.schemaVersion").alias("schema_version"),
        F.col("__b.userId").alias("user_id"),
        F.col("__b.anonymousId").alias("anonymous_id"),
        F.col("__b.sessionId").alias("session_id"),
        temporal.parse_instant(F.col("__b.occurredAt")).alias("occurred_at"),
        "received_at",
        "properties",
    )


def project_inbox(inbox_stream: DataFrame, events_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Accepted payloads to the event table, each event once."""
    gauges = inbox_stream.observe(
        "projection", F.count(F.lit(1)).alias("rows"), F.min("received_at").alias("oldest_receipt")
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        store.insert_absent(inbox_events(batch), events_path)

    return run_steps(gauges, checkpoint, step, trigger)


def deduplicate(
    deliveries: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, key_buckets: int = store.KEY_BUCKETS
) -> StreamingQuery:
    """Simple path: the first delivery of each event that arrives, no receipts.

    Nothing is lost however late it comes: the keys of all earlier micro-batches are kept in hash buckets beside the target
    (``<target>_keys``), and a micro-batch looks into the buckets of its own keys. It writes the folder of its own
    number and regards keys of lower numbers only; a repeated one leaves the same rows.
    """
    rest = [c for c in deliveries.columns if c not in EVENT]
    order = ["received_at", *[c for c in rest if c != "received_at"]]
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deliveries.schema if f.name in EVENT) + ", batch BIGINT"
    seen = store.key_table(deliveries.sparkSession, f"{target.rstrip('/')}_keys", keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*EVENT).agg(F.min(F.struct(*order)).alias("__row"))
        with scratch_space(spark, "dedup") as space:
            rows = materialize(first.select(*EVENT, *[F.col(f"__row.{c}").alias(c) for c in rest]), "first", space)
            known = materialize(store.matching(seen, rows, buckets=key_buckets), "known", space)
            earlier = known.where(F.col("batch") < batch_id).select(*EVENT)
            fresh = materialize(rows.join(earlier, EVENT, "left_anti").select(*deliveries.columns), "fresh", space)
            fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
            new = fresh.select(*EVENT).join(known.select(*EVENT), EVENT, "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
            seen.append(store.bucketed(new, key_buckets))

    return run_steps(deliveries, checkpoint, step, trigger)


def mirror_events(events_stream: DataFrame, mirror_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Event table to the mirror, at least once; reads keep the latest version."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store.append_mirror(batch, mirror_path)

    return run_steps(events_stream, checkpoint, step, trigger)


def merge_mirror(events_stream: DataFrame, mirror_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Event table to a mirror in months, of which a micro-batch writes only those it has events of; see ``store.read_merged_mirror``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store.merge_mirror(batch, mirror_path, checkpoint, batch_id)

    return run_steps(events_stream, checkpoint, step, trigger)


COUNTS = "project_id STRING, bucket TIMESTAMP_NTZ, event_type STRING, events BIGINT"


def _counts(spark: SparkSession, target: str) -> parts.Parts:
    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("project_id", "bucket", "event_type", parts.PART).agg(F.sum("events").alias("events"))

    return parts.Parts(spark, target, COUNTS, combine=added)


def event_counts(events_stream: DataFrame, target: str, checkpoint: str, interval: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Running counts per bucket and type: late events count in their own bucket, however late.

    No state is kept. Every micro-batch adds its own counts to the days they belong to, once; days merge their counts as they come together, so
    ``latest_counts`` reads few folders per day. A target belongs to one checkpoint.
    """

    table = _counts(events_stream.sparkSession, target)

    def step(batch: DataFrame, batch_id: int) -> None:
        at = F.to_timestamp(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        counted = (
            batch.withColumn("__at", at)
            .groupBy("project_id", F.window("__at", interval).alias("w"), "event_type")
            .agg(F.count("*").alias("events"))
            .select("project_id", temporal.from_micros(F.unix_micros("w.start")).alias("bucket"), "event_type", "events")
        )
        table.append(counted.withColumn(parts.PART, F.date_format("bucket", "yyyy-MM-dd")), checkpoint, batch_id)

    return run_steps(events_stream, checkpoint, step, trigger)


def latest_counts(spark: SparkSession, target: str, days: list[str] | None = None) -> DataFrame:
    """The counts so far, of some days (``yyyy-MM-dd``) or of all."""
    return _counts(spark, target).reduced(days).drop(parts.PART).orderBy("project_id", "bucket", "event_type")


USAGE, USAGE_BUCKETS = "project_id STRING, event_count BIGINT, stored_bytes BIGINT", 16


def _usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", parts.PART).agg(F.sum("event_count").alias("event_count"), F.sum("stored_bytes").alias("stored_bytes"))


def ingest(
    frames: DataFrame,
    root: str,
    checkpoint: str,
    limits: admission.Limits = admission.Limits(),
    window: validation.AdmissionWindow = validation.AdmissionWindow(),
    mode: str = "staged",
    trigger: dict | None = None,
    outbox_now: Callable[[SparkSession], DataFrame] | None = None,
    key_buckets: int = store.KEY_BUCKETS,
) -> StreamingQuery:
    """Batch envelopes (``project_id, batch_id, batch_at, value``) to stored events and answers.

    ``staged`` writes accepted payloads to the inbox, ``direct`` to the event table.
    Below ``root``: ``identity`` in hash buckets of the key, of which a micro-batch reads those of its own keys; ``usage``, one row per
    project; ``receipts``, ``decisions`` and ``rejects`` by
    micro-batch, and ``inbox``, ``outbox`` and ``mirror_queue`` (the broker's and the mirror's work)
    or ``events``. A repeated micro-batch overwrites its own folders and finds the
    identities of earlier ones only.

    ``key_buckets`` stays the same for a root; some 10 GB of identities to a bucket are a good size.

    The deployment's limits count what all earlier micro-batches stored. ``outbox_now`` gives the
    outbox as the publisher left it; without it everything enqueued here counts as open.
    """
    if mode not in ("staged", "direct"):
        raise ValueError("Use staged or direct.")
    identities = store.key_table(frames.sparkSession, f"{root}/identity", schemas.IDENTITY)
    totals = parts.Parts(frames.sparkSession, f"{root}/usage", USAGE, combine=_usage)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_space(spark, "ingest") as space:
            settle(spark, materialize(prepare_batches(batch, window), "prepared", space), batch_id, space)

    def settle(spark: SparkSession, staged: DataFrame, batch_id: int, space: str) -> None:
        change = (checkpoint, batch_id)
        if identities.done(*change):  # written last: all of this micro-batch is there
            return
        earlier = store.matching(identities, staged, buckets=key_buckets)
        # Totals come from one row per project, not from the identities.
        usage = used = totals.read(before=change)
        open_rows = total = 0
        if limits.overall:
            stored = used.agg(F.sum("event_count").alias("n"), F.sum("stored_bytes").alias("b")).first()
            total = stored["b"] or 0
            open_rows = outbox_now(spark).where(outbox_is_pending()).count() if outbox_now else stored["n"] or 0
        result = admission.admit(
            staged.select(
                "project_id", "batch_at", "batch_id", "ordinal", "event_id", "payload_hash", "stored_bytes",
                "occurred_at", "reject_reason",
            ),
            earlier,
            usage,
            limits,
            mode,
            outbox_pending=open_rows,
            total_bytes=total,
        )
        fresh = result.identity
        bodies = staged.groupBy(*EVENT, "payload_hash").agg(F.min("payload").alias("payload"))
        inbox = fresh.join(bodies, [*EVENT, "payload_hash"]).select(
            *EVENT, "payload", "received_at", F.lit(None).cast("timestamp_ntz").alias("processed_at")
        )
        if mode == "direct":
            store.insert_absent(inbox_events(inbox), f"{root}/events")
        else:
            inbox.write.mode("overwrite").parquet(f"{root}/inbox/batch={batch_id}")
            delivery.enqueue(inbox).write.mode("overwrite").parquet(f"{root}/outbox/batch={batch_id}")
            mirror.enqueue(inbox).write.mode("overwrite").parquet(f"{root}/mirror_queue/batch={batch_id}")
        result.receipts.write.mode("overwrite").parquet(f"{root}/receipts/batch={batch_id}")
        result.decisions.write.mode("overwrite").parquet(f"{root}/decisions/batch={batch_id}")
        staged.where(F.col("reject_reason").isNotNull()).write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
        added = fresh.groupBy("project_id").agg(F.count("*").alias("event_count"), F.sum("stored_bytes").alias("stored_bytes"))
        added = materialize(added.withColumn(parts.PART, parts.bucket(["project_id"], USAGE_BUCKETS)), "usage", space)
        changed = parts.touched(added)
        totals.rewrite(_usage(totals.read(changed, before=change).unionByName(added)), changed, *change)
        # Identities last: a batch that failed half-way is decided again from the same state.
        identities.append(store.bucketed(fresh, key_buckets), *change)

    return run_steps(frames, checkpoint, step, trigger)


def prepare_batches(batches: DataFrame, window: validation.AdmissionWindow = validation.AdmissionWindow()) -> DataFrame:
    """Envelopes to canonical batch events with ``reject_reason`` and field ``errors``."""
    opened = wire.explode_batches(batches)
    decoded = wire.decode_events(opened, "event")
    checked = validation.validate(decoded, F.col("batch_at"), window)
    reason = (
        F.when(F.col("batch_error") == "batch too large", F.lit("size"))
        .when(F.col("batch_error").isNotNull(), F.col("batch_error"))
        .when(F.col("event").isNull(), F.lit("validation"))
        .otherwise(F.col("reject_reason"))
    )
    return canonical.canonicalize(checked.withColumn("reject_reason", reason), parsed=True).select(
        "project_id", "batch_id", "batch_at", "ordinal", "event_id", "payload", "payload_hash", "stored_bytes",
        "occurred_at", "errors", "reject_reason",
    )


def attempt_budget(
    attempts_stream: DataFrame,
    root: str,
    checkpoint: str,
    limit: int = budgets.BUCKET_LIMIT,
    trigger: dict | None = None,
    global_limit: int | None = budgets.GLOBAL_LIMIT,
) -> StreamingQuery:
    """Budgets over a stream in arrival order: the global one first, then the account bucket's.

    The open window of everybody together and of each bucket (4096 buckets at most) is carried from
    one micro-batch to the next in ``root/open``; decisions go to ``root/decisions``. Attempts
    that the global budget refuses never reach a bucket's counter.
    """
    windows_now = parts.Parts(attempts_stream.sparkSession, f"{root}/open", "scope STRING, bucket STRING, t BIGINT, used BIGINT")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.select(
            "attempt_id",
            text.account_bucket(F.col("username")).alias("bucket"),
            temporal.micros(F.col("attempted_at")).alias("t"),
        )
        # One row per bucket and the global one, rewritten each time; a repeated micro-batch finds what it found before.
        state = windows_now.read(["open"], before=(checkpoint, batch_id))
        order = ["t", "attempt_id"]

        def budget(rows: DataFrame, scope: str, most: int) -> tuple[DataFrame, DataFrame]:
            """The attempts within a scope's budget, and the windows that stay open."""
            carried = state.where(F.col("scope") == scope).select("bucket", "t", "used")
            placed = budgets.windowed(rows, ["bucket"], order, carried).join(
                carried.select("bucket", F.col("t").alias("window_start"), "used"), ["bucket", "window_start"], "left"
            )
            used = F.coalesce("used", F.lit(0))
            counts = placed.groupBy("bucket", F.col("window_start").alias("t")).agg(
                F.least(F.count("*") + F.max(used), F.lit(most + 1)).alias("used")
            )
            newest = counts.unionByName(carried).groupBy("bucket").agg(F.max(F.struct("t", "used")).alias("__w"))
            kept = newest.select(F.lit(scope).alias("scope"), "bucket", "__w.t", "__w.used")
            return budgets.within_limit(placed, ["bucket"], order, most, used).select("attempt_id"), kept

        with scratch_space(spark, "budget") as space:
            passed, windows = timed, None
            if global_limit is not None:
                together = timed.withColumn("bucket", F.lit("global"))
                within, windows = budget(together, "global", global_limit)
                passed = materialize(timed.join(within, "attempt_id", "left_semi"), "passed", space)
            within, open_buckets = budget(passed, "bucket", limit)
            decided = timed.join(within.withColumn("allowed", F.lit(True)), "attempt_id", "left").select(
                "attempt_id", "bucket", "t", F.coalesce("allowed", F.lit(False)).alias("allowed")
            )
            decided.write.mode("overwrite").parquet(f"{root}/decisions/batch={batch_id}")
            windows = open_buckets if windows is None else open_buckets.unionByName(windows)
            windows_now.rewrite(windows.withColumn(parts.PART, F.lit("open")), ["open"], checkpoint, batch_id)

    return run_steps(attempts_stream, checkpoint, step, trigger)


def progress_rows(query: StreamingQuery) -> list[Row]:
    """Live gauges of a query: rows, rate and duration per recent micro-batch, with observed metrics."""
    rows = []
    for p in query.recentProgress:
        rows.append(
            Row(
                batch=p["batchId"],
                input_rows=p["numInputRows"],
                rows_per_second=p.get("processedRowsPerSecond"),
                duration_ms=p.get("durationMs", {}).get("triggerExecution"),
                observed=p.get("observedMetrics", {}),
            )
        )
    return rows
