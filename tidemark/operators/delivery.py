"""Broker outbox: publish, confirm, retry, dead-letter and replay.

Each function maps the outbox state table to its next state.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal, text
from tidemark.operators import skew
from tidemark.operators.filters import at
from tidemark.sources import wire

EVENT = ["project_id", "event_id"]
MAX_ATTEMPTS = 8
# Failure classes that no retry can repair.
PERMANENT_ERRORS = ("JsonException", "InvalidOperationException", "ArgumentException", "FormatException")
ENVELOPE = "project_id STRING, event_id STRING, payload STRING"


def retry_seconds(attempts: Column, jitter: Column) -> Column:
    """Exponential delay capped at five minutes plus up to a fifth of it."""
    base = F.least(F.lit(300.0), F.pow(F.lit(2.0), attempts))
    return base * (1 + 0.2 * jitter)


def hash_jitter(*keys: str) -> Column:
    """A repeatable stand-in for a random number in [0, 1)."""
    return F.pmod(F.xxhash64(*keys), F.lit(1000)) / 1000


def eligible(now: datetime) -> Column:
    return (
        F.col("published_at").isNull()
        & F.col("completed_at").isNull()
        & F.col("dead_lettered_at").isNull()
        & (F.col("next_attempt_at") <= at(now))
    )


def enqueue(inbox: DataFrame) -> DataFrame:
    """Outbox rows for newly accepted events, due at once."""
    never = F.lit(None).cast("timestamp_ntz")
    return inbox.select(
        *EVENT,
        "payload",
        F.col("received_at").alias("created_at"),
        never.alias("published_at"),
        never.alias("completed_at"),
        F.col("received_at").alias("next_attempt_at"),
        never.alias("dead_lettered_at"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
    )


def claim(outbox: DataFrame, now: datetime, batch_size: int = 100) -> DataFrame:
    """The next messages to publish, oldest first (the batch size is the feature)."""
    return (
        outbox.where(eligible(now)).orderBy("created_at", *EVENT).limit(batch_size).select(*EVENT, "payload")
    )


def envelopes(outbox: DataFrame, now: datetime) -> DataFrame:
    """Message text of every eligible row."""
    return outbox.where(eligible(now)).select(*EVENT, F.to_json(F.struct(*EVENT, "payload")).alias("value"))


def mark_published(outbox: DataFrame, published: DataFrame, now: datetime) -> DataFrame:
    hit = published.select(*EVENT, F.lit(True).alias("__hit")).distinct()
    return outbox.join(hit, EVENT, "left").select(
        *_with(
            outbox,
            published_at=F.when(F.col("__hit"), at(now)).otherwise(F.col("published_at")),
            last_error=F.when(F.col("__hit"), F.lit(None)).otherwise(F.col("last_error")),
        )
    )


def _with(frame: DataFrame, **changes: Column) -> list[Column]:
    return [changes[c].alias(c) if c in changes else frame[c].alias(c) for c in frame.columns]


def read_deliveries(messages: DataFrame, outbox: DataFrame, inbox: DataFrame, value: str = "value") -> DataFrame:
    """Decode delivered messages and name each failure.

    ``error_type`` is NULL for a sound delivery, which then carries the receipt
    time of the inbox. A payload with an unknown member or a member of another type is refused like broken JSON. A message may come many times, so equal messages are merged
    first; an event with very many different messages is divided over tasks.
    """
    envelope = F.from_json(value, ENVELOPE)
    decoded = (
        messages.select(F.col(value).alias("value"))
        .distinct()
        .withColumn("__e", envelope)
        .select("value", "__e.project_id", "__e.event_id", "__e.payload")
    )
    document = F.try_parse_json("payload")
    checked = decoded.withColumn("__json", document.isNotNull()).withColumn("__valid", wire.is_event(document)).withColumn(
        "__payload_id", F.when(F.col("__valid"), F.lower(jsondoc.text_member(F.col("payload"), "eventId")))
    )
    known = outbox.select(*EVENT, F.lit(True).alias("__known")).join(inbox.select(*EVENT, "received_at"), EVENT, "left")
    joined = skew.lookup(checked, known, EVENT, ["value"], skew.hot_keys(decoded, EVENT))
    error_type = (
        F.when(~F.col("__valid"), F.lit("JsonException"))
        .when(
            ~F.col("__payload_id").eqNullSafe(F.lower("event_id")) | F.col("__known").isNull() | F.col("received_at").isNull(),
            F.lit("InvalidOperationException"),
        )
    )
    message = (
        F.when(~F.col("__json"), F.lit("The message's payload is no JSON."))
        .when(~F.col("__valid"), F.lit("The message's payload is no event."))
        .when(
            ~F.col("__payload_id").eqNullSafe(F.lower("event_id")),
            F.lit("Envelope and payload name different events."),
        )
        .when(F.col("__known").isNull(), F.lit("No outbox row has this event."))
        .when(F.col("received_at").isNull(), F.lit("No inbox row has this event."))
    )
    return joined.select(*EVENT, "payload", "received_at", error_type.alias("error_type"), message.alias("message"))


def apply_deliveries(delivered: DataFrame, inbox: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """What sound deliveries change beside the outbox: the inbox with its processing times, and new mirror work.

    The events themselves go through ``store.insert_absent``; the first processing time of a row stays.
    """
    hit = delivered.where(F.col("error_type").isNull()).select(*EVENT, F.lit(True).alias("__hit")).distinct()
    marked = inbox.join(hit, EVENT, "left")
    done = marked.select(
        *_with(inbox, processed_at=F.when(F.col("__hit"), F.coalesce("processed_at", at(now))).otherwise(F.col("processed_at")))
    )
    fresh = marked.where(F.col("__hit") & F.col("processed_at").isNull())
    work = fresh.select(*[F.col(c) for c in EVENT], at(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return done, work


def complete(outbox: DataFrame, delivered: DataFrame, now: datetime) -> DataFrame:
    """Confirm deliveries; the first confirmation time stays."""
    hit = delivered.select(*EVENT, F.lit(True).alias("__hit")).distinct()
    return outbox.join(hit, EVENT, "left").select(
        *_with(
            outbox,
            completed_at=F.when(F.col("__hit"), F.coalesce("completed_at", at(now))).otherwise(F.col("completed_at")),
            last_error=F.when(F.col("__hit"), F.lit(None)).otherwise(F.col("last_error")),
        )
    )


def record_failures(
    outbox: DataFrame, failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, jitter: Column | None = None
) -> DataFrame:
    """Apply failures (``error_type, message, permanent, failed_at``) to the outbox.

    Several failures of one event are reduced before the join: attempts add up, a
    permanent one or too many attempts end in dead-lettering, the last error and
    its time count. Failures of unknown events change nothing.
    """
    reduced = failures.groupBy(*EVENT).agg(
        F.count("*").alias("__n"),
        F.bool_or("permanent").alias("__permanent"),
        F.max(F.struct("failed_at", text.error_text(F.col("error_type"), F.col("message")).alias("detail"))).alias("__last"),
    )
    hit = F.col("__n").isNotNull()
    attempts = (F.col("attempts") + F.coalesce("__n", F.lit(0))).cast("int")
    dead = hit & (F.col("__permanent") | (attempts >= max_attempts))
    retry = hit & ~dead
    failed_at = F.col("__last.failed_at")
    jitter = hash_jitter(*EVENT) if jitter is None else jitter
    delay = F.round(retry_seconds(attempts, jitter) * 1e6).cast("bigint")
    return outbox.join(reduced, EVENT, "left").select(
        *_with(
            outbox,
            attempts=attempts,
            published_at=F.when(retry, F.lit(None)).otherwise(F.col("published_at")),
            next_attempt_at=F.when(retry, temporal.plus_micros(failed_at, delay)).otherwise(F.col("next_attempt_at")),
            dead_lettered_at=F.when(dead, failed_at).otherwise(F.col("dead_lettered_at")),
            last_error=F.when(hit, F.col("__last.detail")).otherwise(F.col("last_error")),
        )
    )


def dead_letters(outbox: DataFrame, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Dead-lettered rows, newest first; an operator's page is clamped to 1–500 rows."""
    rows = outbox.where(F.col("dead_lettered_at").isNotNull())
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    rows = rows.select("event_id", "project_id", "created_at", "attempts", "last_error", "dead_lettered_at").orderBy(
        F.desc("dead_lettered_at"), "event_id"
    )
    return rows if limit is None else rows.limit(min(max(limit, 1), 500))


def replay_dead_letters(
    outbox: DataFrame, now: datetime, project: str | None = None, event_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The outbox with dead letters reopened, and the keys that changed."""
    chosen = F.col("dead_lettered_at").isNotNull()
    if project is not None and project.strip():
        chosen = chosen & (F.col("project_id") == project)
    if event_id is not None:
        chosen = chosen & (F.col("event_id") == event_id)
    nothing = F.lit(None)
    reopened = outbox.select(
        *_with(
            outbox,
            dead_lettered_at=F.when(chosen, nothing).otherwise(F.col("dead_lettered_at")),
            published_at=F.when(chosen, nothing).otherwise(F.col("published_at")),
            next_attempt_at=F.when(chosen, at(now)).otherwise(F.col("next_attempt_at")),
            attempts=F.when(chosen, F.lit(0)).otherwise(F.col("attempts")),
            last_error=F.when(chosen, nothing).otherwise(F.col("last_error")),
        )
    )
    return reopened, outbox.where(chosen).select(*EVENT)
