"""Canonical event text, fingerprint and logical size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal, text

RESERVED_BYTES = 1024  # fixed value: logical reservation per event


def stored_bytes(payload: Column) -> Column:
    return F.octet_length(payload).cast("bigint") * 2 + RESERVED_BYTES


def fingerprint(payload: Column) -> Column:
    return F.upper(F.sha2(payload, 256))


def payload_text(
    event_id: Column,
    event_type: Column,
    schema_version: Column,
    occurred_at: Column,
    user_id: Column,
    anonymous_id: Column,
    session_id: Column,
    canonical_properties: Column,
) -> Column:
    """One JSON object with sorted members, nulls kept, properties already canonical."""
    head = F.to_json(
        F.struct(
            anonymous_id.alias("anonymousId"),
            event_id.alias("eventId"),
            event_type.alias("eventType"),
            temporal.iso_text(occurred_at).alias("occurredAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    tail = F.to_json(
        F.struct(schema_version.alias("schemaVersion"), session_id.alias("sessionId"), user_id.alias("userId")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1),
        F.lit(',"properties":'),
        canonical_properties,
        F.lit(","),
        F.substr(tail, F.lit(2)),
    )


def canonicalize(events: DataFrame, parsed: bool = False) -> DataFrame:
    """Normalise decoded events and add ``payload``, ``payload_hash`` and ``stored_bytes``.

    ``properties`` is raw JSON text or NULL; anything but an object counts as ``{}``.
    ``parsed`` says that it is canonical text already, as the wire decoder leaves it.
    """
    raw = F.col("properties")
    is_object = F.coalesce(raw.rlike(r"^\s*\{"), F.lit(False))
    normal = (
        events.withColumn("event_type", text.trim_whitespace(F.col("event_type")))
        .withColumn("event_id", F.lower(F.col("event_id")))
        .withColumn("properties", F.when(is_object, raw if parsed else jsondoc.canonical(raw)).otherwise(F.lit("{}")))
    )
    return (
        normal.withColumn(
            "payload",
            payload_text(
                F.col("event_id"),
                F.col("event_type"),
                F.col("schema_version"),
                F.col("occurred_at"),
                F.col("user_id"),
                F.col("anonymous_id"),
                F.col("session_id"),
                F.col("properties"),
            ),
        )
        .withColumn("payload_hash", fingerprint(F.col("payload")))
        .withColumn("stored_bytes", stored_bytes(F.col("payload")))
    )
