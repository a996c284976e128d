"""Table schemas.

Every timestamp is TIMESTAMP_NTZ holding UTC, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

EVENTS = (
    "project_id STRING, event_id STRING, event_type STRING, schema_version INT, user_id STRING, "
    "anonymous_id STRING, session_id STRING, occurred_at TIMESTAMP_NTZ, received_at TIMESTAMP_NTZ, properties STRING"
)
IDENTITY = (
    "project_id STRING, event_id STRING, payload_hash STRING, occurred_at TIMESTAMP_NTZ, "
    "received_at TIMESTAMP_NTZ, stored_bytes BIGINT"
)
INBOX = "project_id STRING, event_id STRING, payload STRING, received_at TIMESTAMP_NTZ, processed_at TIMESTAMP_NTZ"
MIRROR_QUEUE = "project_id STRING, event_id STRING, created_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ"
MIRROR_EVENTS = EVENTS + ", version TIMESTAMP_NTZ"
OUTBOX = (
    "project_id STRING, event_id STRING, payload STRING, created_at TIMESTAMP_NTZ, published_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, next_attempt_at TIMESTAMP_NTZ, dead_lettered_at TIMESTAMP_NTZ, attempts INT, "
    "last_error STRING"
)
PROJECTS = "id STRING, name STRING, event_count BIGINT, stored_bytes BIGINT"
AUDIT = (
    "id BIGINT, occurred_at TIMESTAMP_NTZ, actor STRING, project_id STRING, action STRING, target STRING, details STRING"
)
EVENT_SCHEMAS = "project_id STRING, event_type STRING, version INT, definition STRING, created_at TIMESTAMP_NTZ"
SAVED_VIEWS = (
    "id STRING, project_id STRING, user_id STRING, name STRING, definition STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
USERS = "id BIGINT, username STRING, disabled BOOLEAN"
MEMBERSHIPS = "user_id BIGINT, project_id STRING, can_demo BOOLEAN, can_manage BOOLEAN"
BATCH_EVENTS = (
    "project_id STRING, batch_id STRING, batch_at TIMESTAMP_NTZ, ordinal INT, event_id STRING, payload_hash STRING, "
    "stored_bytes BIGINT, occurred_at TIMESTAMP_NTZ"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
