"""Event explorer: keyset pages, cursors and subject export."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.filters import EventFilter, at, utc

TIMELINE = [
    "event_id",
    "event_type",
    "occurred_at",
    "received_at",
    "user_id",
    "anonymous_id",
    "session_id",
    "properties",
    "schema_version",
]


def scope_hash(filter: EventFilter) -> str:
    return hashlib.sha256(json.dumps(filter.scope(), sort_keys=True).encode()).hexdigest().upper()


@dataclass(frozen=True)
class Cursor:
    """Position after the last row of a page, tied to the filters it was made with."""

    scope: str
    at: datetime
    event_id: str

    def encode(self) -> str:
        body = {"scope": self.scope, "at": utc(self.at).isoformat(), "id": self.event_id}
        return base64.b64encode(json.dumps(body).encode()).decode()

    @staticmethod
    def decode(text: str, filter: EventFilter) -> Cursor:
        try:
            if len(text) > 1024:
                raise ValueError("too long")
            body = json.loads(base64.b64decode(text, validate=True))
            cursor = Cursor(body["scope"], datetime.fromisoformat(body["at"]), str(body["id"]))
        except (ValueError, KeyError, TypeError) as error:
            raise ValueError("Invalid cursor or changed query filters.") from error
        if cursor.scope != scope_hash(filter) or cursor.at.tzinfo is not None:
            raise ValueError("Invalid cursor or changed query filters.")
        return cursor


def timeline(events: DataFrame, filter: EventFilter, limit: int, after: Cursor | None = None) -> DataFrame:
    """At most ``limit`` events after the cursor in (occurred_at, event_id) order.

    The page size is the feature here: Spark keeps the first rows of each
    partition and merges those, it does not sort the table.
    """
    if not 1 <= limit <= 101:
        raise ValueError("A page has 1 to 100 events.")
    rows = filter.apply(events)
    if after is not None:
        moment = at(after.at)
        rows = rows.where(
            (F.col("occurred_at") >= moment)
            & ((F.col("occurred_at") > moment) | (F.col("event_id") > after.event_id))
        )
    return rows.select("project_id", *TIMELINE).orderBy("occurred_at", "event_id").limit(limit)


def timeline_page(
    events: DataFrame, filter: EventFilter, limit: int = 50, cursor: str | None = None
) -> tuple[list[Row], str | None]:
    """One page and the cursor of the next; the extra row only tells whether there is one."""
    if filter.project is None:
        raise ValueError("A timeline needs a project.")
    if not 1 <= limit <= 100:
        raise ValueError("A page has 1 to 100 events.")
    after = Cursor.decode(cursor, filter) if cursor else None
    rows = timeline(events, filter, limit + 1, after).collect()
    page = rows[:limit]
    more = len(rows) > limit
    return page, Cursor(scope_hash(filter), page[-1].occurred_at, page[-1].event_id).encode() if more else None


def pages(frames: list[DataFrame]) -> DataFrame:
    """Loaded pages as one list."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def subject_export(events: DataFrame, project: str, user_id: str) -> DataFrame:
    """Every event of a user in time order."""
    return (
        EventFilter(project, user_id=user_id)
        .apply(events)
        .select(*TIMELINE)
        .orderBy("occurred_at", "event_id")
    )


def write_export(export: DataFrame, path: str) -> None:
    export.withColumn("properties", F.parse_json("properties")).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    ).write.mode("errorifexists").text(path)
