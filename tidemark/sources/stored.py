"""Retention, erasure, upserts and pages on stored tables that lie in parts.

Events and what depends on them (inbox, identities, broker and mirror work) lie in the UTC day the event happened on. So a sweep looks at the
days that have expired and no others, an erasure at the subject's days, and a page at the days it shows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import jsondoc
from tidemark.operators import explorer, maintenance
from tidemark.operators.filters import EventFilter, at, utc
from tidemark.session import materialize, scratch_space
from tidemark.sources import parts

EVENT = ["project_id", "event_id"]
SCHEMAS = {
    "events": schemas.EVENTS, "inbox": schemas.INBOX, "identity": schemas.IDENTITY,
    "mirror_queue": schemas.MIRROR_QUEUE, "outbox": schemas.OUTBOX,
}


def day_tables(spark: SparkSession, root: str) -> dict[str, parts.Parts]:
    return {name: parts.Parts(spark, f"{root}/{name}", schema) for name, schema in SCHEMAS.items()}


def dated(rows: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Rows with their part: the day of ``occurred_at``, or that of their event in ``days`` (event keys and ``occurred_at``)."""
    if days is not None:
        rows = rows.join(days.select(*EVENT, F.col("occurred_at").alias("__at")), EVENT)
    return rows.withColumn(parts.PART, F.date_format("__at" if days is not None else "occurred_at", "yyyy-MM-dd"))


def sweep(tables: Mapping[str, parts.Parts], policy: maintenance.RetentionPolicy, now: datetime, writer: str | None = None, number: int = 0) -> dict[str, list[str]]:
    """The retention sweep of ``maintenance.retention_sweep`` in place; the days that were looked at, by table.

    Expired days without pending work go as folders, unread. Of other expired days the rows of pending events are written anew, and of the day the
    horizon falls on those that have not expired. No later day is read or written.
    """
    spark = tables["inbox"].spark
    horizons = {"event": utc(now) - timedelta(days=policy.event_days), "identity": utc(now) - timedelta(days=policy.identity_days)}
    cut = {name: horizons["event" if name in ("events", "inbox") else "identity"] for name in tables}
    looked = {name: [p for p in table.parts() if p <= cut[name].date().isoformat()] for name, table in tables.items()}
    with scratch_space(spark, "sweep") as space:
        pending = tables["inbox"].read(looked["inbox"]).where(F.col("processed_at").isNull()).select(*EVENT, parts.PART)
        kept = {}
        for moment in set(cut.values()):
            border = tables["identity"].read([moment.date().isoformat()]).where(F.col("occurred_at") >= at(moment)).select(*EVENT, parts.PART)
            kept[moment] = materialize(pending.unionByName(border).distinct(), "kept", space)
        needed = {moment: set(parts.touched(keys)) for moment, keys in kept.items()}
        for name, table in tables.items():
            some = [p for p in looked[name] if p in needed[cut[name]]]
            rows = table.read(some).join(kept[cut[name]], [*EVENT, parts.PART], "left_semi")
            if looked[name]:
                table.change(rows, looked[name], writer, number)
    return looked


def erase(tables: Mapping[str, parts.Parts], project: str, user_id: str, writer: str | None = None, number: int = 0) -> list[str]:
    """The erasure of ``maintenance.erase_subject`` in place; only the subject's days are written. Returns them.

    The inbox is read for payloads that wait for their event; columns and filters reach the scan.
    """
    spark = tables["events"].spark
    with scratch_space(spark, "erase") as space:
        stored = tables["events"].read().where((F.col("project_id") == project) & (F.col("user_id") == user_id)).select(*EVENT, parts.PART)
        waiting = tables["inbox"].read().where((F.col("project_id") == project) & (jsondoc.text_member(F.col("payload"), "userId") == user_id))
        keys = materialize(stored.unionByName(waiting.select(*EVENT, parts.PART)).distinct(), "subject", space)
        days = sorted(parts.touched(keys))
        for table in tables.values():
            held = [p for p in days if p in table.parts()]
            if held:
                table.change(table.read(held).join(keys, [*EVENT, parts.PART], "left_anti"), held, writer, number)
    return days


def timeline(events: parts.Parts, filter: EventFilter, limit: int, after: explorer.Cursor | None = None, seen: Callable[[list[str]], None] | None = None) -> list[Row]:
    """The page of ``explorer.timeline``, from as few days as it takes.

    Days are read in order, one, then two, then four at a time, until the page is full. ``seen`` is told the days of each read.
    """
    first = max([m for m in (utc(filter.start), after and utc(after.at)) if m is not None], default=None)
    last = utc(filter.end)
    days = [d for d in events.parts() if (first is None or d >= first.date().isoformat()) and (last is None or d <= last.date().isoformat())]
    page: list[Row] = []
    width = 1
    while days and len(page) < limit:
        now, days = days[:width], days[width:]
        if seen:
            seen(now)
        page += explorer.timeline(events.read(now), filter, limit, after).collect()  # a page at most
        width *= 2
    return page[:limit]
