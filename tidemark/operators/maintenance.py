"""Retention sweep, subject erasure, usage recount and audit.

Parquet has no DELETE: each job returns the surviving rows as new table versions
(see ``sources.store``). Deletions cascade explicitly from the identity table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc
from tidemark.operators.filters import at, utc

EVENT = ["project_id", "event_id"]
DEPENDANTS = ("events", "inbox", "mirror_queue", "outbox")


@dataclass(frozen=True)
class RetentionPolicy:
    event_days: int = 30
    identity_days: int = 30
    max_late_days: float = 7

    def __post_init__(self):
        if not (
            1 <= self.event_days <= 3650
            and self.event_days > self.max_late_days
            and self.event_days <= self.identity_days <= 3650
        ):
            raise ValueError(
                "Event retention must exceed allowed lateness; identity retention must cover event retention."
            )


def project_usage(projects: DataFrame, identity: DataFrame) -> DataFrame:
    """Recount events and bytes from the identities; projects without any get zeros."""
    counted = identity.groupBy(F.col("project_id").alias("id")).agg(
        F.count("*").alias("__n"), F.sum("stored_bytes").alias("__b")
    )
    return (
        projects.join(counted, "id", "left")
        .select(
            "id",
            "name",
            F.coalesce("__n", F.lit(0)).alias("event_count"),
            F.coalesce("__b", F.lit(0)).alias("stored_bytes"),
        )
        .orderBy("id")
    )


def retention_sweep(tables: Mapping[str, DataFrame], policy: RetentionPolicy, now: datetime) -> dict[str, DataFrame]:
    """Survivors of every table, and ``removed``: the expired identities.

    Pending work is never removed, however old. Processed payloads go with their
    event; identities have a horizon of their own and take their dependants along.
    """
    event_cut = at(utc(now) - timedelta(days=policy.event_days))
    identity_cut = at(utc(now) - timedelta(days=policy.identity_days))
    inbox, identity = tables["inbox"], tables["identity"]
    pending = inbox.where(F.col("processed_at").isNull()).select(*EVENT)

    expired_events = tables["events"].where(F.col("occurred_at") < event_cut).select(*EVENT)
    doomed_events = expired_events.join(pending, EVENT, "left_anti")
    expired_identity = identity.where(F.col("occurred_at") < event_cut).select(*EVENT)
    removed = identity.where(F.col("occurred_at") < identity_cut).join(pending, EVENT, "left_anti")
    removed_keys = removed.select(*EVENT)

    processed = F.col("processed_at").isNotNull()
    done = inbox.where(processed).join(expired_identity, EVENT, "left_anti")
    result = {
        "events": tables["events"].join(doomed_events, EVENT, "left_anti").join(removed_keys, EVENT, "left_anti"),
        # Rows still pending are kept without looking anything up; removed identities never have one.
        "inbox": inbox.where(~processed).unionByName(done.join(removed_keys, EVENT, "left_anti")),
        "identity": identity.where(F.col("occurred_at") >= identity_cut).unionByName(
            identity.where(F.col("occurred_at") < identity_cut).join(pending, EVENT, "left_semi")
        ),
        "removed": removed,
    }
    for name in ("mirror_queue", "outbox"):
        if name in tables:
            result[name] = tables[name].join(removed_keys, EVENT, "left_anti")
    if "projects" in tables:
        result["projects"] = project_usage(tables["projects"], result["identity"])
    return result


def subject_keys(events: DataFrame, inbox: DataFrame, project: str, user_id: str) -> DataFrame:
    """Ids of a subject in the event table or still in the inbox."""
    stored = events.where((F.col("project_id") == project) & (F.col("user_id") == user_id)).select(*EVENT)
    waiting = inbox.where(
        (F.col("project_id") == project) & (jsondoc.text_member(F.col("payload"), "userId") == user_id)
    ).select(*EVENT)
    return stored.union(waiting).distinct()


def erase_subject(tables: Mapping[str, DataFrame], project: str, user_id: str) -> dict[str, DataFrame]:
    """Survivors of every table after erasing a subject, and ``erased``: the removed ids.

    Identities go too, so a later delivery of the same id counts as new. The mirror,
    when given, is erased as well.
    """
    keys = subject_keys(tables["events"], tables["inbox"], project, user_id)
    result = {"erased": keys}
    for name in (*DEPENDANTS, "identity", "mirror_events"):
        if name in tables:
            result[name] = tables[name].join(keys, EVENT, "left_anti")
    if "projects" in tables:
        recounted = project_usage(tables["projects"], result["identity"])
        mine = F.col("id") == project
        result["projects"] = recounted.where(mine).unionByName(
            tables["projects"].where(~mine).select(*recounted.columns)
        )
    return result


def audit_rows(changes: DataFrame, actor: str, action: str, occurred_at: datetime) -> DataFrame:
    """Audit records for changed rows (``id, project_id, target, details``)."""
    return changes.select(
        "id",
        at(occurred_at).alias("occurred_at"),
        F.substring(F.lit(actor), 1, 200).alias("actor"),
        "project_id",
        F.substring(F.lit(action), 1, 100).alias("action"),
        F.substring("target", 1, 200).alias("target"),
        "details",
    )


def audit_latest(audit: DataFrame, project: str, limit: int = 100) -> DataFrame:
    """The newest records of a project (the page size is the feature)."""
    return (
        audit.where(F.col("project_id") == project)
        .orderBy(F.desc("occurred_at"), F.desc("id"))
        .limit(limit)
        .select("id", "occurred_at", "actor", "action", "target", "details")
    )
