"""Schema registry, saved views, project catalogue and roster."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.filters import EventFilter, at

VERSION = ["project_id", "event_type", "version"]


def publish_schemas(registry: DataFrame, requested: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Registered rows to append and refused rows with a reason; versions are immutable.

    Of several requests for one version the smallest definition in byte order is taken.
    """
    is_object = F.coalesce(F.try_parse_json("definition").isNotNull() & F.col("definition").rlike(r"^\s*\{"), F.lit(False))
    invalid = text.is_blank(F.col("event_type")) | (F.length("event_type") > 100) | (F.col("version") < 1) | ~is_object
    checked = requested.withColumn("__invalid", invalid)
    valid = checked.where(~F.col("__invalid")).groupBy(*VERSION).agg(F.min("definition").alias("definition"))
    fresh = valid.join(registry.select(*VERSION), VERSION, "left_anti").withColumn("created_at", at(now))
    taken = valid.join(registry.select(*VERSION), VERSION, "left_semi").withColumn(
        "reason", F.lit("This version exists already and never changes; take the next one.")
    )
    refused = taken.unionByName(
        checked.where("__invalid").select(*VERSION, "definition", F.lit(
            "Needs an event type, a version above zero and an object as definition."
        ).alias("reason"))
    )
    return fresh, refused


def list_schemas(registry: DataFrame, project: str | None = None) -> DataFrame:
    rows = registry if project is None else registry.where(F.col("project_id") == project)
    return rows.orderBy(*VERSION)


def schema_gaps(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Counts of events whose (type, version) is not registered. Events are counted before the join."""
    used = events.groupBy("project_id", "event_type", F.col("schema_version").alias("version")).agg(
        F.count("*").alias("events")
    )
    return used.join(registry.select(*VERSION), VERSION, "left_anti").orderBy(*VERSION)


def save_view(views: DataFrame, row: dict, now: datetime) -> DataFrame:
    """The table of definitions after an upsert by id; a name is unique per project and user."""
    if not (row["name"] or "").strip() or len(row["name"]) > 100 or not isinstance(json.loads(row["definition"]), dict):
        raise ValueError("Needs a name of 1 to 100 characters and an object as definition.")
    name = row["name"].strip()
    owner = (F.col("project_id") == row["project_id"]) & (F.col("user_id") == row["user_id"])
    if not views.where(owner & (F.col("name") == name) & (F.col("id") != row["id"])).isEmpty():
        raise ValueError("A saved view already has that name.")
    fields = ("id", "project_id", "user_id")
    request = views.sparkSession.range(1).select(
        *[F.lit(row[c]).alias(c) for c in fields],
        F.lit(name).alias("__name"),
        F.lit(row["definition"]).alias("__definition"),
    )
    merged = views.join(request, list(fields), "full")
    touched = F.col("__name").isNotNull()
    return merged.select(
        *fields,
        F.coalesce("__name", "name").alias("name"),
        F.coalesce("__definition", "definition").alias("definition"),
        F.coalesce("created_at", at(now)).alias("created_at"),
        F.when(touched, at(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def list_views(views: DataFrame, project: str, user_id: str) -> DataFrame:
    return views.where((F.col("project_id") == project) & (F.col("user_id") == user_id)).orderBy("name")


def view_filter(definition: str, project: str | None = None) -> EventFilter:
    """The report scope a saved definition describes."""
    body = json.loads(definition)

    def moment(name: str) -> datetime | None:
        return datetime.fromisoformat(body[name]) if body.get(name) else None

    return EventFilter(
        project,
        moment("from"),
        moment("to"),
        body.get("eventType") or None,
        body.get("userId") or None,
        body.get("propertyName") or None,
        body.get("propertyValue") or None,
    ).check()


def apply_view(events: DataFrame, definition: str, project: str | None = None) -> DataFrame:
    return view_filter(definition, project).apply(events)


def view_counts(events: DataFrame, views: DataFrame) -> DataFrame:
    """Events matched by each saved view that filters on an event type.

    Events are counted per (project, type) first, so the join sees counts only.
    """
    counted = events.groupBy("project_id", "event_type").agg(F.count("*").alias("__n"))
    wanted = views.withColumn("event_type", F.get_json_object("definition", "$.eventType"))
    return (
        wanted.join(counted, ["project_id", "event_type"], "left")
        .select("project_id", "user_id", "name", "event_type", F.coalesce("__n", F.lit(0)).alias("events"))
        .orderBy("project_id", "user_id", "name")
    )


def project_catalog(projects: DataFrame, memberships: DataFrame, user_id: int | None = None) -> DataFrame:
    """Projects of each user with display name and rights."""
    mine = memberships if user_id is None else memberships.where(F.col("user_id") == user_id)
    shown = projects.select(
        F.col("id").alias("project_id"), F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("display_name")
    )
    return (
        mine.join(shown, "project_id")
        .select("user_id", "project_id", "display_name", "can_demo", "can_manage")
        .orderBy("user_id", "project_id")
    )


def roster(memberships: DataFrame, users: DataFrame, project: str, limit: int = 200) -> DataFrame:
    """Members of a project by name (the page size is the feature)."""
    return (
        memberships.where(F.col("project_id") == project)
        .join(users.withColumnRenamed("id", "user_id"), "user_id")
        .select("username", "disabled", "can_demo", "can_manage")
        .orderBy("username")
        .limit(limit)
    )


def managers(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Enabled members with management rights per project."""
    enabled = users.where(~F.col("disabled")).select(F.col("id").alias("user_id"))
    return (
        memberships.where("can_manage")
        .join(enabled, "user_id", "left_semi")
        .groupBy("project_id")
        .agg(F.count("*").alias("managers"))
        .orderBy("project_id")
    )


def upsert_memberships(memberships: DataFrame, changes: DataFrame) -> DataFrame:
    """Rights replaced where the membership exists, added where it does not."""
    key = ["user_id", "project_id"]
    new = changes.select(*key, F.col("can_demo").alias("__demo"), F.col("can_manage").alias("__manage"))
    return memberships.join(new, key, "full").select(
        *key,
        F.coalesce("__demo", "can_demo").alias("can_demo"),
        F.coalesce("__manage", "can_manage").alias("can_manage"),
    )
