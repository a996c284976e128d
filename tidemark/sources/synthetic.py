"""Deterministic synthetic events for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import temporal

TYPES = ("signup", "view_item", "purchase", "refund")  # fixed values: benchmark event types


def hash_guid(text):
    """A UUID-shaped id from SHA-256."""
    digest = F.sha2(text, 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def draw_events(numbered: DataFrame, number: str, seed: int, project: str = "synthetic", users: int = 1000) -> DataFrame:
    """One event per row of ``numbered``; every value is a hash of the number and the seed."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col(number).cast("string"))

    def pick(name: str, n: int):
        digest = F.sha2(F.concat_ws(":", key, F.lit(name)), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n))

    kind = F.element_at(F.array(*map(F.lit, TYPES)), (pick("type", len(TYPES)) + 1).cast("int"))
    amount = F.when(F.col("event_type") == "purchase", pick("amount", 9900) + 100).otherwise(pick("amount", 4900) + 100)
    rows = numbered.select(
        F.lit(project).alias("project_id"),
        hash_guid(key).alias("event_id"),
        kind.alias("event_type"),
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("user-"), pick("user", users)).alias("user_id"),
        F.lit(None).cast("string").alias("anonymous_id"),
        F.concat(F.lit("session-"), pick("session", users * 4)).alias("session_id"),
        temporal.from_micros(pick("time", 30 * 86_400) * 1_000_000 + F.lit(1_704_067_200_000_000)).alias("occurred_at"),
        F.col(number),
    )
    priced = rows.withColumn("received_at", F.col("occurred_at")).withColumn(
        "properties",
        F.when(
            F.col("event_type").isin("purchase", "refund"),
            F.concat(F.lit('{"amountMinor":'), amount, F.lit(',"currency":"USD"}')),
        ).otherwise(F.lit("{}")),
    )
    return priced.select(*schemas.struct(schemas.EVENTS).names)


def synthetic_events(spark: SparkSession, count: int, seed: int = 42, project: str = "synthetic") -> DataFrame:
    return draw_events(spark.range(count), "id", seed, project)
