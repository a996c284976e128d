"""Parquet layouts of the engine's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import mirror
from tidemark.session import materialize, scratch_space
from tidemark.sources import parts

EVENT = ["project_id", "event_id"]
KEY_BUCKETS = 256
PUSHED_KEYS = 1000
# Bloom filters let a lookup skip the row groups that hold none of its ids; their size follows the ids.
BLOOM = {"parquet.bloom.filter.enabled#event_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "1048576"}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one when nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EVENTS + ", occurred_date DATE")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Folders by UTC day; rows of a project and type lie together so row groups can be skipped."""
    (
        events.withColumn("occurred_date", F.to_date("occurred_at"))
        .select(*schemas.struct(schemas.EVENTS).names, "occurred_date")
        .repartitionByRange("occurred_date", "project_id", "event_type", "occurred_at")
        .sortWithinPartitions("occurred_date", "project_id", "event_type", "occurred_at")
        .write.mode(mode)
        .partitionBy("occurred_date")
        .parquet(path)
    )


def insert_absent(batch: DataFrame, path: str) -> None:
    """Append the events of a batch that the table does not hold.

    Only the batch's own days are compared, so the same event
    must carry the same time. Admission sees to that: the time is part of the
    fingerprint, and an id with another fingerprint is refused. Repeating a batch
    adds nothing.
    """
    spark = batch.sparkSession
    rest = [c for c in schemas.struct(schemas.EVENTS).names if c not in EVENT]
    one = batch.groupBy(*EVENT).agg(F.min(F.struct("received_at", *[c for c in rest if c != "received_at"])).alias("__row"))
    rows = one.select(*EVENT, *[F.col(f"__row.{c}").alias(c) for c in rest]).withColumn(
        "occurred_date", F.to_date("occurred_at")
    )
    with scratch_space(spark, "insert") as space:
        rows = materialize(rows, "batch", space)
        days = [r["occurred_date"] for r in rows.select("occurred_date").distinct().collect()]
        if not days:
            return
        known = read_events(spark, path).where(F.col("occurred_date").isin(days))
        # Written before the table grows: the table is read here.
        fresh = materialize(rows.join(known.select(*EVENT, "occurred_date"), [*EVENT, "occurred_date"], "left_anti"), "fresh", space)
        write_events(fresh, path)


def key_table(spark: SparkSession, path: str, schema: str) -> parts.Parts:
    """A table with a row per event key, in hash buckets of the key."""
    return parts.Parts(spark, path, schema, options=BLOOM)


def bucketed(rows: DataFrame, buckets: int = KEY_BUCKETS) -> DataFrame:
    return rows.withColumn(parts.PART, parts.bucket(EVENT, buckets))


def matching(table: parts.Parts, keys: DataFrame, before: tuple[str, int] | None = None, buckets: int = KEY_BUCKETS, pushed: int = PUSHED_KEYS) -> DataFrame:
    """The table's rows that may have one of the keys: every such row, and few others.

    Only the keys' buckets are read. A micro-batch of few keys also pushes its ids to the scan, where statistics and Bloom
    filters skip row groups; one of many keys is left to the join.
    """
    keys = bucketed(keys.select(*EVENT).distinct(), buckets)
    some = keys.limit(pushed + 1).collect()  # bounded: ids are pushed only up to this number
    if len(some) > pushed:
        return table.read(parts.touched(keys), before)
    found = table.read({r[parts.PART] for r in some}, before)
    return found.where(F.col("event_id").isin([r["event_id"] for r in some]))


def append_mirror(events: DataFrame, path: str) -> None:
    """Versioned copies in month folders; delivery is at least once, reads use ``mirror.latest``."""
    mirror.mirror_rows(events).select(*schemas.struct(schemas.MIRROR_EVENTS).names, "yyyymm").write.mode(
        "append"
    ).partitionBy("yyyymm").parquet(path)


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    return mirror.latest(read_table(spark, path, schemas.MIRROR_EVENTS))


def mirror_table(spark: SparkSession, path: str) -> parts.Parts:
    """The mirror in months; merges of a month's folders keep the latest version of each event."""

    def newest(rows: DataFrame) -> DataFrame:
        return mirror.latest(rows)

    return parts.Parts(spark, path, schemas.MIRROR_EVENTS, combine=newest)


def merge_mirror(events: DataFrame, path: str, writer: str | None = None, number: int = 0) -> None:
    """Versioned copies of a batch to their months; other months are neither read nor written."""
    rows = mirror.latest(mirror.mirror_rows(events)).withColumn(parts.PART, F.col("yyyymm").cast("string"))
    mirror_table(events.sparkSession, path).append(rows, writer, number)


def read_merged_mirror(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each event, over the few folders that each month has."""
    return mirror_table(spark, path).reduced().drop(parts.PART)


def write_mirror_json(events: DataFrame, path: str) -> None:
    mirror.mirror_json(events).write.mode("append").partitionBy("yyyymm").text(path)


def write_version(table: DataFrame, root: str, version: str) -> str:
    """A new version of a table beside the old ones; readers switch to the returned folder."""
    path = f"{root}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def append(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)
