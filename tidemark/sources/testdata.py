"""The driver's parquet tables as the engine's tables.

Every derivation is a fixed rule of the source row, so that the same table can be
stated in SQL. Tables the driver does not provide are derived from ``events``,
``customer`` and ``orders``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical, temporal
from tidemark.session import is_folder

NOW = datetime(2024, 2, 1)


class StreamingTables:
    """Passed in place of a session, it makes the derived event tables streams over the same files."""

    def __init__(self, spark: SparkSession, max_files: int | None = None):
        self.spark = spark
        self.max_files = max_files


def table(spark: SparkSession | StreamingTables, folder: str, name: str) -> DataFrame:
    if isinstance(spark, StreamingTables):
        session = spark.spark
        path = f"{folder}/{name}.parquet"
        reader = session.readStream.schema(session.read.parquet(path).schema)
        if spark.max_files:
            reader = reader.option("maxFilesPerTrigger", spark.max_files)
        if is_folder(session, path):
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _base(spark: SparkSession, folder: str) -> DataFrame:
    """Source events plus ``n`` (the number), ``u`` (the user) and ``k``."""
    money = "type IN ('purchase', 'refund')"
    return (
        table(spark, folder, "events")
        .selectExpr(
            "event_id AS n",
            "user_id AS u",
            "ts",
            "CASE WHEN event_type = 'error' THEN 'refund' ELSE event_type END AS type",
            "value",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        )
        .selectExpr(
            "n",
            "u",
            "k",
            "concat('p', u % 3) AS project_id",
            "lpad(CAST(n AS STRING), 12, '0') AS event_id",
            "type AS event_type",
            "1 AS schema_version",
            "CASE WHEN n % 10 <> 0 THEN concat('u', u) END AS user_id",
            "CASE WHEN n % 10 IN (0, 1) THEN concat('a', u) END AS anonymous_id",
            "CASE WHEN n % 7 <> 0 THEN concat('s', u, '-', date_format(ts, 'yyyy-MM-dd')) END AS session_id",
            "ts AS occurred_at",
            "ts + make_dt_interval(CASE WHEN n % 50 = 0 THEN 10 ELSE 0 END, 0, 0, n % 97) AS received_at",
            f"""concat('{{',
                CASE WHEN {money} THEN concat('"amountMinor":',
                    CASE WHEN k = 1 THEN '"x"' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END, ',') ELSE '' END,
                CASE WHEN {money} AND k <> 0 THEN concat('"currency":"', element_at(array('USD', 'EUR', 'VND'), CAST(k % 3 + 1 AS INT)), '",') ELSE '' END,
                '"k":', k, '}}') AS properties""",
        )
    )


EVENT_COLUMNS = [
    "project_id",
    "event_id",
    "event_type",
    "schema_version",
    "user_id",
    "anonymous_id",
    "session_id",
    "occurred_at",
    "received_at",
    "properties",
]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).select(*EVENT_COLUMNS)


def _with_payload(rows: DataFrame) -> DataFrame:
    """Canonical text of rows whose properties are canonical already."""
    payload = canonical.payload_text(
        F.col("event_id"),
        F.col("event_type"),
        F.col("schema_version"),
        F.col("occurred_at"),
        F.col("user_id"),
        F.col("anonymous_id"),
        F.col("session_id"),
        F.col("properties"),
    )
    return rows.withColumn("payload", payload)


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    return _with_payload(_base(spark, folder)).selectExpr(
        "project_id",
        "event_id",
        "payload",
        "received_at",
        "CASE WHEN n % 20 <> 0 THEN received_at + make_dt_interval(0, 0, 0, n % 13) END AS processed_at",
    )


def identity(spark: SparkSession, folder: str) -> DataFrame:
    return _with_payload(_base(spark, folder)).select(
        "project_id",
        "event_id",
        canonical.fingerprint(F.col("payload")).alias("payload_hash"),
        "occurred_at",
        "received_at",
        canonical.stored_bytes(F.col("payload")).alias("stored_bytes"),
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects seen in the events plus one that never sent any."""
    seen = _base(spark, folder).select("project_id").distinct()
    extra = spark.sql("SELECT 'p9' AS project_id")
    return seen.unionByName(extra).selectExpr(
        "project_id AS id",
        "CASE WHEN project_id = 'p1' THEN '' ELSE concat('Project ', project_id) END AS name",
        "CAST(0 AS BIGINT) AS event_count",
        "CAST(0 AS BIGINT) AS stored_bytes",
    )


def mirror_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Rows n % 33 = 1 were never enqueued, n % 33 = 0 are pending."""
    return (
        _base(spark, folder)
        .where("n % 33 <> 1")
        .selectExpr(
            "project_id",
            "event_id",
            "received_at AS created_at",
            "CASE WHEN n % 33 <> 0 THEN received_at + INTERVAL '2' SECOND END AS completed_at",
        )
    )


def mirror_events(spark: SparkSession, folder: str) -> DataFrame:
    """At-least-once copies: n % 5 = 0 was delivered again with a later version."""
    sent = _base(spark, folder).where("n % 33 > 1")
    first = sent.select(*EVENT_COLUMNS).withColumn("version", F.col("received_at"))
    again = (
        sent.where("n % 5 = 0")
        .select(*EVENT_COLUMNS)
        .withColumn("schema_version", F.lit(2))
        .withColumn("version", F.expr("received_at + INTERVAL '1' HOUR"))
    )
    return first.unionByName(again)


def outbox(spark: SparkSession, folder: str) -> DataFrame:
    """By n % 6: 0 new, 1 published, 2 and 3 completed, 4 retrying, 5 dead."""
    return _with_payload(_base(spark, folder)).selectExpr(
        "project_id",
        "event_id",
        "payload",
        "received_at AS created_at",
        "CASE WHEN n % 6 IN (1, 2, 3, 5) THEN received_at + INTERVAL '1' SECOND END AS published_at",
        "CASE WHEN n % 6 IN (2, 3) THEN received_at + INTERVAL '3' SECOND END AS completed_at",
        "received_at + make_dt_interval(0, 0, CASE WHEN n % 6 = 4 THEN 5 ELSE 0 END, 0) AS next_attempt_at",
        "CASE WHEN n % 6 = 5 THEN received_at + INTERVAL '1' HOUR END AS dead_lettered_at",
        "CAST(CASE WHEN n % 6 = 4 THEN n % 7 + 1 WHEN n % 6 = 5 THEN 8 ELSE 0 END AS INT) AS attempts",
        "CASE WHEN n % 6 IN (4, 5) THEN 'TimeoutException: broker did not confirm' END AS last_error",
    )


def broker_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failed deliveries of open outbox rows; every fifth one is permanent."""
    return (
        _base(spark, folder)
        .where("n % 6 IN (0, 1, 4)")
        .selectExpr(
            "project_id",
            "event_id",
            "CASE WHEN n % 5 = 0 THEN 'FormatException' ELSE 'IOException' END AS error_type",
            "concat('delivery ', n) AS message",
            "n % 5 = 0 AS permanent",
            "received_at + INTERVAL '1' DAY AS failed_at",
        )
    )


def broker_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered messages: n % 40 = 7 carries another event's payload, n % 40 = 9 names an unknown event, n % 40 = 11 is broken JSON,
    n % 40 = 13 has a member too many, n % 40 = 17 a version that is text."""
    return _with_payload(_base(spark, folder)).selectExpr(
        """to_json(named_struct(
            'project_id', project_id,
            'event_id', CASE WHEN n % 40 = 9 THEN concat('x', event_id) ELSE event_id END,
            'payload', CASE WHEN n % 40 = 7 THEN replace(payload, event_id, 'other')
                            WHEN n % 40 = 9 THEN replace(payload, event_id, concat('x', event_id))
                            WHEN n % 40 = 11 THEN substr(payload, 1, 20)
                            WHEN n % 40 = 13 THEN concat('{"more":1,', substr(payload, 2))
                            WHEN n % 40 = 17 THEN replace(payload, '"schemaVersion":1', '"schemaVersion":"1"') ELSE payload END)) AS value"""
    )


def event_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Version 1 of every (project, type) except clicks of p1."""
    return (
        _base(spark, folder)
        .where("NOT (project_id = 'p1' AND event_type = 'click')")
        .select("project_id", "event_type")
        .distinct()
        .selectExpr(
            "project_id",
            "event_type",
            "1 AS version",
            "'{}' AS definition",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at",
        )
    )


def saved_views(spark: SparkSession, folder: str) -> DataFrame:
    """One definition per customer."""
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "concat('p', c_custkey % 3) AS project_id",
        "CAST(c_custkey % 40 AS STRING) AS user_id",
        "c_name AS name",
        """concat('{"eventType":"', element_at(array('view', 'click', 'purchase'), CAST(c_custkey % 3 + 1 AS INT)), '"}') AS definition""",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS id", "c_name AS username", "c_custkey % 10 = 0 AS disabled"
    )


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS user_id",
        "concat('p', c_custkey % 3) AS project_id",
        "c_custkey % 2 = 0 AS can_demo",
        "c_custkey % 5 = 0 AS can_manage",
    )


def audit_records(spark: SparkSession, folder: str) -> DataFrame:
    """One administrative record per order."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) AS occurred_at",
        "concat('operator-', o_custkey % 20) AS actor",
        "concat('p', o_custkey % 3) AS project_id",
        "concat('order.', lower(o_orderpriority)) AS action",
        "CAST(o_custkey AS STRING) AS target",
        "'{}' AS details",
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Login attempts: one per event, with time squeezed so that windows fill up."""
    return (
        _base(spark, folder)
        .select(
            F.col("event_id").alias("attempt_id"),
            F.expr("concat(' User-', u % 7, ' ')").alias("username"),
            temporal.plus_micros(
                F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"),
                F.expr(
                    "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', occurred_at) div 500"
                ),
            ).alias("attempted_at"),
        )
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS line",
        "element_at(array('mug', 'tote', 'notebook', 'poster'), CAST(l_partkey % 4 + 1 AS INT)) AS product_id",
        "CAST(l_quantity AS INT) AS quantity",
    )


def catalogue(spark: SparkSession) -> DataFrame:
    # Price list in minor units.
    return spark.createDataFrame(
        [("mug", 2400), ("tote", 3200), ("notebook", 1800)], "product_id STRING, unit_price INT"
    )


def batch_frames(spark: SparkSession, folder: str) -> DataFrame:
    """One envelope text per ten events; four of twenty have a fault each."""
    ten = _base(spark, folder).groupBy(F.expr("n div 10").alias("batch")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    listed = "array_join(transform(ids, x -> concat('{\"eventId\":\"', x, '\"}')), ',')"
    return ten.select(
        "batch",
        F.expr(
            f"""CASE batch % 20 WHEN 1 THEN '{{"events":[]}}' WHEN 2 THEN concat('{{"events":[', {listed}, '],"more":1}}')
            WHEN 3 THEN concat('{{"events":[', array_join(array_repeat({listed}, 11), ','), ']}}')
            WHEN 4 THEN concat('{{"events":[', {listed}, ']}}', repeat(' ', 1048576))
            ELSE concat('{{"events":[', {listed}, ']}}') END"""
        ).alias("value"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of ten events, then redelivery batches.

    A redelivery batch repeats n % 5 = 0 (the type changed when n % 100 = 0: a
    conflict) and brings n % 10 = 3 again under a new id; n % 35 = 0 occurs twice
    within its first batch.
    """
    base = _base(spark, folder)
    first = base.withColumn("batch", F.expr("n div 10")).withColumn("ordinal", F.expr("CAST(n % 10 AS INT)"))
    repeat = first.where("n % 35 = 0").withColumn("ordinal", F.expr("ordinal + 10"))
    later = base.withColumn("batch", F.expr("n div 10 + 1000000000")).withColumn("ordinal", F.expr("CAST(n % 10 AS INT)"))
    again = later.where("n % 5 = 0").withColumn(
        "event_type", F.expr("CASE WHEN n % 100 = 0 THEN concat(event_type, '_changed') ELSE event_type END")
    )
    new = later.where("n % 10 = 3").withColumn("event_id", F.expr("concat('r', event_id)"))
    rows = first.unionByName(repeat).unionByName(again).unionByName(new)
    return _with_payload(rows).select(
        "project_id",
        F.expr("lpad(CAST(batch AS STRING), 12, '0')").alias("batch_id"),
        F.expr(
            "timestampadd(SECOND, CAST(batch % 1000000000 AS INT), TIMESTAMP_NTZ '2024-02-01 00:00:00') "
            "+ make_dt_interval(CASE WHEN batch >= 1000000000 THEN 400 ELSE 0 END)"
        ).alias("batch_at"),
        "ordinal",
        "event_id",
        canonical.fingerprint(F.col("payload")).alias("payload_hash"),
        canonical.stored_bytes(F.col("payload")).alias("stored_bytes"),
        "occurred_at",
        "event_type",
    )


def wire_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Raw JSON events with planted faults by n % 20, received with the event's receipt time; n % 400 = 14 is too large."""
    base = _base(spark, folder).withColumn(
        "guid",
        F.expr("concat('00000000-0000-4000-8000-', event_id)"),
    )
    fault = F.col("n") % 20
    type_text = (
        F.when(fault == 1, F.lit('"\\t "')).when(fault == 2, F.lit('5')).otherwise(F.expr("""concat('" ', event_type, '"')"""))
    )
    properties = (
        F.when(fault == 3, F.lit('{"a":{"Password":1}}'))
        .when(fault == 4, F.lit('{"a":{"b":{"c":{"d":1}}}}'))
        .when(fault == 5, F.lit('{"a":1.00000000000000000000000000001}'))
        .when(fault == 6, F.lit("[1]"))
        .when(fault == 7, F.lit('{"a":1,"a":2}'))
        .when(fault == 8, F.lit("null"))
        .when(fault == 9, F.lit('{"b":1.50e2,"a":[1.0,-0.0,"1.0"]}'))
        .otherwise(F.col("properties"))
    )
    return base.select(
        "n",
        "received_at",
        F.concat(
            F.when(fault == 10, F.lit('{"extra":1,')).otherwise(F.lit("{")),
            F.lit('"EventId":"'), F.col("guid"),
            F.lit('","eventType":'), type_text,
            F.lit(',"schemaVersion":'), F.when(fault == 11, F.lit("2")).otherwise(F.lit("1")),
            F.lit(',"occurredAt":"'), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('9Z"'),
            F.lit(',"userId":'), F.when(fault == 12, F.lit('""')).otherwise(F.expr("""coalesce(concat('"', user_id, '"'), 'null')""")),
            F.lit(',"properties":'), properties,
            F.when(fault == 13, F.lit("")).otherwise(F.lit("}")),
            F.when(F.col("n") % 400 == 14, F.repeat(F.lit(" "), F.lit(33_000))).otherwise(F.lit("")),
        ).alias("value"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted events as they come in."""
    return inbox(spark, folder).select(F.col("received_at").alias("at"), "project_id", "event_id", "payload")


def answering_broker(sent: DataFrame) -> DataFrame:
    """A broker's answers by event number and attempts: 3 of ten never fit, 5 and 6 come through at the third try, 7 never, 8 is not heard at first."""
    n = F.col("event_id").cast("bigint") % 10
    error = (
        F.when(n == 3, F.lit("FormatException"))
        .when(n.isin(5, 6) & (F.col("attempts") < 2), F.lit("IOException"))
        .when(n == 7, F.lit("TimeoutException"))
    )
    message = F.when(error.isNotNull(), F.concat(F.lit("event "), F.col("event_id")))
    heard = ~((n == 8) & (F.col("attempts") == 0))
    return sent.where(heard).select("project_id", "event_id", error.alias("error_type"), message.alias("message"))
