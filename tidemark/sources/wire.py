"""Wire sources: JSON events and batch envelopes to columns.

A decoded row carries ``malformed`` (not decodable, unknown member or wrong JSON
type) beside the typed members, so nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal
from tidemark.functions.once import compute_once

# Wire member names, matched without case.
MEMBERS = (
    "eventid",
    "eventtype",
    "schemaversion",
    "occurredat",
    "userid",
    "anonymousid",
    "sessionid",
    "properties",
)
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMPTY_GUID = "00000000-0000-0000-0000-000000000000"
MAX_EVENT_BYTES = 32 * 1024
MAX_BATCH_BYTES = 1024 * 1024
MAX_BATCH_EVENTS = 100


def _with_members(frames: DataFrame, document: str) -> DataFrame:
    """Add ``__m``: members by lower-cased name; NULL for a non-object or names that differ only by case."""
    found = F.try_variant_get(F.col(document), "$", "map<string,variant>")
    named = compute_once(frames, __found=found)
    named = compute_once(named, __names=F.transform(F.map_keys("__found"), lambda k: F.lower(k)))
    distinct = F.size(F.array_distinct("__names")) == F.size("__names")
    members = F.when(distinct, F.map_from_arrays("__names", F.map_values("__found")))
    return compute_once(named, __m=members).drop("__found", "__names")


def decode_events(frames: DataFrame, value: str = "value") -> DataFrame:
    """One JSON event per row to typed columns (input columns are kept)."""
    raw = F.col(value)
    bones = F.col("__bones")
    single = F.regexp_replace(bones, r"^\{.*\}$", "{}") == "{}"
    numbers = F.regexp_extract_all(bones, F.lit(jsondoc.NUMBER), F.lit(0))
    opened = compute_once(
        compute_once(frames, __bones=jsondoc.skeleton(raw)),
        __doc=F.when(single, jsondoc.parsed(raw, bones)),
        oversize=F.octet_length(raw) > MAX_EVENT_BYTES,
        inexact=~F.forall(numbers, jsondoc.is_exact_number),
    )
    return _typed(_with_members(opened, "__doc")).drop("__bones", "__doc", "__m")


def _typed(opened: DataFrame) -> DataFrame:
    scalars = [name for name in MEMBERS if name != "properties"]

    def member(name: str) -> Column:
        return F.element_at("__m", F.lit(name))

    # VOID stands for an absent member or JSON null.
    kinds = {f"__kind_{n}": F.coalesce(F.schema_of_variant(member(n)), F.lit("VOID")) for n in scalars}
    texts = {f"__text_{n}": F.try_variant_get(member(n), "$", "string") for n in scalars}
    read = compute_once(opened, **kinds, **texts)
    members = compute_once(read, __occurred=temporal.parse_instant(F.col("__text_occurredat")))

    def kind(name: str) -> Column:
        return F.col(f"__kind_{name}")

    def as_text(name: str) -> Column:
        return F.col(f"__text_{name}")

    def text_or_null(name: str) -> Column:
        return kind(name).isin("STRING", "VOID")

    occurred = F.col("__occurred")
    absent_id = ~F.map_contains_key("__m", "eventid")
    absent_version = ~F.map_contains_key("__m", "schemaversion")
    sound = (
        F.forall(F.map_keys("__m"), lambda k: k.isin(*MEMBERS))
        & (absent_id | ((kind("eventid") == "STRING") & as_text("eventid").rlike(GUID)))
        & (absent_version | ((kind("schemaversion") == "BIGINT") & as_text("schemaversion").try_cast("int").isNotNull()))
        & text_or_null("eventtype")
        & text_or_null("userid")
        & text_or_null("anonymousid")
        & text_or_null("sessionid")
        & ((kind("occurredat") == "VOID") | ((kind("occurredat") == "STRING") & occurred.isNotNull()))
    )
    properties = member("properties")
    return compute_once(
        members,
        malformed=~F.coalesce(sound, F.lit(False)),
        event_id=F.coalesce(F.lower(as_text("eventid")), F.lit(EMPTY_GUID)),
        event_type=as_text("eventtype"),
        schema_version=F.coalesce(as_text("schemaversion").try_cast("int"), F.lit(0)),
        occurred_at=occurred,
        user_id=as_text("userid"),
        anonymous_id=as_text("anonymousid"),
        session_id=as_text("sessionid"),
        properties=F.when(~F.is_variant_null(properties), F.to_json(properties)),
    ).drop("__occurred", *kinds, *texts)


def is_event(document: Column) -> Column:
    """Whether a parsed document (variant) is an event by its members alone: no unknown one, each of its type. Ids need not be GUIDs."""

    def fits(entry: Column) -> Column:
        name, value = F.lower(entry["key"]), entry["value"]
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when(name == "eventid", kind == "STRING")
            .when(name.isin("eventtype", "userid", "anonymousid", "sessionid"), kind.isin("STRING", "VOID"))
            .when(name == "schemaversion", (kind == "BIGINT") & text.try_cast("int").isNotNull())
            .when(name == "occurredat", (kind == "VOID") | ((kind == "STRING") & temporal.parse_instant(text).isNotNull()))
            .otherwise(name == "properties")
        )

    members = F.map_entries(F.try_variant_get(document, "$", "map<string,variant>"))
    return F.coalesce(F.forall(members, fits), F.lit(False))


def explode_batches(batches: DataFrame, value: str = "value") -> DataFrame:
    """``{"events": [...]}`` envelopes to one row per event with ``ordinal`` and the raw event text.

    ``batch_error`` names an envelope fault (size, shape or count); such a batch
    yields one row without event text so that it can still be answered.
    Event text keeps exact numbers because they are made plain before parsing.
    """
    raw = F.col(value)
    doc = F.when(F.regexp_replace(jsondoc.skeleton(raw), r"^\{.*\}$", "{}") == "{}", jsondoc.parsed(raw))
    opened = _with_members(compute_once(batches, __doc=doc), "__doc")
    events = F.try_variant_get(F.element_at("__m", F.lit("events")), "$", "array<variant>")
    known = F.forall(F.map_keys("__m"), lambda k: k == "events")
    count_ok = F.size("__events").between(1, MAX_BATCH_EVENTS)
    sized = compute_once(opened, __events=events, __known=F.coalesce(known, F.lit(False))).withColumn(
        "batch_error",
        F.when(F.octet_length(raw) > MAX_BATCH_BYTES, F.lit("batch too large"))
        .when(~F.col("__known"), F.lit("malformed"))
        .when(~F.coalesce(count_ok, F.lit(False)), F.lit("events")),
    )
    one = F.array(F.lit(None).cast("variant"))
    return sized.select(
        *batches.columns,
        "batch_error",
        F.posexplode(F.when(F.col("batch_error").isNull(), F.col("__events")).otherwise(one)).alias("ordinal", "__item"),
    ).select(
        *batches.columns,
        "batch_error",
        "ordinal",
        F.when(~F.is_variant_null("__item"), F.to_json("__item")).alias("event"),
    )


def event_json(events: DataFrame) -> Column:
    """The wire form of canonical events, used by the publishing sink."""
    return F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"),
            F.col("event_type").alias("eventType"),
            F.col("schema_version").alias("schemaVersion"),
            temporal.iso_text(F.col("occurred_at")).alias("occurredAt"),
            F.col("user_id").alias("userId"),
            F.col("anonymous_id").alias("anonymousId"),
            F.col("session_id").alias("sessionId"),
            F.parse_json("properties").alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )
