"""Field rules for decoded events. Every rule is a column; no row is lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal, text
from tidemark.functions.once import compute_once
from tidemark.sources import wire

BROWSER_TYPES = ("page_view", "login", "checkout_started")  # fixed values: browser activity
PROPERTY_RULE = (
    "Properties nest four levels deep at most and hold up to 64 entries in all; keys are distinct, 1 to 100 characters long and "
    "name no credentials; texts have up to 2048 characters; numbers are exact decimals."
)


@dataclass(frozen=True)
class AdmissionWindow:
    """How late and how early an event may be, relative to its receipt."""

    max_late_days: float = 7
    max_future_minutes: float = 5

    def __post_init__(self):
        if not (0 <= self.max_late_days <= 365 and 0 <= self.max_future_minutes <= 1440):
            raise ValueError("The lateness window is 0 to 365 days, the lead 0 to 1440 minutes.")

    def rejects(self, occurred_at: Column, received_at: Column) -> Column:
        earliest = temporal.plus_micros(received_at, F.lit(-int(self.max_late_days * 86_400_000_000)))
        latest = temporal.plus_micros(received_at, F.lit(int(self.max_future_minutes * 60_000_000)))
        return occurred_at.isNull() | (occurred_at < earliest) | (occurred_at > latest)


def _error(condition: Column, field: str, message: str) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def field_errors(received_at: Column, window: AdmissionWindow = AdmissionWindow(), browser_only: bool = False) -> Column:
    """ARRAY<STRUCT<field, message>> for one decoded event with ``__outline``, empty when it is valid."""
    properties = F.col("properties")
    is_object = F.coalesce(properties.rlike(r"^\s*\{"), F.lit(False))
    inexact = F.coalesce(F.col("inexact"), F.lit(False))
    label = "Needs 1 to 100 characters, none of them a control character."
    identity = "Either null, or 1 to 200 characters, none of them a control character."
    rules = [
        _error(F.col("event_id") == wire.EMPTY_GUID, "eventId", "A nonempty UUID is required; reuse it on retries."),
        _error(text.bad_label(F.col("event_type"), 100), "eventType", label),
        _error(F.col("schema_version") != 1, "schemaVersion", "Only schemaVersion 1 is supported."),
        _error(
            window.rejects(F.col("occurred_at"), received_at),
            "occurredAt",
            "A timestamp within the configured lateness/future window is required.",
        ),
        _error(text.bad_identity(F.col("user_id")), "userId", identity),
        _error(text.bad_identity(F.col("anonymous_id")), "anonymousId", identity),
        _error(text.bad_identity(F.col("session_id")), "sessionId", identity),
        _error(properties.isNotNull() & ~is_object, "properties", "Properties must be an object."),
        _error(is_object & (inexact | ~jsondoc.document_ok(properties, F.col("__outline"))), "properties", PROPERTY_RULE),
    ]
    if browser_only:
        source = F.coalesce(jsondoc.member_equals(properties, "source", '"browser"'), F.lit(False))
        rules += [
            _error(
                ~F.coalesce(F.col("event_type").isin(*BROWSER_TYPES), F.lit(False)),
                "eventType",
                "Browsers may not send this type; a server reports purchases.",
            ),
            _error(~(is_object & source), "properties.source", "Browser events must identify source=browser."),
        ]
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def validate(
    decoded: DataFrame,
    received_at: Column,
    window: AdmissionWindow = AdmissionWindow(),
    browser_only: bool = False,
) -> DataFrame:
    """Add ``errors`` and ``reject_reason``: size, then shape, then field rules."""
    outlined = compute_once(decoded, __outline=jsondoc.skeleton(F.col("properties")))
    checked = compute_once(outlined, errors=field_errors(received_at, window, browser_only)).drop("__outline")
    return checked.withColumn(
        "reject_reason",
        F.when(F.col("oversize"), F.lit("size"))
        .when(F.col("malformed"), F.lit("malformed"))
        .when(F.size("errors") > 0, F.lit("validation")),
    )


def split_accepted(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows, together exactly the input."""
    return (
        validated.where(F.col("reject_reason").isNull()),
        validated.where(F.col("reject_reason").isNotNull()),
    )


def price_orders(orders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue price times quantity; an unknown product or a quantity outside 1..10 is invalid.

    The catalogue is a dimension; Spark broadcasts it when its measured size allows.
    """
    priced = orders.join(catalogue, "product_id", "left")
    valid = F.col("unit_price").isNotNull() & F.col("quantity").between(1, 10)
    return priced.select(
        *orders.columns,
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, F.col("unit_price") * F.col("quantity")).cast("bigint").alias("amount_minor"),
        F.when(valid, F.lit("USD")).alias("currency"),
    )
