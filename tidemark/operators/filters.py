"""Report scope: tenant, half-open UTC window, event type, user and one property."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsondoc

MAX_REPORT_DAYS = 31


def utc(moment: datetime | None) -> datetime | None:
    """Naive UTC, the form TIMESTAMP_NTZ literals take."""
    if moment is not None and moment.tzinfo is not None:
        return moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def at(moment: datetime):
    return F.lit(utc(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def _control(text: str) -> bool:
    return any(ord(ch) < 32 or 127 <= ord(ch) < 160 for ch in text)


@dataclass(frozen=True)
class EventFilter:
    """``project=None`` means every tenant; reports then give one result per project."""

    project: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    event_type: str | None = None
    user_id: str | None = None
    property_name: str | None = None
    property_value: str | None = None

    def errors(self) -> dict[str, str]:
        found: dict[str, str] = {}
        start, end = utc(self.start), utc(self.end)
        if start and end and start > end:
            found["from"] = "The window [from, to) must not end before it begins."
        for name, value, limit in (("eventType", self.event_type, 100), ("userId", self.user_id, 200)):
            if value is not None and not (value.strip() and len(value) <= limit):
                found[name] = f"Needs 1 to {limit} characters."
        if (self.property_name is None) != (self.property_value is None):
            found["propertyName"] = "Provide both propertyName and propertyValue."
        name = self.property_name
        if name is not None and (not name.strip() or len(name) > 100 or _control(name)):
            found["propertyName"] = "Names one key of the properties, 1 to 100 characters long."
        if self.property_value is not None:
            try:
                jsondoc.parse_scalar(self.property_value)
            except (ValueError, ArithmeticError):
                found["propertyValue"] = (
                    "Must be one JSON value that is no array or object, of 4096 characters at most."
                )
        return found

    def check(self, window_required: bool = False, max_days: int = MAX_REPORT_DAYS) -> EventFilter:
        found = self.errors()
        if window_required:
            found.update(window_errors(self.start, self.end, max_days))
        if found:
            raise ValueError(found)
        return self

    def apply(self, events: DataFrame) -> DataFrame:
        """Only the predicates that are set, so that each one can prune partitions or reach the scan."""
        self.check()
        if self.project is not None:
            events = events.where(F.col("project_id") == self.project)
        events = in_window(events, self.start, self.end)
        if self.event_type is not None:
            events = events.where(F.col("event_type") == self.event_type)
        if self.user_id is not None:
            events = events.where(F.col("user_id") == self.user_id)
        if self.property_name is not None:
            events = events.where(jsondoc.member_equals(F.col("properties"), self.property_name, self.property_value))
        return events

    def interval(self) -> str:
        """Hour buckets up to two days, day buckets beyond."""
        return "hour" if utc(self.end) - utc(self.start) <= timedelta(days=2) else "day"

    def scope(self) -> dict:
        fields = asdict(self)
        for name in ("start", "end"):
            fields[name] = fields[name] and utc(fields[name]).isoformat()
        return fields


def window_errors(start: datetime | None, end: datetime | None, max_days: int = MAX_REPORT_DAYS) -> dict[str, str]:
    start, end = utc(start), utc(end)
    if start is None or end is None or end <= start or end - start > timedelta(days=max_days):
        return {"from": f"Choose a UTC date range greater than zero and at most {max_days} days."}
    return {}


def in_window(events: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Half-open [start, end) in event time; also prunes ``occurred_date`` folders when the table has them."""
    dated = "occurred_date" in events.columns
    if start is not None:
        events = events.where(F.col("occurred_at") >= at(start))
        if dated:
            events = events.where(F.col("occurred_date") >= F.lit(utc(start).date()))
    if end is not None:
        events = events.where(F.col("occurred_at") < at(end))
        if dated:
            events = events.where(F.col("occurred_date") <= F.lit(utc(end).date()))
    return events


def scoped(events: DataFrame, project: str | None, start: datetime | None, end: datetime | None) -> DataFrame:
    return EventFilter(project, start, end).apply(events)
