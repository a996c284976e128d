"""Registered queries: each runs one operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import canonical, text
from tidemark.operators import (
    admission,
    budgets,
    delivery,
    explorer,
    funnel,
    maintenance,
    mirror,
    registry,
    reports,
    retention,
    status,
    validation,
)
from tidemark.operators.filters import EventFilter
from tidemark.session import scratch_path, spread
from tidemark.sources import parts, store, stored, synthetic, wire
from tidemark.sources import testdata as td
from tidemark.streaming import broker, jobs

START, END, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1), td.NOW
WHOLE = EventFilter(start=START, end=END)
FEW_BUCKETS = 16  # the driver's tables are small
QUOTA = admission.Limits(max_project_events=2500, max_project_bytes=100 * 1024 * 1024)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


# Counts


@query
def event_summary(spark, sf):
    return reports.event_summary(td.events(spark, sf))


@query
def event_summary_filtered(spark, sf):
    scope = EventFilter(start=datetime(2024, 1, 3), end=datetime(2024, 1, 20), event_type="purchase")
    return reports.event_summary(td.events(spark, sf), scope)


@query
def user_summary(spark, sf):
    return reports.event_summary(td.events(spark, sf), EventFilter(user_id="u7"))


@query
def property_filter_summary(spark, sf):
    return reports.event_summary(td.events(spark, sf), EventFilter(property_name="k", property_value="5.0"))


@query
def property_filter_text(spark, sf):
    return reports.event_summary(td.events(spark, sf), EventFilter(property_name="currency", property_value='"EUR"'))


@query
def timeseries_hour(spark, sf):
    return reports.time_series(td.events(spark, sf), WHOLE, "hour")


@query
def timeseries_day(spark, sf):
    return reports.time_series(td.events(spark, sf), WHOLE, "day")


@query
def timeseries_dense_day(spark, sf):
    series = reports.time_series(td.events(spark, sf), WHOLE, "day")
    return reports.dense_series(series, START, END, "day")


@query
def timeseries_dense_hour(spark, sf):
    """Hourly totals of errors-turned-refunds only, so that some hours are empty."""
    scope = EventFilter(start=START, end=END, event_type="refund")
    return reports.dense_series(reports.time_series(td.events(spark, sf), scope, "hour"), START, END, "hour")


@query
def active_users(spark, sf):
    return reports.active_users(td.events(spark, sf), WHOLE)


@query
def event_share(spark, sf):
    return reports.event_share(reports.event_summary(td.events(spark, sf)))


# Product analytics


@query
def funnel_conversion(spark, sf):
    steps = ["view", "purchase", "refund"]
    return funnel.funnel(td.events(spark, sf), steps, START, END, timedelta(hours=6))


@query
def funnel_repeat_step(spark, sf):
    steps = ["view", "view", "click", "view"]
    return funnel.funnel(td.events(spark, sf), steps, START, END, timedelta(hours=48))


@query
def retention_cohorts(spark, sf):
    return retention.retention(
        td.events(spark, sf), date(2024, 1, 1), date(2024, 2, 1), "signup", "purchase", NOW
    )


@query
def sessions(spark, sf):
    return reports.sessions(td.events(spark, sf), START, END)


@query
def revenue_by_currency(spark, sf):
    return reports.revenue(td.events(spark, sf), START, END)


# Explorer


@query
def timeline_first_page(spark, sf):
    return explorer.timeline(td.events(spark, sf), EventFilter("p1", START, END), 50)


@query
def timeline_next_page(spark, sf):
    """The page after a cursor in the middle of the range."""
    scope = EventFilter("p1", START, END)
    after = explorer.Cursor(explorer.scope_hash(scope), datetime(2024, 1, 15), "000000000000")
    return explorer.timeline(td.events(spark, sf), scope, 100, after)


@query
def timeline_cursor(spark, sf):
    """The cursor after the first fifty events, and the place it is read as."""
    scope = EventFilter("p1", START, END)
    _, cursor = explorer.timeline_page(td.events(spark, sf), scope, 50)
    place = explorer.Cursor.decode(cursor, scope)
    return spark.createDataFrame([(cursor, place.at, place.event_id)], "cursor STRING, at TIMESTAMP_NTZ, event_id STRING")


@query
def timeline_by_day(spark, sf):
    """The same page from a table in days, of which it reads one or two."""
    events = stored.day_tables(spark, scratch_path(spark, "days"))["events"]
    events.append(stored.dated(td.events(spark, sf)))
    scope = EventFilter("p1", START, END)
    after = explorer.Cursor(explorer.scope_hash(scope), datetime(2024, 1, 15), "000000000000")
    rows = stored.timeline(events, scope, 100, after)
    return spark.createDataFrame(rows, events.read().select("project_id", *explorer.TIMELINE).schema)


@query
def subject_export(spark, sf):
    return explorer.subject_export(td.events(spark, sf), "p1", "u7")


# Admission


@query
def canonical_fingerprint(spark, sf):
    return canonical.canonicalize(td.events(spark, sf)).select(
        "project_id", "event_id", "payload_hash", "stored_bytes"
    )


@query
def validate_errors(spark, sf):
    decoded = wire.decode_events(spread(td.wire_frames(spark, sf)))
    checked = validation.validate(decoded, F.col("received_at"))
    return (
        checked.select(
            "n",
            "reject_reason",
            F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"),
        )
        .where("reject_reason IS NOT NULL")
        .withColumnRenamed("n", "source_event")
    )


@query
def wire_canonical(spark, sf):
    """Accepted wire events with their normalised type, time and properties."""
    decoded = wire.decode_events(spread(td.wire_frames(spark, sf)))
    accepted, _ = validation.split_accepted(validation.validate(decoded, F.col("received_at")))
    return canonical.canonicalize(accepted, parsed=True).select(
        F.col("n").alias("source_event"), "event_id", "event_type", "occurred_at", "user_id", "properties"
    )


@query
def browser_policy(spark, sf):
    """Wire events against the browser rule: allowed types and source only."""
    decoded = wire.decode_events(spread(td.wire_frames(spark, sf)))
    checked = validation.validate(decoded, F.col("received_at"), browser_only=True)
    failed = F.filter("errors", lambda e: e["field"].isin("properties.source", "eventType"))
    return (
        checked.where("NOT malformed")
        .select(F.explode(failed).alias("e"))
        .groupBy(F.col("e.field").alias("field"))
        .agg(F.count("*").alias("failures"))
    )


@query
def late_rejects(spark, sf):
    events = td.events(spark, sf)
    late = validation.AdmissionWindow().rejects(F.col("occurred_at"), F.col("received_at"))
    return events.where(late).select("project_id", "event_id", "occurred_at", "received_at")


@query
def dedup_first_arrival(spark, sf):
    marked = admission.first_arrivals(td.deliveries(spark, sf), ["batch_at", "batch_id", "ordinal"])
    return marked.select(
        "project_id", "batch_id", "ordinal", "event_id", F.col("first_received_at").alias("received_at"), "arrival"
    )


@query
def batch_conflicts(spark, sf):
    """In-batch conflicts when first and repeated deliveries of a block share one batch."""
    merged = td.deliveries(spark, sf).withColumn("batch_id", F.substring("batch_id", 4, 9)).withColumn(
        "batch_at", F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    )
    return admission.batch_conflicts(merged).select("project_id", "batch_id", "event_id", "copies")


@query
def identity_lookup(spark, sf):
    """Deliveries against the identity table."""
    state = admission.stored_state(td.deliveries(spark, sf), td.identity(spark, sf))
    return state.groupBy("project_id", "state").agg(F.count("*").alias("deliveries"))


@query
def batch_receipts(spark, sf):
    rows = td.deliveries(spark, sf)
    nothing = td.identity(spark, sf).where(F.lit(False))
    result = admission.admit(rows, nothing, limits=admission.NO_LIMITS)
    return result.receipts.select(
        "project_id", "batch_id", "ordinal", "event_id", "status", "received_at", "durability", "already_accepted"
    )


@query
def quota_admission(spark, sf):
    rows = td.deliveries(spark, sf)
    nothing = td.identity(spark, sf).where(F.lit(False))
    result = admission.admit(rows, nothing, limits=QUOTA)
    return result.decisions.select("project_id", "batch_id", "accepted", "reason")


@query
def deployment_quota(spark, sf):
    """Open outbox rows are limited over all projects together."""
    nothing = td.identity(spark, sf).where(F.lit(False))
    result = admission.admit(td.deliveries(spark, sf), nothing, limits=admission.Limits(None, None, max_outbox_pending=5000))
    return result.decisions.select("project_id", "batch_id", "accepted", "reason")


@query
def direct_receipts(spark, sf):
    nothing = td.identity(spark, sf).where(F.lit(False))
    result = admission.admit(td.deliveries(spark, sf), nothing, limits=admission.NO_LIMITS, mode="direct")
    return result.receipts.select("project_id", "batch_id", "ordinal", "event_id", "status", "received_at", "already_accepted")


@query
def admission_counters(spark, sf):
    """Delivered events by outcome of their batch."""
    rows = td.deliveries(spark, sf)
    nothing = td.identity(spark, sf).where(F.lit(False))
    return admission.counters(admission.admit(rows, nothing, limits=QUOTA).decisions, rows)


@query
def batch_envelopes(spark, sf):
    """Envelopes of ten events, with empty, foreign, overfull and oversized ones among them."""
    return wire.explode_batches(td.batch_frames(spark, sf)).select("batch", "batch_error", "ordinal", "event")


@query
def order_pricing(spark, sf):
    return validation.price_orders(td.orders(spark, sf), td.catalogue(spark))


# Status


@query
def processing_status(spark, sf):
    found = status.processing_status(td.inbox(spark, sf), td.identity(spark, sf), NOW)
    return found.withColumn("processing_p95_seconds", F.round("processing_p95_seconds", 6))


@query
def outbox_status(spark, sf):
    return status.outbox_status(td.outbox(spark, sf), NOW)


@query
def outbox_depth(spark, sf):
    return status.outbox_depth(td.outbox(spark, sf))


@query
def storage_report(spark, sf):
    return status.storage_report(td.inbox(spark, sf), td.identity(spark, sf))


@query
def latency_percentiles(spark, sf):
    return status.latency_percentiles(td.inbox(spark, sf))


@query
def throughput_summary(spark, sf):
    return status.throughput(td.inbox(spark, sf))


@query
def counters_overflow(spark, sf):
    """Accepted events per user with room for forty keys."""
    rows = td.events(spark, sf).where("user_id IS NOT NULL").withColumn("amount", F.lit(1))
    return status.bounded_counters(rows, "user_id", "amount", "received_at", max_series=40)


@query
def projected_by_project(spark, sf):
    return status.projected_counts(td.inbox(spark, sf).where("processed_at IS NOT NULL"))


@query
def inbox_claim(spark, sf):
    return status.inbox_claim(td.inbox(spark, sf)).select("project_id", "event_id", "received_at")


@query
def overview(spark, sf):
    parts = reports.overview(td.events(spark, sf), td.inbox(spark, sf), td.identity(spark, sf), WHOLE, NOW)
    none_text, none_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")

    def rows(part, frame, label, bucket, value):
        return frame.select(
            F.lit(part).alias("part"), "project_id", label.alias("label"), bucket.alias("bucket"), value.cast("bigint").alias("amount")
        )

    summary, series = parts["summary"], parts["series"]
    users, state = parts["users"], parts["status"]
    return (
        rows("summary", summary, F.col("event_type"), none_time, F.col("events"))
        .unionByName(rows("series", series, F.col("event_type"), F.col("bucket"), F.col("events")))
        .unionByName(rows("identified", users, none_text, none_time, F.col("identified_users")))
        .unionByName(rows("anonymous", users, none_text, none_time, F.col("anonymous_users")))
        .unionByName(rows("pending", state, none_text, F.col("last_received_at"), F.col("pending")))
    )


@query
def dataset_fingerprint(spark, sf):
    return status.dataset_fingerprint(td.events(spark, sf), td.identity(spark, sf), td.inbox(spark, sf))


# Maintenance


def _tables(spark, sf):
    return {
        "events": td.events(spark, sf),
        "inbox": td.inbox(spark, sf),
        "identity": td.identity(spark, sf),
        "mirror_queue": td.mirror_queue(spark, sf),
        "outbox": td.outbox(spark, sf),
        "projects": td.projects(spark, sf),
    }


def _sweep(spark, sf):
    return maintenance.retention_sweep(_tables(spark, sf), maintenance.RetentionPolicy(15, 20), NOW)


def _table_keys(result, names):
    frames = [result[n].select(F.lit(n).alias("table_name"), "project_id", "event_id") for n in names]
    return explorer.pages(frames)


@query
def retention_survivors(spark, sf):
    return _table_keys(_sweep(spark, sf), ["events", "inbox", "identity", "mirror_queue", "outbox"])


def _stored_tables(spark, sf):
    tables = stored.day_tables(spark, scratch_path(spark, "days"))
    events = td.events(spark, sf)
    for name, rows in _tables(spark, sf).items():
        if name in tables:
            tables[name].append(stored.dated(rows, None if name in ("events", "identity") else events))
    return tables


@query
def retention_in_place(spark, sf):
    """The survivors, from stored tables of which only expired days were touched."""
    tables = _stored_tables(spark, sf)
    stored.sweep(tables, maintenance.RetentionPolicy(15, 20), NOW)
    return _table_keys({n: t.read() for n, t in tables.items()}, ["events", "inbox", "identity", "mirror_queue", "outbox"])


@query
def retention_removed(spark, sf):
    return _sweep(spark, sf)["removed"].select("project_id", "event_id", "occurred_at")


@query
def retention_usage(spark, sf):
    return _sweep(spark, sf)["projects"]


@query
def project_usage(spark, sf):
    return maintenance.project_usage(td.projects(spark, sf), td.identity(spark, sf))


@query
def subject_erasure(spark, sf):
    result = maintenance.erase_subject(_tables(spark, sf), "p1", "u7")
    kept = [result[n].groupBy("project_id").agg(F.count("*").alias("amount")).select(F.lit(n).alias("table_name"), "project_id", "amount")
            for n in ("events", "inbox", "identity", "mirror_queue", "outbox", "erased")]
    return explorer.pages(kept)


@query
def subject_erasure_in_place(spark, sf):
    tables = _stored_tables(spark, sf)
    stored.erase(tables, "p1", "u7")
    kept = [t.read().groupBy("project_id").agg(F.count("*").alias("amount")).select(F.lit(n).alias("table_name"), "project_id", "amount") for n, t in tables.items()]
    return explorer.pages(kept)


@query
def audit_latest(spark, sf):
    return maintenance.audit_latest(td.audit_records(spark, sf), "p1")


# Mirror and delivery


@query
def mirror_latest(spark, sf):
    return mirror.latest(td.mirror_events(spark, sf)).select(
        "project_id", "event_id", "event_type", "schema_version", "version"
    )


@query
def mirror_counts(spark, sf):
    return mirror.counts_by_project(td.mirror_events(spark, sf))


@query
def mirror_pending(spark, sf):
    rows = mirror.pending(td.mirror_queue(spark, sf), td.events(spark, sf))
    return mirror.mirror_json(rows).select("yyyymm", "value")


@query
def mirror_backfill(spark, sf):
    found = mirror.backfill(td.mirror_queue(spark, sf), td.events(spark, sf), START, END, NOW)
    return found.select("project_id", "event_id", "created_at")


@query
def reconcile_buckets(spark, sf):
    return mirror.reconcile(td.events(spark, sf), td.mirror_events(spark, sf))


@query
def reconcile_projects(spark, sf):
    return mirror.reconcile(td.events(spark, sf), td.mirror_events(spark, sf), ["project_id"])


@query
def outbox_publish(spark, sf):
    return delivery.envelopes(td.outbox(spark, sf), NOW).select("project_id", "event_id", "value")


@query
def broker_deliveries(spark, sf):
    found = delivery.read_deliveries(td.broker_deliveries(spark, sf), td.outbox(spark, sf), td.inbox(spark, sf))
    return found.select("project_id", "event_id", "received_at", "error_type", "message")


@query
def outbox_transition(spark, sf):
    changed = delivery.record_failures(td.outbox(spark, sf), td.broker_failures(spark, sf), jitter=F.lit(0.5))
    return changed.drop("payload")


@query
def outbox_complete(spark, sf):
    sound = delivery.read_deliveries(
        td.broker_deliveries(spark, sf), td.outbox(spark, sf), td.inbox(spark, sf)
    ).where("error_type IS NULL")
    return delivery.complete(td.outbox(spark, sf), sound, NOW).select(
        "project_id", "event_id", "completed_at", "last_error"
    )


@query
def dead_letters(spark, sf):
    return delivery.dead_letters(td.outbox(spark, sf))


@query
def dead_letter_replay(spark, sf):
    reopened, _ = delivery.replay_dead_letters(td.outbox(spark, sf), NOW, project="p1")
    return reopened.drop("payload")


# Definitions and dimensions


@query
def schema_registry_gaps(spark, sf):
    return registry.schema_gaps(td.events(spark, sf), td.event_schemas(spark, sf))


@query
def schema_publish(spark, sf):
    """Publishing version 1 of every type seen: only the missing ones are new."""
    seen = td.events(spark, sf).select("project_id", "event_type").distinct()
    requested = seen.select("project_id", "event_type", F.lit(1).alias("version"), F.lit("{}").alias("definition"))
    fresh, refused = registry.publish_schemas(td.event_schemas(spark, sf), requested, NOW)
    return fresh.select("project_id", "event_type", "version", F.lit("published").alias("outcome")).unionByName(
        refused.select("project_id", "event_type", "version", F.lit("refused").alias("outcome"))
    )


@query
def saved_view_run(spark, sf):
    definition = '{"from":"2024-01-03T00:00:00","to":"2024-01-20T00:00:00","eventType":"view","propertyName":"k","propertyValue":"5"}'
    return reports.event_summary(registry.apply_view(td.events(spark, sf), definition))


@query
def saved_view_counts(spark, sf):
    return registry.view_counts(td.events(spark, sf), td.saved_views(spark, sf))


@query
def saved_view_upsert(spark, sf):
    """The table after one definition is saved again under another name."""
    row = {"id": "3", "project_id": "p0", "user_id": "3", "name": " North ", "definition": '{"eventType":"view"}'}
    return registry.save_view(td.saved_views(spark, sf), row, NOW)


@query
def saved_view_list(spark, sf):
    return registry.list_views(td.saved_views(spark, sf), "p1", "1").select("id", "name", "definition")


@query
def schema_list(spark, sf):
    return registry.list_schemas(td.event_schemas(spark, sf), "p1").select("event_type", "version", "definition")


@query
def audit_append(spark, sf):
    changes = td.audit_records(spark, sf).select("id", "project_id", F.repeat("target", 80).alias("target"), "details")
    return maintenance.audit_rows(changes, "operator", "order.change", NOW)


@query
def delivery_cycle(spark, sf):
    """Accepted, published, delivered, projected: the eligible messages go all the way."""
    outbox, inbox = td.outbox(spark, sf), td.inbox(spark, sf)
    messages = delivery.envelopes(outbox, NOW)
    published = delivery.mark_published(outbox, messages, NOW)
    delivered = delivery.read_deliveries(messages, published, inbox)
    sound = delivered.where(F.col("error_type").isNull())
    done, work = delivery.apply_deliveries(delivered, inbox, NOW)
    path = f"{scratch_path(spark, 'delivery')}/events"
    store.insert_absent(jobs.inbox_events(sound), path)
    key = ["project_id", "event_id"]
    return (
        store.read_events(spark, path).select(*key, "event_type", "occurred_at")
        .join(delivery.complete(published, sound, NOW).select(*key, "published_at", "completed_at"), key)
        .join(done.select(*key, "processed_at"), key)
        .join(work.select(*key, F.lit(True).alias("mirrored")), key, "left")
        .withColumn("mirrored", F.coalesce("mirrored", F.lit(False)))
    )


@query
def outbox_claim(spark, sf):
    """The next hundred messages, marked as published."""
    outbox = td.outbox(spark, sf)
    return delivery.mark_published(outbox, delivery.claim(outbox, NOW), NOW).where(F.col("published_at") == F.lit(NOW)).select("project_id", "event_id", "published_at", "last_error")


@query
def project_catalog(spark, sf):
    return registry.project_catalog(td.projects(spark, sf), td.memberships(spark, sf))


@query
def member_roster(spark, sf):
    return registry.roster(td.memberships(spark, sf), td.users(spark, sf), "p1")


@query
def project_managers(spark, sf):
    return registry.managers(td.memberships(spark, sf), td.users(spark, sf))


@query
def membership_upsert(spark, sf):
    """Every third customer gets rights in the next project; existing rows are replaced."""
    changes = td.memberships(spark, sf).selectExpr(
        "user_id", "CASE WHEN user_id % 2 = 0 THEN project_id ELSE 'p9' END AS project_id", "true AS can_demo", "can_manage"
    )
    return registry.upsert_memberships(td.memberships(spark, sf), changes)


@query
def membership_upsert_stored(spark, sf):
    """The same changes to a stored table, of which only the parts with changes are written."""
    def placed(rows):
        return rows.withColumn(parts.PART, parts.bucket(["user_id"], FEW_BUCKETS))

    table = parts.Parts(spark, f"{scratch_path(spark, 'members')}/memberships", schemas.MEMBERSHIPS)
    table.append(placed(td.memberships(spark, sf)))
    changes = td.memberships(spark, sf).selectExpr(
        "user_id", "CASE WHEN user_id % 2 = 0 THEN project_id ELSE 'p9' END AS project_id", "true AS can_demo", "can_manage"
    )
    parts.upsert(table, placed(changes), ["user_id", "project_id"])
    return table.read().drop(parts.PART)


@query
def account_buckets(spark, sf):
    return td.users(spark, sf).select("id", text.account_bucket(F.col("username")).alias("bucket"))


@query
def attempt_budget(spark, sf):
    decided = budgets.acquire(td.attempts(spark, sf), global_limit=12, bucket_limit=3)
    return decided.select("attempt_id", "bucket", "attempted_at", "allowed")


@query
def request_budget(spark, sf):
    return budgets.request_budget(td.events(spark, sf), ["project_id"], "received_at", 2)


@query
def synthetic_events(spark, sf):
    numbered = td.table(spark, sf, "events").selectExpr("event_id AS number")
    return synthetic.draw_events(numbered, "number", 42).select(
        "event_id", "event_type", "user_id", "session_id", "occurred_at", "properties"
    )


# Streaming


def _raw_stream(spark, sf, derive):
    return derive(td.StreamingTables(spark), sf)


@query
def stream_project_inbox(spark, sf):
    root = scratch_path(spark, "stream-inbox")
    stream = _raw_stream(spark, sf, td.inbox)
    jobs.project_inbox(stream, f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return store.read_events(spark, f"{root}/events").drop("occurred_date")


@query
def stream_dedup(spark, sf):
    root = scratch_path(spark, "stream-dedup")
    stream = _raw_stream(spark, sf, td.deliveries).withColumn("received_at", F.col("batch_at"))
    keys = stream.select("project_id", "event_id", "received_at")
    jobs.deduplicate(keys, f"{root}/events", f"{root}/checkpoint", key_buckets=FEW_BUCKETS).awaitTermination()
    return spark.read.parquet(f"{root}/events").select("project_id", "event_id")


@query
def stream_mirror(spark, sf):
    root = scratch_path(spark, "stream-mirror")
    jobs.mirror_events(_raw_stream(spark, sf, td.events), f"{root}/mirror", f"{root}/checkpoint").awaitTermination()
    return store.read_mirror(spark, f"{root}/mirror").select("project_id", "event_id", "event_type", "version")


@query
def stream_event_counts(spark, sf):
    root = scratch_path(spark, "stream-counts")
    jobs.event_counts(_raw_stream(spark, sf, td.events), f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return jobs.latest_counts(spark, f"{root}/counts")


@query
def stream_attempt_budget(spark, sf):
    root = scratch_path(spark, "stream-budget")
    jobs.attempt_budget(_raw_stream(spark, sf, td.attempts), root, f"{root}/checkpoint", limit=3, global_limit=12).awaitTermination()
    return spark.read.parquet(f"{root}/decisions").select("attempt_id", "bucket", "allowed")


@query
def stream_mirror_merged(spark, sf):
    """The mirror in months, each micro-batch writing only those it has events of."""
    root = scratch_path(spark, "stream-mirror")
    jobs.merge_mirror(_raw_stream(spark, sf, td.events), f"{root}/mirror", f"{root}/checkpoint").awaitTermination()
    return store.read_merged_mirror(spark, f"{root}/mirror").select("project_id", "event_id", "event_type", "version")


@query
def identity_lookup_bucketed(spark, sf):
    """Deliveries against identities that lie in hash buckets of their keys."""
    identities = store.key_table(spark, f"{scratch_path(spark, 'identity')}/identity", schemas.IDENTITY)
    identities.append(store.bucketed(td.identity(spark, sf), FEW_BUCKETS))
    rows = td.deliveries(spark, sf)
    state = admission.stored_state(rows, store.matching(identities, rows, buckets=FEW_BUCKETS))
    return state.groupBy("project_id", "state").agg(F.count("*").alias("deliveries"))


DELIVERY_TICKS = [datetime(2024, 2, 12), datetime(2024, 2, 12, 0, 0, 3), datetime(2024, 2, 19)]


def _delivery_run(spark, sf, root):
    """Four weeks of arrivals and three moments without any, one micro-batch each, at most four attempts."""
    arrivals = td.arrivals(spark, sf)
    edges = [None, datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22), None]
    for low, high in zip(edges, edges[1:]):
        week = arrivals if low is None else arrivals.where(F.col("at") >= F.lit(low))
        week = week if high is None else week.where(F.col("at") < F.lit(high))
        week.coalesce(1).write.mode("append").parquet(f"{root}/arrivals")  # a file is a micro-batch
    for moment in DELIVERY_TICKS:
        tick = spark.createDataFrame([(moment, None, None, None)], arrivals.schema)
        tick.coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    schema = "at TIMESTAMP_NTZ, project_id STRING, event_id STRING, payload STRING"
    stream = jobs.table_stream(spark, f"{root}/arrivals", schema, max_files=1)
    return broker.deliver(stream, root, f"{root}/checkpoint", td.answering_broker, max_attempts=4, jitter=F.lit(0.5))


@query
def stream_delivery(spark, sf):
    root = scratch_path(spark, "stream-delivery")
    _delivery_run(spark, sf, root).awaitTermination()
    return broker.outbox_now(spark, root).drop("payload")


@query
def stream_gauges(spark, sf):
    """How the outbox stood after each micro-batch, beside what the query's listener stored."""
    root = scratch_path(spark, "stream-gauges")
    with broker.observed_gauges(spark, f"{root}/observed") as listener:
        listener.await_end(_delivery_run(spark, sf, root))
    observed = broker.read_observed(spark, f"{root}/observed").where("metric = 'arrivals.events'")
    return broker.gauges(spark, root).join(observed.select("batch", "input_rows", F.col("value").cast("bigint").alias("observed")), "batch")
