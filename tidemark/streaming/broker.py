"""The outbox as a running job: publish what is due, hear the broker's answers, retry, give up, and show how it stands.

Open messages and finished ones are one table in parts: ``open`` holds the former and is rewritten by every micro-batch, finished
messages go to the day they were finished on. Both change in one commit. So a micro-batch reads the open messages and
no others, and a repeated one starts from what it found before.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tidemark import schemas
from tidemark.functions import temporal
from tidemark.operators import delivery
from tidemark.operators.filters import at
from tidemark.session import materialize, scratch_space
from tidemark.sources import parts, store
from tidemark.streaming.jobs import EVENT, inbox_events, run_steps

OPEN = "open"
GAUGES = (
    "batch BIGINT, at TIMESTAMP_NTZ, arrived BIGINT, published BIGINT, delivered BIGINT, failed BIGINT, dead_lettered BIGINT, "
    "outbox_pending BIGINT, outbox_retrying BIGINT, outbox_oldest_seconds DOUBLE, inbox_pending BIGINT"
)
OBSERVED = "query STRING, batch BIGINT, input_rows BIGINT, metric STRING, value STRING"


def outbox_table(spark: SparkSession, root: str) -> parts.Parts:
    return parts.Parts(spark, f"{root}/outbox", schemas.OUTBOX)


def gauge_table(spark: SparkSession, root: str) -> parts.Parts:
    return parts.Parts(spark, f"{root}/gauges", GAUGES)


def deliver(
    arrivals: DataFrame,
    root: str,
    checkpoint: str,
    broker: Callable[[DataFrame], DataFrame],
    max_attempts: int = delivery.MAX_ATTEMPTS,
    jitter: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Accepted events to the event table by way of a broker, at least once, each stored once.

    ``arrivals`` has ``at, project_id, event_id, payload``: newly accepted inbox rows, and rows without an event that only let time
    pass (a rate source will do). The latest ``at`` of a micro-batch is its time. Messages due by then go to ``broker``, which takes
    ``project_id, event_id, value, attempts`` and answers ``project_id, event_id, error_type, message``, the error being null where it
    delivered; a message without an answer counts as a failed attempt. Delivered events are stored and leave mirror work; errors that no retry repairs, and
    too many attempts, end as dead letters; all others come due again later. Events whose message is open already are not enqueued again.

    Below ``root``: ``outbox``, ``events``, ``mirror_queue`` by micro-batch, and ``gauges``, a row per micro-batch.
    """

    outbox, gauge = outbox_table(arrivals.sparkSession, root), gauge_table(arrivals.sparkSession, root)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, change = batch.sparkSession, (checkpoint, batch_id)
        with scratch_space(spark, "deliver") as space:
            came = materialize(batch.select("at", *EVENT, "payload"), "arrivals", space)
            now = came.agg(F.max("at").alias("now")).first()["now"]
            if now is None:
                return
            waiting = outbox.read([OPEN], before=change).drop(parts.PART)
            news = came.where(F.col("event_id").isNotNull()).groupBy(*EVENT).agg(F.min(F.struct(F.col("at").alias("received_at"), "payload")).alias("__m"))
            news = news.select(*EVENT, "__m.*").join(waiting.select(*EVENT), EVENT, "left_anti")
            state = materialize(waiting.unionByName(delivery.enqueue(news)), "open", space)
            due = state.where(delivery.eligible(now))
            sent = due.select(*EVENT, F.to_json(F.struct(*EVENT, "payload")).alias("value"), "attempts")
            answers = broker(sent).select(*EVENT, "error_type", "message").groupBy(*EVENT).agg(F.min(F.struct(F.col("error_type").isNotNull().alias("failed"), "error_type", "message")).alias("__a"))
            silent = F.col("__a").isNull()
            heard = materialize(
                due.select(*EVENT).join(answers, EVENT, "left").select(
                    *EVENT,
                    F.when(silent, F.lit("TimeoutException")).otherwise(F.col("__a.error_type")).alias("error_type"),
                    F.when(silent, F.lit("The broker did not answer.")).otherwise(F.col("__a.message")).alias("message"),
                ),
                "answers", space,
            )
            sound = heard.where(F.col("error_type").isNull()).select(*EVENT)
            failures = heard.where(F.col("error_type").isNotNull()).select(
                *EVENT, "error_type", "message", F.col("error_type").isin(*delivery.PERMANENT_ERRORS).alias("permanent"), at(now).alias("failed_at")
            )
            stored = state.join(sound, EVENT, "left_semi").select(*EVENT, "payload", F.col("created_at").alias("received_at"))
            store.insert_absent(inbox_events(stored), f"{root}/events")
            work = stored.select(*EVENT, at(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
            work.write.mode("overwrite").parquet(f"{root}/mirror_queue/batch={batch_id}")
            after = delivery.mark_published(state, due, now)
            after = delivery.record_failures(delivery.complete(after, sound, now), failures, max_attempts, jitter)
            finished = F.coalesce("completed_at", "dead_lettered_at")
            after = materialize(after.withColumn(parts.PART, F.coalesce(F.date_format(finished, "yyyy-MM-dd"), F.lit(OPEN))), "after", space)
            is_open = F.col(parts.PART) == OPEN
            figures = after.agg(
                F.count_if(F.col("completed_at").isNotNull()).alias("delivered"),
                F.count_if(F.col("dead_lettered_at").isNotNull()).alias("dead_lettered"),
                F.count_if(is_open).alias("outbox_pending"),
                F.count_if(is_open & (F.col("attempts") > 0)).alias("outbox_retrying"),
                temporal.seconds_between(at(now), F.min(F.when(is_open, F.col("created_at")))).alias("outbox_oldest_seconds"),
            ).first().asDict()
            figures |= heard.agg(F.count("*").alias("published"), F.count("error_type").alias("failed")).first().asDict()
            figures["arrived"] = state.count() - waiting.count()
            past = gauge.read(before=change).agg(F.sum(F.col("arrived") - F.col("delivered")).alias("n")).first()["n"] or 0
            # An event's inbox row is pending until its message has been delivered; a dead letter's stays so.
            figures |= {"batch": batch_id, "at": now, "inbox_pending": past + figures["arrived"] - figures["delivered"]}
            row = spark.createDataFrame([tuple(figures[c] for c in gauge.columns)], GAUGES)
            gauge.append(row.withColumn(parts.PART, F.date_format("at", "yyyy-MM")), *change)
            outbox.change(after, [OPEN], *change)  # last: what came before is repeated from the same state

    seen = arrivals.observe("arrivals", F.count("event_id").alias("events"), F.max("at").alias("at"))
    return run_steps(seen, checkpoint, step, trigger)


def outbox_now(spark: SparkSession, root: str) -> DataFrame:
    """The outbox, open and finished messages."""
    return outbox_table(spark, root).read().drop(parts.PART)


def gauges(spark: SparkSession, root: str) -> DataFrame:
    """One row per micro-batch: depth, oldest age, retries and what was done."""
    return gauge_table(spark, root).read().drop(parts.PART)


class GaugeListener(StreamingQueryListener):
    """Writes what queries observe (``DataFrame.observe``) as a table: one folder per query, each micro-batch once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}
        self.failure: Exception | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        try:
            progress = event.progress
            name_ = progress.name or str(progress.id)
            rows = [(name_, progress.batchId, progress.numInputRows, None, None)]
            for name, observed in progress.observedMetrics.items():
                shown = observed.asDict() if observed is not None else {}
                rows += [(name_, progress.batchId, progress.numInputRows, f"{name}.{k}", None if v is None else str(v)) for k, v in shown.items()]
            folder = f"{self.path}/of={progress.id}/batch={progress.batchId}"
            self.spark.createDataFrame(rows, OBSERVED).coalesce(1).write.mode("overwrite").parquet(folder)
        except Exception as error:  # a listener must not end the query; the reader is told
            self.failure = error

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def await_end(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the query has ended and all of its progress is written."""
        query.awaitTermination()
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("The listener has not heard of the query's end.")
        if self.failure:
            raise self.failure


@contextmanager
def observed_gauges(spark: SparkSession, path: str) -> Iterator[GaugeListener]:
    """Store what queries started within observe, below a path."""
    listener = GaugeListener(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def read_observed(spark: SparkSession, path: str) -> DataFrame:
    """Per query and micro-batch its input rows, and each observed metric as text."""
    rows = store.read_table(spark, f"{path}", f"{OBSERVED}, of STRING")
    return rows.select("query", "batch", "input_rows", "metric", "value")
