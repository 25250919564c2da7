"""Task messages to the status log, with verdicts, rejects and notifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchloom import constants as K
from batchloom.functions.status import is_success_line, payload_text, payload_time, verdict
from batchloom.operators.checks import with_attributes
from batchloom.operators.joins import enrich_events, with_verdict
from batchloom.plans.status import status_rows, task_notifications
from batchloom.sources import warehouse
from batchloom.sources.events import task_events
from batchloom.sources.warehouse import few_jobs
from batchloom.streaming.runner import Write, append_rows, start


@dataclass(frozen=True)
class StatusSinks:
    """Folders the status stream writes to; None leaves a sink out."""

    status: str
    rejects: str | None = None
    notifications: str | None = None


def deduplicated(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Optional: drop messages delivered again within ``delay`` of their first delivery.

    Copies agree in task, state, time and body; messages without one of these all
    stay. The delay counts from arrival, so no message can come too late for it.
    """
    a = F.col("attributes")
    time = payload_time(payload_text(F.col("data")))
    parts = {"__task": a["TaskUID"], "__state": a["NewTaskState"], "__time": time}
    whole = F.lit(True)
    for part in [*parts.values(), F.col("data")]:
        whole = whole & part.isNotNull()
    keyed = messages.withColumns(
        {**parts, "__own": F.when(whole, F.lit("")).otherwise(F.uuid()), "__seen": F.current_timestamp()}
    )
    return (
        keyed.withWatermark("__seen", delay)
        .dropDuplicatesWithinWatermark([*parts, "data", "__own"])
        .select("attributes", "data")
    )


def _events_only(
    messages: DataFrame,
    rows: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    once: bool,
    rejects: str | None,
) -> StreamingQuery:
    def each(batch: DataFrame, write: Write) -> None:
        good, bad = with_attributes(batch)
        write(rows(task_events(good)), path)
        if rejects:
            write(bad, rejects)

    return start(messages, each, checkpoint, once)


def append_status(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    clock: Callable[[DataFrame], Column] | None = None,
    once: bool = False,
    rejects: str | None = None,
) -> StreamingQuery:
    """Plain append of every event to the status log, without verification.

    Messages without attributes are no events; they go to ``rejects``.
    """

    def rows(events: DataFrame) -> DataFrame:
        return status_rows(events, clock(events) if clock else F.current_timestamp())

    return _events_only(messages, rows, path, checkpoint, once, rejects)


def append_enriched(
    messages: DataFrame,
    job_array: DataFrame | str,
    path: str,
    checkpoint: str,
    once: bool = False,
    rejects: str | None = None,
) -> StreamingQuery:
    """Append every event with its task columns; events of unknown tasks stay.

    Messages without attributes go to ``rejects``. Of a task table given by its path
    a micro-batch reads the files of its jobs only.
    """

    def rows(events: DataFrame) -> DataFrame:
        if isinstance(job_array, str):
            return enrich_events(events, warehouse.job_array(events.sparkSession, job_array, few_jobs(events)))
        return enrich_events(events, job_array)

    return _events_only(messages, rows, path, checkpoint, once, rejects)


# A table, read anew per micro-batch, or the path of one, of which a batch reads its jobs only.
Lookup = Callable[[], DataFrame] | str


def _looked_up(table: Lookup, read: Callable[..., DataFrame], batch: DataFrame, jobs: list[str] | None) -> DataFrame:
    return read(batch.sparkSession, table, jobs) if isinstance(table, str) else table()


def ingest_status(
    messages: DataFrame,
    logs: Lookup,
    sinks: StatusSinks,
    checkpoint: str,
    job_array: Lookup | None = None,
    clock: Callable[[DataFrame], Column] | None = None,
    patterns: list[str] | None = None,
    verdict_delay: int = 1,
    project: str = "",
    region: str = "",
    message_clock: Column | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Store every event; check each success against its logs and store the verdict.

    ``logs`` and ``job_array`` are read anew per micro-batch, of which only what the
    batch's own tasks need. Given as paths of tables that are cut by job, only the files
    of the batch's jobs are opened, unless there are over a thousand. ``clock`` gives
    the row time (arrival by default). A verdict is stamped ``verdict_delay``
    seconds after its success row, so that it is the later of the two.
    """

    def each(batch: DataFrame, write: Write) -> None:
        batch = batch.persist()
        good, bad = with_attributes(batch)
        events = task_events(good)
        succeeded = events.filter(F.col("status") == K.SUCCEEDED).drop("status")
        # Kept for the two sinks below, so the logs are scanned once per batch.
        paths = isinstance(logs, str) or isinstance(job_array, str)
        jobs = few_jobs(events) if paths else None
        lines = _looked_up(logs, warehouse.task_logs, batch, jobs)
        judged = with_verdict(succeeded, lines, patterns, "status").persist()
        try:
            stamp = clock(events) if clock else F.current_timestamp()
            later = stamp + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(verdict_delay))
            rows = status_rows(events, stamp).unionByName(status_rows(judged, later))
            write(rows, sinks.status)
            if sinks.rejects:
                write(bad, sinks.rejects)
            if sinks.notifications and job_array:
                told = judged.unionByName(events.filter(F.col("status") == K.FAILED))
                now = F.current_timestamp() if message_clock is None else message_clock
                tasks = _looked_up(job_array, warehouse.job_array, batch, jobs)
                texts = task_notifications(told, tasks, now, project, region)
                write(texts, sinks.notifications)
        finally:
            judged.unpersist()
            batch.unpersist()

    return start(messages, each, checkpoint, once)


def verdicts_in_time(
    rows: DataFrame,
    logs: DataFrame,
    wait: str = "10 minutes",
    back: str = "1 day",
    delay: str = "10 minutes",
    patterns: list[str] | None = None,
    verdict_delay: int = 1,
) -> DataFrame:
    """Verdict rows of a stream of status rows, which wait for a stream of log lines.

    A success line from ``back`` before a success until ``wait`` after it makes the
    verdict good, as soon as both are there. Without one the verdict is bad, once the
    watermarks of both streams, ``delay`` behind their newest times, have passed the wait. A
    line after that changes nothing. There is one verdict per task and time
    of success. ``logs`` has job_uid, task_id, text_payload and timestamp.

    State: successes until their wait is over, success lines for ``back`` and ``delay``.
    """
    succeeded = (
        rows.filter(F.col("status") == K.SUCCEEDED)
        .select("job_id", "task_id", F.col("timestamp").cast("timestamp").alias("at"))
        .withWatermark("at", delay)
        .dropDuplicates(["job_id", "task_id", "at"])
    )
    lines = (
        logs.filter(is_success_line(F.col("text_payload"), patterns))
        .select("job_uid", F.col("task_id").alias("__task"), F.col("timestamp").cast("timestamp").alias("logged"))
        .withWatermark("logged", delay)
    )
    near = (F.col("logged") >= F.col("at") - F.expr(f"interval {back}")) & (
        F.col("logged") <= F.col("at") + F.expr(f"interval {wait}")
    )
    own = (succeeded["job_id"] == lines["job_uid"]) & (succeeded["task_id"] == lines["__task"])
    judged = succeeded.join(lines, own & near, "left_outer")
    # Several lines of one success meet here; only their first passes on.
    first = judged.select("job_id", "task_id", "at", F.col("logged").isNotNull().alias("__hit")).dropDuplicates(
        ["job_id", "task_id", "at"]
    )
    later = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(verdict_delay))
    return first.select(
        "job_id", "task_id", verdict(F.col("__hit")).alias("status"),
        F.date_trunc("second", later).cast("timestamp_ntz").alias("timestamp"),
    )


def append_verdicts(
    rows: DataFrame, logs: DataFrame, path: str, checkpoint: str, once: bool = False, **options
) -> StreamingQuery:
    """Append verdicts that wait for their log lines; the status rows come from a stream beside it.

    With :func:`append_status` on the same messages this takes the place of
    :func:`ingest_status`, which looks at the logs once, when the success arrives.
    """
    return append_rows(verdicts_in_time(rows, logs, **options), path, checkpoint, once)
