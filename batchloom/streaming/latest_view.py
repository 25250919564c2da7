"""Current status per task, kept up to date from the status stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchloom import schemas
from batchloom.operators.latest import latest_status
from batchloom.sinks.tables import append
from batchloom.streaming.runner import start

KEYS = ["job_id", "task_id", "status"]


def newest_per_status(status: DataFrame) -> DataFrame:
    """Newest time of every status a task has had: a few rows of state per task."""
    return (
        status.filter(F.col("task_id").isNotNull())
        .groupBy(*KEYS)
        .agg(F.max("timestamp").alias("timestamp"))
    )


def follow_latest(
    status_stream: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    keep: str = "1 day",
    delay: str = "1 hour",
    arrival: Column | None = None,
) -> StreamingQuery:
    """Write changed (job, task, status, newest time) rows per micro-batch.

    The state holds tasks of which something arrived within ``keep``, and ``delay`` after
    that; then it ends, and the rows it has written stand in the table of changes. Time
    counts from arrival, so no row is too late: a task that goes on later starts a state
    of its own, and :func:`latest_view` takes the newest of all that is written.
    ``arrival`` is the time a row came, by default the micro-batch's.
    """
    seen = F.current_timestamp() if arrival is None else arrival
    recent = status_stream.filter(F.col("task_id").isNotNull()).withColumn("__seen", seen).withWatermark("__seen", delay)
    newest = recent.groupBy(F.window("__seen", keep), *KEYS).agg(F.max("timestamp").alias("timestamp"))
    return start(
        newest.select(*KEYS, "timestamp"), lambda batch, write: write(batch, path), checkpoint, once, mode="update"
    )


def latest_view(changes: DataFrame) -> DataFrame:
    """Latest status rows from the written changes; ties stay, copies are one row."""
    return latest_status(newest_per_status(changes)).select(*KEYS, "timestamp")


def compact_view(changes: DataFrame, target: str) -> None:
    """The newest row per task and status as a new, small table of changes.

    A stream may go on writing into ``target``; later changes outdate these rows.
    """
    append(newest_per_status(changes).hint("rebalance"), target, schemas.TASKS_STATUS)
