"""Task events to status rows, verdicts and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.status import job_message, task_message
from batchloom.operators.checks import job_ended
from batchloom.operators.joins import enrich_events, with_verdict


def status_rows(events: DataFrame, clock: Column) -> DataFrame:
    """One status row per event, stamped with the given clock to the second."""
    return events.select(
        "job_id",
        "task_id",
        "status",
        F.date_trunc("second", clock).cast("timestamp_ntz").alias("timestamp"),
    )


def verdict_rows(
    rows: DataFrame,
    logs: DataFrame,
    patterns: list[str] | None = None,
    delay_seconds: int = 0,
) -> DataFrame:
    """A second row per SUCCEEDED row: the verdict of the task's log lines."""
    later = F.col("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(delay_seconds)
    )
    succeeded = (
        rows.filter(F.col("status") == K.SUCCEEDED)
        .drop("status")
        .withColumn("timestamp", later.cast("timestamp_ntz"))
    )
    return with_verdict(succeeded, logs, patterns, "status").select(*rows.columns)


def with_verdicts(
    rows: DataFrame,
    logs: DataFrame,
    patterns: list[str] | None = None,
    delay_seconds: int = 0,
) -> DataFrame:
    """Status rows and, for each success, its verdict row."""
    return rows.unionByName(verdict_rows(rows, logs, patterns, delay_seconds))


def task_notifications(
    events: DataFrame, job_array: DataFrame, clock: Column, project: str, region: str
) -> DataFrame:
    """Texts for verdicts and failures. ``events`` has job_id, task_id, job_name, status.

    A failure text has no output link.
    """
    told = events.filter(F.col("status").isin(K.FAILED, K.VERIFIED_OK, K.VERIFIED_FAILED))
    known = enrich_events(told, job_array)
    output = F.when(F.col("status") != K.FAILED, F.col("output_path"))
    return known.select(
        "job_id",
        "task_id",
        "status",
        task_message(
            F.col("status"),
            F.col("sample_id"),
            F.col("job_name"),
            F.col("job_id"),
            F.col("task_id"),
            output,
            clock,
            project,
            region,
        ).alias("text"),
    )


def job_notifications(events: DataFrame, clock: Column, project: str, region: str) -> DataFrame:
    """Texts for finished jobs. ``events`` has job_uid, job_name, status."""
    return events.filter(job_ended(F.col("status"))).select(
        "job_uid",
        "job_name",
        "status",
        job_message(
            F.col("status"), F.col("job_name"), F.col("job_uid"), clock, project, region
        ).alias("text"),
    )
