"""Warehouse tables: status log, task table, logs and job directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import schemas
from batchloom.operators.joins import join_tasks
from batchloom.sinks.tables import of_keys, read_table


def _table(
    spark: SparkSession, path: str, schema: T.StructType, key: str = "", values: Sequence[str] | None = None
) -> DataFrame:
    """A table by its declared columns, whoever wrote its rows; of some keys only, if they are given."""
    table = read_table(spark, path, schema)
    if values is not None:
        table = of_keys(table, key, values)
    return table.select(*schema.fieldNames())


def tasks_status(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.TASKS_STATUS)


def job_array(spark: SparkSession, path: str, jobs: Sequence[str] | None = None) -> DataFrame:
    """The task table; of some jobs only, read from their files if it has ``TASK_LAYOUT``."""
    return _table(spark, path, schemas.JOB_ARRAY, "job_id", jobs)


def task_logs(spark: SparkSession, path: str, jobs: Sequence[str] | None = None) -> DataFrame:
    """The log table; of some jobs only, read from their files if it has ``LOG_LAYOUT``."""
    return _table(spark, path, schemas.TASK_LOG, "job_uid", jobs)


def few_jobs(rows: DataFrame, key: str = "job_id", most: int = 1000) -> list[str] | None:
    """The jobs of a micro-batch, if they are few enough for a filter; None if not."""
    found = rows.select(key).filter(F.col(key).isNotNull()).distinct().limit(most + 1).collect()
    return [r[0] for r in found] if len(found) <= most else None


def job_directory(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.JOB_DIRECTORY)


def job_by_name(jobs: DataFrame, job_name: str) -> DataFrame:
    return jobs.filter(F.col("job_name") == job_name)


def job_by_uid(jobs: DataFrame, job_uid: str) -> DataFrame:
    return jobs.filter(F.col("job_uid") == job_uid)


def task_rows(status: DataFrame, job_array_table: DataFrame) -> DataFrame:
    """The wide form: every status change with its sample and command."""
    return join_tasks(status, job_array_table).select(
        "job_id",
        F.col("j_job_label").alias("job_label"),
        "task_id",
        F.col("j_sample_id").alias("sample_id"),
        "status",
        F.col("timestamp").alias("event_timestamp"),
        F.col("j_input_type").alias("input_type"),
        F.col("j_input_path").alias("input_path"),
        F.col("j_output_path").alias("output_path"),
        F.col("j_command").alias("command"),
        F.col("j_timestamp").alias("timestamp"),
    )
