"""Task-state, job-state and object messages, as batch or as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import schemas
from batchloom.functions.paths import segment
from batchloom.functions.status import payload_text


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options
) -> DataFrame:
    """A file stream; another transport only changes the format and its options."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def message_stream(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Stream of messages with attributes and a base64 body."""
    return read_stream(spark, path, schemas.MESSAGE, fmt, **options)


def object_stream(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Stream of stored-object events."""
    return read_stream(spark, path, schemas.OBJECT_EVENT, fmt, **options)


def task_events(messages: DataFrame) -> DataFrame:
    """Flat task-state events of messages that carry attributes."""
    a = F.col("attributes")
    return messages.select(
        a["JobUID"].alias("job_id"),
        a["TaskUID"].alias("task_id"),
        a["NewTaskState"].alias("status"),
        segment(a["TaskName"], 5).alias("job_name"),
        a["Region"].alias("region"),
        payload_text(F.col("data")).alias("payload"),
    )


def job_events(messages: DataFrame) -> DataFrame:
    """Flat job-state events of messages that carry attributes."""
    a = F.col("attributes")
    return messages.select(
        a["JobUID"].alias("job_uid"),
        segment(a["JobName"], -1).alias("job_name"),
        a["NewJobState"].alias("status"),
        a["Region"].alias("region"),
        payload_text(F.col("data")).alias("payload"),
    )
