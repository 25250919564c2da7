"""Latest status rows of every task; equal latest times are all kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_status(status: DataFrame) -> DataFrame:
    """Rows at the latest time of their task; rows without a task id drop out.

    The latest time per task is combined before the shuffle, and the join back
    runs on task and time together, so a task with very many rows spreads out.
    The small side is broadcast only if its measured size allows.
    """
    newest = (
        status.filter(F.col("task_id").isNotNull())
        .groupBy(F.col("task_id").alias("__task"))
        .agg(F.max("timestamp").alias("__newest"))
    )
    return status.join(
        newest,
        (status["task_id"] == newest["__task"]) & (status["timestamp"] == newest["__newest"]),
        "inner",
    ).select(*[status[c] for c in status.columns])


def latest_status_ranked(status: DataFrame) -> DataFrame:
    """The same rows with a ranking window: one scan, one shuffle by task."""
    newest_first = Window.partitionBy("task_id").orderBy(F.desc("timestamp"))
    return (
        status.filter(F.col("task_id").isNotNull() & F.col("timestamp").isNotNull())
        .withColumn("__rank", F.rank().over(newest_first))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def latest_counts(status: DataFrame) -> DataFrame:
    """Distinct latest rows with their number of copies.

    Only the survivors are counted. Newest times are combined before their
    shuffle, and a large group of copies is split by the join and added up
    before the last one.
    """
    newest = latest_status(status)
    return newest.groupBy(*newest.columns).agg(F.count(F.lit(1)).alias("copies"))


def latest_distinct(status: DataFrame) -> DataFrame:
    """Distinct latest rows of (job_id, task_id, status, timestamp).

    Every combination of the others keeps its newest time first, combined before
    the shuffle, so the log itself is never moved: a few rows per task are.
    """
    keys = [c for c in status.columns if c != "timestamp"]
    newest = status.groupBy(*keys).agg(F.max("timestamp").alias("timestamp"))
    return latest_status_ranked(newest).select(*status.columns)


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in an explicit order, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return (
        df.groupBy(*keys)
        .agg(F.min(ranked).alias("__first"))
        .select(*keys, *[F.col("__first")[c].alias(c) for c in rest])
    )
