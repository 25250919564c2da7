"""Joins between status rows, tasks, logs, listings and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.paths import ancestors, basename, parent_path
from batchloom.functions.status import (
    is_success_line,
    task_index,
    task_index_text,
    verdict,
)


def join_tasks(status: DataFrame, job_array: DataFrame) -> DataFrame:
    """Status rows with their task, by job and the index text inside the task id.

    Columns of the task side carry the prefix ``j_``.
    """
    tasks = job_array.select(*[F.col(c).alias("j_" + c) for c in job_array.columns])
    keyed = status.withColumn("__index", task_index_text(F.col("task_id")))
    return keyed.join(
        tasks,
        (keyed["job_id"] == tasks["j_job_id"])
        & (keyed["__index"] == tasks["j_batch_task_index"].cast("string")),
        "inner",
    ).drop("__index")


def enrich_events(events: DataFrame, job_array: DataFrame) -> DataFrame:
    """Events with sample, input, output, type and command; unknown tasks stay, with nulls."""
    wanted = ["sample_id", "input_path", "output_path", "input_type", "command"]
    have = [c for c in wanted if c in job_array.columns]
    keyed = events.withColumn("__index", task_index(F.col("task_id")))
    tasks = job_array.select(
        F.col("job_id").alias("__job"), F.col("batch_task_index").alias("__number"), *have
    )
    if not events.isStreaming:  # tasks of these events only, before they are joined
        own = keyed.select(F.col("job_id").alias("__job"), F.col("__index").alias("__number"))
        tasks = tasks.join(own.distinct(), ["__job", "__number"], "left_semi")
    return keyed.join(
        tasks,
        (keyed["job_id"] == tasks["__job"]) & (keyed["__index"] == tasks["__number"]),
        "left",
    ).select(*[events[c] for c in events.columns], *have)


def task_info(job_array: DataFrame, job_id: str, task_id: str) -> DataFrame:
    """Point lookup of one task: sample, input, output, type and command."""
    index = task_index(F.lit(task_id))  # folds to a constant, so the filter is pushed down
    return (
        job_array.filter((F.col("job_id") == job_id) & (F.col("batch_task_index") == index))
        .select("sample_id", "input_path", "output_path", "input_type", "command")
        .orderBy("sample_id", "input_path", "output_path", "input_type", "command")
        .limit(1)
    )


def success_tasks(logs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Distinct (job_uid, task_id) that have a success line. Only hits are shuffled."""
    return (
        logs.filter(is_success_line(F.col("text_payload"), patterns))
        .select("job_uid", "task_id")
        .distinct()
    )


def task_log_lines(logs: DataFrame, job_uid: str, task_id: str, pattern: str) -> DataFrame:
    """Lines of one task that match a pattern."""
    return logs.filter(
        (F.col("job_uid") == job_uid)
        & (F.col("task_id") == task_id)
        & F.col("text_payload").rlike(pattern)
    )


def logs_of(logs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Log lines of the given tasks, found before any line is looked at.

    The keys are few next to the logs, so Spark can broadcast them once their
    size is known, or filter the scan of the logs by them.
    """
    keys = tasks.select(F.col("job_id").alias("job_uid"), "task_id").distinct()
    return logs.join(keys, ["job_uid", "task_id"], "left_semi").select(logs.columns)


def _log_keys(tasks: DataFrame, hits: DataFrame):
    return (tasks["job_id"] == hits["job_uid"]) & (tasks["task_id"] == hits["task_id"])


def verified(tasks: DataFrame, logs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Tasks with a success line in their logs."""
    hits = success_tasks(logs, patterns)
    return tasks.join(hits, _log_keys(tasks, hits), "left_semi")


def unverified(tasks: DataFrame, logs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Tasks without a success line in their logs."""
    hits = success_tasks(logs, patterns)
    return tasks.join(hits, _log_keys(tasks, hits), "left_anti")


def with_verdict(
    tasks: DataFrame, logs: DataFrame, patterns: list[str] | None = None, name: str = "verdict"
) -> DataFrame:
    """Every task with its verdict. Only lines of these tasks are matched."""
    hits = success_tasks(logs_of(logs, tasks), patterns).withColumn("__hit", F.lit(True))
    return tasks.join(hits, _log_keys(tasks, hits), "left").select(
        *[tasks[c] for c in tasks.columns], verdict(F.col("__hit").isNotNull()).alias(name)
    )


def any_success(logs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Per task of the log table: does any line match."""
    return logs.groupBy("job_uid", "task_id").agg(
        F.bool_or(is_success_line(F.col("text_payload"), patterns)).alias("succeeded")
    )


def zip_by_position(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Pair two lists by position; unequal lengths leave rows for :func:`unpaired`."""
    return left.join(right, pos, "inner")


def unpaired(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions that only one of two lists has; empty when the lengths match."""
    a = left.select(F.col(pos).alias("__a"))
    b = right.select(F.col(pos).alias("__b"))
    return (
        a.join(b, F.col("__a") == F.col("__b"), "full")
        .filter(F.col("__a").isNull() | F.col("__b").isNull())
        .select(F.coalesce("__a", "__b").alias(pos))
    )


def existing(wanted: DataFrame, listing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose object is in the listing."""
    return wanted.join(listing.select(*on).distinct(), on, "left_semi")


def missing(wanted: DataFrame, listing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose object is not in the listing."""
    return wanted.join(listing.select(*on).distinct(), on, "left_anti")


def nearest_config(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    """Configuration at (bucket, path), else the one of that name a directory up.

    ``configs`` has one row per (bucket, path) with a ``config`` column.
    """
    here = configs.select(
        F.col("bucket").alias("__b1"), F.col("path").alias("__p1"), F.col("config").alias("__c1")
    )
    above = configs.select(
        F.col("bucket").alias("__b2"), F.col("path").alias("__p2"), F.col("config").alias("__c2")
    )
    keyed = wanted.withColumn("__up", parent_path(F.col("path")))
    step1 = keyed.join(
        here, (keyed["bucket"] == here["__b1"]) & (keyed["path"] == here["__p1"]), "left"
    )
    step2 = step1.join(
        above, (step1["bucket"] == above["__b2"]) & (step1["__up"] == above["__p2"]), "left"
    )
    found = (
        F.when(F.col("__p1").isNotNull(), F.col("path"))
        .when(F.col("__p2").isNotNull(), F.col("__up"))
    )
    config = F.when(F.col("__p1").isNotNull(), F.col("__c1")).otherwise(F.col("__c2"))
    return step2.select(
        *[F.col(c) for c in wanted.columns], found.alias("found_path"), config.alias("config")
    )


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def nearest_ancestor_config(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    """Configuration at (bucket, path), else the one of that name in the nearest folder above.

    ``configs`` has one row per (bucket, path) with a ``config`` column. Every wanted
    path stands for itself and the places above it, as far as configs lie at that depth
    in the bucket; one equality join finds all of them, and the deepest wins. Rows
    whose bucket or path is null find nothing.
    """
    here = configs.select(F.col("bucket").alias("__bucket"), F.col("path").alias("__place"), F.col("config").alias("__config"))
    # A few numbers per bucket.
    depths = here.groupBy("__bucket").agg(F.collect_set(_slashes(F.col("__place"))).alias("__depths"))
    asked = wanted.select(F.col("bucket").alias("__of"), F.col("path").alias("__path")).filter(
        F.col("__of").isNotNull() & F.col("__path").isNotNull()
    ).distinct()
    name = basename(F.col("__path"))
    above = F.transform(ancestors(F.col("__path")), lambda d: F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name)))
    places = F.filter(
        F.array_distinct(F.concat(F.array("__path"), above)), lambda p: F.array_contains("__depths", _slashes(p))
    )
    tried = asked.join(depths, asked["__of"] == depths["__bucket"]).select("__of", "__path", F.explode(places).alias("__try"))
    hits = tried.join(here, (tried["__of"] == here["__bucket"]) & (tried["__try"] == here["__place"]))
    best = F.max(F.struct(F.length("__place").alias("n"), F.col("__place").alias("place"), F.col("__config").alias("config")))
    found = hits.groupBy("__of", "__path").agg(best.alias("__best"))
    return wanted.join(found, (wanted["bucket"] == found["__of"]) & (wanted["path"] == found["__path"]), "left").select(
        *[wanted[c] for c in wanted.columns], F.col("__best.place").alias("found_path"), F.col("__best.config").alias("config")
    )
