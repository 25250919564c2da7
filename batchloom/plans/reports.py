"""Progress reports over the status log and the task table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.status import task_index, task_index_text
from batchloom.operators.checks import created_between, optional_equal
from batchloom.operators.joins import join_tasks
from batchloom.operators.latest import latest_counts, latest_distinct


def _wanted_tasks(
    job_array: DataFrame, sample_id: str, label: str, after: str, before: str
) -> tuple[DataFrame, bool]:
    """Tasks that pass every given filter, and whether any filter was given.

    An absent filter adds no predicate.
    """
    tasks = job_array.filter(
        optional_equal("sample_id", sample_id)
        & optional_equal("job_label", label)
        & created_between("timestamp", after, before)
    )
    given = (sample_id, label, after, before) != ("", "", K.REPORT_AFTER, K.REPORT_BEFORE)
    return tasks, given


def _status_of(status: DataFrame, tasks: DataFrame, filtered: bool) -> DataFrame:
    """For a filtered report: only status rows of tasks that can appear in it.

    The task ids of the wanted tasks are found by one semi join on job and index;
    then all rows of these ids are kept, under whatever job, so the latest time
    of a task does not change. Spark picks the form of both joins.
    """
    if not filtered:
        return status
    wanted = tasks.select(
        F.col("job_id").alias("__job"), F.col("batch_task_index").cast("string").alias("__index")
    )
    own = (F.col("job_id") == F.col("__job")) & (task_index_text(F.col("task_id")) == F.col("__index"))
    names = status.select("job_id", "task_id").join(wanted, own, "left_semi")
    return status.join(names.select("task_id").distinct(), "task_id", "left_semi").select(
        status.columns
    )


def count_report(
    status: DataFrame,
    job_array: DataFrame,
    sample_id: str = "",
    label: str = "",
    after: str = K.REPORT_AFTER,
    before: str = K.REPORT_BEFORE,
) -> DataFrame:
    """One row: tasks in all and per latest status.

    SUCCEEDED counts tasks that have a verdict; a task still waiting for its
    verdict is in TOTAL only.
    """
    wanted, filtered = _wanted_tasks(job_array, sample_id, label, after, before)
    tasks = wanted.select(
        "job_id", "batch_task_index"
    )
    rows = status.select("job_id", "task_id", "status", "timestamp")
    latest = latest_counts(_status_of(rows, tasks, filtered))
    joined = join_tasks(latest, tasks)

    def copies_if(*names: str):
        total = F.sum(F.when(F.col("status").isin(*names), F.col("copies")))
        return F.coalesce(total, F.lit(0)).cast("bigint")

    return joined.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("TOTAL"),
        copies_if(K.RUNNING).alias("RUNNING"),
        copies_if(K.VERIFIED_FAILED, K.VERIFIED_OK).alias("SUCCEEDED"),
        copies_if(K.FAILED).alias("FAILED"),
        copies_if(K.VERIFIED_OK).alias("VERIFIED_OK"),
        copies_if(K.VERIFIED_FAILED).alias("VERIFIED_FAILED"),
    )


def samples_report(
    status: DataFrame,
    job_array: DataFrame,
    sample_id: str = "",
    label: str = "",
    after: str = K.REPORT_AFTER,
    before: str = K.REPORT_BEFORE,
    ordered: bool = True,
) -> DataFrame:
    """Latest status of every sample. Rows are distinct per job and task."""
    wanted, filtered = _wanted_tasks(job_array, sample_id, label, after, before)
    tasks = wanted.select(
        "job_id",
        "batch_task_index",
        "job_name",
        "job_label",
        "sample_id",
        "input_path",
        "output_path",
        "input_type",
        "timestamp",
    )
    rows = status.select("job_id", "task_id", "status", "timestamp")
    latest = latest_distinct(_status_of(rows, tasks, filtered))
    report = (
        join_tasks(latest, tasks)
        .dropDuplicates(
            [
                "job_id",
                "task_id",
                "j_sample_id",
                "status",
                "timestamp",
                "j_input_path",
                "j_output_path",
                "j_input_type",
                "j_job_label",
                "j_job_name",
                "j_timestamp",
            ]
        )
        .select(
            F.col("j_job_name").alias("job_name"),
            F.col("j_job_label").alias("job_label"),
            task_index(F.col("task_id")).alias("batch_index"),
            F.col("j_sample_id").alias("sample_id"),
            "status",
            F.col("j_input_path").alias("input_path"),
            F.col("j_output_path").alias("output_path"),
            F.col("j_input_type").alias("input_type"),
            F.col("timestamp").alias("last_status_time"),
            F.col("j_timestamp").alias("creation_time"),
        )
    )
    if not ordered:
        return report
    # Further columns break ties, so equal keys do not pile up in one range.
    return report.orderBy("status", "batch_index", "creation_time", "job_name", "sample_id")


def sample_report(
    status: DataFrame,
    job_array: DataFrame,
    sample_id: str = "",
    label: str = "",
    after: str = K.REPORT_AFTER,
    before: str = K.REPORT_BEFORE,
    ordered: bool = True,
) -> DataFrame:
    """Every status change, usually of one sample, in time order."""
    wanted, filtered = _wanted_tasks(job_array, sample_id, label, after, before)
    tasks = wanted.select(
        "job_id",
        "batch_task_index",
        "job_name",
        "job_label",
        "sample_id",
        "input_path",
        "output_path",
        "timestamp",
    )
    rows = status.select("job_id", "task_id", "status", "timestamp")
    report = join_tasks(_status_of(rows, tasks, filtered), tasks).select(
        F.col("j_job_name").alias("job_name"),
        F.col("j_job_label").alias("job_label"),
        F.col("j_sample_id").alias("sample_id"),
        "task_id",
        "status",
        F.col("j_input_path").alias("input_path"),
        F.col("j_output_path").alias("output_path"),
        F.col("timestamp").alias("last_status_time"),
        F.col("j_timestamp").alias("creation_time"),
    )
    if not ordered:
        return report
    return (
        report.withColumn("__tie", F.monotonically_increasing_id())
        .orderBy("last_status_time", "__tie")  # a busy second is cut in several ranges
        .drop("__tie")
    )


def shown(report: DataFrame, rows: int) -> DataFrame:
    """The first rows of a report, as many as the caller asks for."""
    return report.limit(rows)


def run_query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL with named parameters; values are never pasted into the text."""
    return spark.sql(sql, args=params)
