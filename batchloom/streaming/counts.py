"""The count report, kept up to date by signed changes of every micro-batch.

Two tables are kept. The state has a row set per task: its newest time and the
statuses at that time with their copies, as the batch number left them; a later
number outdates an earlier one. The counts have signed numbers per status: what the
tasks of a batch were counted as before it leaves, what they are now enters. The
report is the sum of the counts, and equals the one over the whole log: equal newest
times count all, repeated rows count as often as they came, and a task is counted if
the task table knows it when its status arrives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from batchloom import constants as K
from batchloom import schemas
from batchloom.operators.joins import join_tasks
from batchloom.operators.latest import latest_counts, latest_status
from batchloom.session import materialized, scratch
from batchloom.sinks.tables import Layout, compact_in_place, of_keys, read_table
from batchloom.sources.warehouse import few_jobs
from batchloom.streaming.runner import Write, start

STATE = T.StructType(
    [*schemas.TASKS_STATUS.fields, T.StructField("copies", T.LongType()), T.StructField("as_of", T.LongType())]
)
COUNTS = T.StructType([T.StructField("status", T.StringType()), T.StructField("change", T.LongType())])
STATE_LAYOUT = Layout(("task_id",))
_KEYS = ["job_id", "task_id", "status", "timestamp"]


@dataclass(frozen=True)
class CountSinks:
    """Folders of the state per task and of the signed counts."""

    state: str
    counts: str


def follow_counts(
    status: DataFrame, job_array: Callable[[], DataFrame], sinks: CountSinks, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep the counts of a stream of status rows (job_id, task_id, status, timestamp).

    A batch reads the state of its own tasks, from the files of their hashes if there
    are no more than a thousand. A batch that is repeated starts from the state before it.
    """

    def each(batch: DataFrame, write: Write) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            rows = batch.select(*_KEYS).filter(F.col("task_id").isNotNull())
            fresh = materialized(latest_counts(rows), "fresh")
            before = materialized(_state_of(spark, sinks, fresh, write), "before")
            after = materialized(_merged(before, fresh), "after")
            write(after.withColumn("as_of", F.lit(write.batch_id).cast("bigint")), sinks.state, STATE_LAYOUT)
            moved = after.unionByName(before.withColumn("copies", -F.col("copies")))
            signed = moved.groupBy(*_KEYS).agg(F.sum("copies").alias("change")).filter(F.col("change") != 0)
            known = join_tasks(signed, job_array().select("job_id", "batch_task_index"))
            write(known.groupBy("status").agg(F.sum("change").alias("change")), sinks.counts)

    return start(status, each, checkpoint, once)


def _state_of(spark: SparkSession, sinks: CountSinks, fresh: DataFrame, write: Write) -> DataFrame:
    """What the state says of the tasks of a batch, without what the batch itself has written."""
    try:
        state = read_table(spark, sinks.state, STATE, without=(write.writer, write.batch_id))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        state = spark.createDataFrame([], STATE)
    tasks = few_jobs(fresh, "task_id")
    if tasks is not None:
        state = of_keys(state, "task_id", tasks)
    own = state.join(fresh.select("task_id").distinct(), "task_id", "left_semi")
    return newest_state(own).select(*_KEYS, "copies")


def newest_state(state: DataFrame) -> DataFrame:
    """The rows that the last batch of each task has left."""
    last = state.groupBy(F.col("task_id").alias("__task")).agg(F.max("as_of").alias("__last"))
    newest = state.join(last, (state["task_id"] == last["__task"]) & (state["as_of"] == last["__last"]))
    return newest.select(*STATE.fieldNames())


def _merged(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """Statuses at the newest time of each task, with all their copies."""
    newest = latest_status(before.unionByName(fresh))
    return newest.groupBy(*_KEYS).agg(F.sum("copies").alias("copies"))


def counted(counts: DataFrame) -> DataFrame:
    """The count report, from the signed counts: one row."""

    def of(*names: str):
        total = F.sum(F.when(F.col("status").isin(*names), F.col("change")))
        return F.coalesce(total, F.lit(0)).cast("bigint")

    return counts.agg(
        F.coalesce(F.sum("change"), F.lit(0)).cast("bigint").alias("TOTAL"),
        of(K.RUNNING).alias("RUNNING"),
        of(K.VERIFIED_FAILED, K.VERIFIED_OK).alias("SUCCEEDED"),
        of(K.FAILED).alias("FAILED"),
        of(K.VERIFIED_OK).alias("VERIFIED_OK"),
        of(K.VERIFIED_FAILED).alias("VERIFIED_FAILED"),
    )


def count_now(spark: SparkSession, sinks: CountSinks) -> DataFrame:
    """The report as of the last batch; it reads a few numbers per batch since the last compaction."""
    return counted(read_table(spark, sinks.counts, COUNTS))


def compact_counts(spark: SparkSession, sinks: CountSinks) -> None:
    """Fold outdated state and all signed counts, in the place of the batches that wrote them."""
    compact_in_place(spark, sinks.state, STATE, STATE_LAYOUT, newest_state)
    compact_in_place(spark, sinks.counts, COUNTS, fold=lambda df: df.groupBy("status").agg(F.sum("change").alias("change")))
