"""Reports and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.catalog import fixtures as fx
from batchloom.catalog.registry import query
from batchloom.operators.joins import join_tasks
from batchloom.operators.latest import first_match, latest_status, latest_status_ranked
from batchloom.plans import reports
from batchloom.sources.warehouse import task_rows

_BOTH = [fx.TASKS_STATUS, fx.JOB_ARRAY]
_JOIN = (
    "J.batch_task_index::VARCHAR = nullif(regexp_extract(T.task_id, 'group0-([0-9]+)', 1), '')"
    " AND T.job_id = J.job_id"
)
_LATEST = (
    "T.timestamp = (SELECT max(timestamp) FROM fx_tasks_status S WHERE S.task_id = T.task_id)"
)


def _filters(sample: str = "", label: str = "", after: str = "", before: str = "") -> str:
    after = after or "2016-12-07 08:00:00"
    before = before or "2100-12-07 08:00:00"
    return (
        f"(J.sample_id = '{sample}' OR '{sample}' = '') AND (J.job_label = '{label}' OR '{label}' = '')"
        f" AND J.timestamp >= TIMESTAMP '{after}' AND J.timestamp <= TIMESTAMP '{before}'"
    )


def _count_sql(**filters: str) -> str:
    return fx.with_(
        _BOTH,
        f"""SELECT count(*)::BIGINT AS "TOTAL",
  count(*) FILTER (T.status = 'RUNNING')::BIGINT AS "RUNNING",
  count(*) FILTER (T.status IN ('VERIFIED_FAILED', 'VERIFIED_OK'))::BIGINT AS "SUCCEEDED",
  count(*) FILTER (T.status = 'FAILED')::BIGINT AS "FAILED",
  count(*) FILTER (T.status = 'VERIFIED_OK')::BIGINT AS "VERIFIED_OK",
  count(*) FILTER (T.status = 'VERIFIED_FAILED')::BIGINT AS "VERIFIED_FAILED"
FROM fx_tasks_status T JOIN fx_job_array J ON {_JOIN}
WHERE {_LATEST} AND {_filters(**filters)}""",
    )


def _samples_sql(**filters: str) -> str:
    return fx.with_(
        _BOTH,
        f"""SELECT job_name, job_label, batch_index, sample_id, status, input_path, output_path,
  input_type, last_status_time, creation_time
FROM (SELECT DISTINCT T.job_id, T.task_id, J.job_name, J.job_label,
    regexp_extract(T.task_id, 'group0-([0-9]+)', 1)::BIGINT AS batch_index, J.sample_id, T.status,
    J.input_path, J.output_path, J.input_type, T.timestamp AS last_status_time,
    J.timestamp AS creation_time
  FROM fx_tasks_status T JOIN fx_job_array J ON {_JOIN}
  WHERE {_LATEST} AND {_filters(**filters)})""",
    )


def _history_sql(**filters: str) -> str:
    return fx.with_(
        _BOTH,
        f"""SELECT J.job_name, J.job_label, J.sample_id, T.task_id, T.status, J.input_path,
  J.output_path, T.timestamp AS last_status_time, J.timestamp AS creation_time
FROM fx_tasks_status T JOIN fx_job_array J ON {_JOIN} WHERE {_filters(**filters)}""",
    )


def _tables(spark, sf):
    return fx.tasks_status(spark, sf), fx.job_array(spark, sf)


@query("report_count", _count_sql())
def report_count(spark, sf):
    return reports.count_report(*_tables(spark, sf))


@query("report_count_by_label_filter", _count_sql(label="BUILDING"))
def report_count_by_label_filter(spark, sf):
    return reports.count_report(*_tables(spark, sf), label="BUILDING")


_SPAN = {"after": "2024-01-01 00:05:00", "before": "2024-01-01 20:00:00"}


@query("report_count_time_filter", _count_sql(**_SPAN))
def report_count_time_filter(spark, sf):
    return reports.count_report(*_tables(spark, sf), **_SPAN)


@query("report_count_one_sample", _count_sql(sample="NA3"))
def report_count_one_sample(spark, sf):
    return reports.count_report(*_tables(spark, sf), sample_id="NA3")


@query("report_samples", _samples_sql())
def report_samples(spark, sf):
    return reports.samples_report(*_tables(spark, sf))


@query("report_samples_label", _samples_sql(label="BUILDING", **_SPAN))
def report_samples_label(spark, sf):
    return reports.samples_report(*_tables(spark, sf), label="BUILDING", **_SPAN)


@query("report_sample_history", _history_sql(sample="NA3"))
def report_sample_history(spark, sf):
    return reports.sample_report(*_tables(spark, sf), sample_id="NA3")


@query("report_full_history", _history_sql())
def report_full_history(spark, sf):
    return reports.sample_report(*_tables(spark, sf))


@query(
    "join_status_job_array",
    fx.with_(
        _BOTH,
        f"""SELECT T.job_id, T.task_id, T.status, T.timestamp, J.sample_id, J.batch_task_index
FROM fx_tasks_status T JOIN fx_job_array J ON {_JOIN}""",
    ),
)
def join_status_job_array(spark, sf):
    status, tasks = _tables(spark, sf)
    return join_tasks(status, tasks).select(
        "job_id",
        "task_id",
        "status",
        "timestamp",
        F.col("j_sample_id").alias("sample_id"),
        F.col("j_batch_task_index").alias("batch_task_index"),
    )


@query(
    "task_rows",
    fx.with_(
        _BOTH,
        f"""SELECT T.job_id, J.job_label, T.task_id, J.sample_id, T.status,
  T.timestamp AS event_timestamp, J.input_type, J.input_path, J.output_path, J.command, J.timestamp
FROM fx_tasks_status T JOIN fx_job_array J ON {_JOIN}""",
    ),
)
def wide_task_rows(spark, sf):
    return task_rows(*_tables(spark, sf))


_LATEST_SQL = fx.with_(
    [fx.DAY_STATUS],
    """SELECT job_id, task_id, status, timestamp FROM fx_day_status T
WHERE timestamp = (SELECT max(timestamp) FROM fx_day_status S WHERE S.task_id = T.task_id)""",
)


@query("latest_status_subquery", _LATEST_SQL)
def latest_status_subquery(spark, sf):
    return latest_status(fx.day_status(spark, sf))


@query("latest_status_window", _LATEST_SQL)
def latest_status_window(spark, sf):
    return latest_status_ranked(fx.day_status(spark, sf))


@query(
    "limit_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10000""",
)
def limit_rows(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return reports.shown(orders.orderBy("o_orderkey"), 10_000)


@query(
    "first_row_of_lookup",
    """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def first_row_of_lookup(spark, sf):
    events = fx.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return first_match(events, ["user_id"], ["ts", "event_id"])


@query(
    "run_sql_with_parameters",
    """SELECT event_type, count(*)::BIGINT AS n, max(ts) AS last_time FROM events
WHERE event_type <> 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY event_type""",
)
def run_sql_with_parameters(spark, sf):
    return reports.run_query(
        spark,
        f"""SELECT event_type, count(1) AS n, max(ts) AS last_time
        FROM parquet.`{sf}/events.parquet`
        WHERE event_type <> :skip AND ts >= CAST(:after AS TIMESTAMP_NTZ) GROUP BY event_type""",
        skip="click",
        after="2024-01-05 00:00:00",
    )
