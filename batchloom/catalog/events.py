"""Task events: messages, enrichment, verification, routing and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.catalog import fixtures as fx
from batchloom.catalog.fixtures import c
from batchloom.catalog.registry import query
from batchloom.functions import status as st
from batchloom.operators import checks, joins
from batchloom.plans import status as plans
from batchloom.sources.events import job_events, task_events

_HIT = "regexp_matches(text_payload, 'License|license')"


# --- messages -----------------------------------------------------------------------

@query(
    "required_fields",
    fx.with_(
        [fx.MESSAGES],
        "SELECT key, job_id, task_id, status FROM fx_messages WHERE has_attributes",
    ),
)
def required_fields(spark, sf):
    good, _ = checks.with_attributes(fx.messages(spark, sf))
    return good.select(
        "key",
        c("attributes")["JobUID"].alias("job_id"),
        c("attributes")["TaskUID"].alias("task_id"),
        c("attributes")["NewTaskState"].alias("status"),
    )


@query(
    "required_fields_rejects",
    fx.with_(
        [fx.MESSAGES],
        """SELECT key, payload, 'missing attributes' AS reason FROM fx_messages WHERE NOT has_attributes""",
    ),
)
def required_fields_rejects(spark, sf):
    _, bad = checks.with_attributes(fx.messages(spark, sf))
    return bad.select("key", st.payload_text(c("data")).alias("payload"), "reason")


@query(
    "task_events",
    fx.with_(
        [fx.MESSAGES],
        """SELECT job_id, task_id, status, job_name, 'r1' AS region, payload
FROM fx_messages WHERE has_attributes""",
    ),
)
def flat_task_events(spark, sf):
    return task_events(checks.with_attributes(fx.messages(spark, sf))[0])


@query(
    "base64_message",
    fx.with_([fx.MESSAGES], "SELECT key, base64(encode(payload)) AS data, payload FROM fx_messages"),
)
def base64_message(spark, sf):
    return fx.messages(spark, sf).select("key", "data", st.payload_text(c("data")).alias("payload"))


@query(
    "message_fields",
    fx.with_(
        [fx.MESSAGES],
        """SELECT key, regexp_extract(payload, 'taskUID=([^,]*)', 1) AS task_uid,
  'PENDING' AS previous_state, status AS current_state,
  date_trunc('second', ts)::TIMESTAMP + INTERVAL 7 HOUR AS event_time FROM fx_messages""",
    ),
)
def message_fields(spark, sf):
    body = fx.messages(spark, sf).select("key", st.payload_text(c("data")).alias("p"))
    return body.select(
        "key",
        st.payload_field(c("p"), "taskUID").alias("task_uid"),
        st.payload_field(c("p"), "previousState").alias("previous_state"),
        st.payload_field(c("p"), "currentState").alias("current_state"),
        st.payload_time(c("p")).alias("event_time"),
    )


@query(
    "time_formats",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS row_time,
  strftime(ts, '%Y-%m-%d-%H-%M-%S') AS path_time, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS link_time FROM events""",
)
def time_formats(spark, sf):
    ts = c("ts")
    return fx.table(spark, sf, "events").select(
        "event_id",
        st.row_time(ts).alias("row_time"),
        st.path_time(ts).alias("path_time"),
        st.link_time(ts).alias("link_time"),
    )


@query("time_minus_2h", "SELECT event_id, ts - INTERVAL 2 HOUR AS earlier FROM events")
def time_minus_2h(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", st.hours_before(c("ts"), 2).alias("earlier"))


@query(
    "task_index_of_id",
    fx.with_(
        [fx.TASKS_STATUS],
        """SELECT task_id, nullif(regexp_extract(task_id, 'group0-([0-9]+)', 1), '') AS index_text,
  nullif(regexp_extract(task_id, 'group0-([0-9]+)', 1), '')::BIGINT AS index_number,
  count(*)::BIGINT AS n FROM fx_tasks_status GROUP BY ALL""",
    ),
)
def task_index_of_id(spark, sf):
    task = c("task_id")
    return (
        fx.tasks_status(spark, sf)
        .groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "task_id",
            st.task_index_text(task).alias("index_text"),
            st.task_index(task).alias("index_number"),
            "n",
        )
    )


# --- enrichment and verification --------------------------------------------------------

@query(
    "enrich_events_left",
    fx.with_(
        [fx.TASKS_STATUS, fx.JOB_ARRAY],
        """SELECT T.job_id, T.task_id, T.status, T.timestamp, J.sample_id, J.input_path, J.output_path,
  J.input_type, J.command
FROM fx_tasks_status T LEFT JOIN fx_job_array J ON T.job_id = J.job_id
  AND nullif(regexp_extract(T.task_id, 'group0-([0-9]+)', 1), '')::BIGINT = J.batch_task_index""",
    ),
)
def enrich_events_left(spark, sf):
    return joins.enrich_events(fx.tasks_status(spark, sf), fx.job_array(spark, sf))


_TASKS = """tasks AS (SELECT DISTINCT job_id, task_id FROM fx_tasks_status)"""
_OK = f"hits AS (SELECT DISTINCT job_uid, task_id FROM fx_task_logs WHERE {_HIT})"


def _tasks(spark, sf):
    return fx.tasks_status(spark, sf).select("job_id", "task_id").distinct()


@query(
    "verify_logs_semi",
    fx.with_(
        [fx.TASKS_STATUS, fx.TASK_LOGS, _TASKS, _OK],
        """SELECT job_id, task_id FROM tasks t
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.job_uid = t.job_id AND h.task_id = t.task_id)""",
    ),
)
def verify_logs_semi(spark, sf):
    return joins.verified(_tasks(spark, sf), fx.task_logs(spark, sf), fx.SUCCESS)


@query(
    "verify_logs_anti",
    fx.with_(
        [fx.TASKS_STATUS, fx.TASK_LOGS, _TASKS, _OK],
        """SELECT job_id, task_id FROM tasks t
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.job_uid = t.job_id AND h.task_id = t.task_id)""",
    ),
)
def verify_logs_anti(spark, sf):
    return joins.unverified(_tasks(spark, sf), fx.task_logs(spark, sf), fx.SUCCESS)


@query(
    "verify_any",
    fx.with_(
        [fx.TASK_LOGS],
        f"SELECT job_uid, task_id, bool_or({_HIT}) AS succeeded FROM fx_task_logs GROUP BY ALL",
    ),
)
def verify_any(spark, sf):
    return joins.any_success(fx.task_logs(spark, sf), fx.SUCCESS)


@query(
    "task_verdicts",
    fx.with_(
        [fx.TASKS_STATUS, fx.TASK_LOGS, _TASKS, _OK],
        """SELECT t.job_id, t.task_id,
  CASE WHEN h.task_id IS NULL THEN 'VERIFIED_FAILED' ELSE 'VERIFIED_OK' END AS verdict
FROM tasks t LEFT JOIN hits h ON h.job_uid = t.job_id AND h.task_id = t.task_id""",
    ),
)
def task_verdicts(spark, sf):
    return joins.with_verdict(_tasks(spark, sf), fx.task_logs(spark, sf), fx.SUCCESS)


@query(
    "log_scan",
    fx.with_(
        [fx.TASK_LOGS],
        """SELECT job_uid, task_id, text_payload FROM fx_task_logs
WHERE job_uid = 'job-3' AND task_id = 'job-3-group0-4' AND regexp_matches(text_payload, '[Ll]icense|the ')""",
    ),
)
def log_scan(spark, sf):
    logs = fx.task_logs(spark, sf)
    return joins.task_log_lines(logs, "job-3", "job-3-group0-4", "[Ll]icense|the ")


@query(
    "task_lookup",
    fx.with_(
        [fx.JOB_ARRAY],
        """SELECT sample_id, input_path, output_path, input_type, command FROM fx_job_array
WHERE job_id = 'job-2' AND batch_task_index = 7""",
    ),
)
def task_lookup(spark, sf):
    return joins.task_info(fx.job_array(spark, sf), "job-2", "job-2-group0-7")


# --- routing, verdict rows, notifications ----------------------------------------------------

@query(
    "state_routing",
    fx.with_(
        [fx.TASKS_STATUS],
        """SELECT job_id, task_id, status, timestamp, CASE status WHEN 'SUCCEEDED' THEN 'verify'
  WHEN 'FAILED' THEN 'notify' ELSE 'store' END AS route FROM fx_tasks_status""",
    ),
)
def state_routing(spark, sf):
    return fx.tasks_status(spark, sf).withColumn("route", checks.route(c("status")))


@query(
    "terminal_jobs",
    fx.with_(
        [fx.JOB_EVENTS],
        "SELECT job_uid, job_name, status FROM fx_job_events WHERE status IN ('SUCCEEDED', 'FAILED')",
    ),
)
def terminal_jobs(spark, sf):
    events = job_events(fx.job_messages(spark, sf))
    return events.filter(checks.job_ended(c("status"))).select("job_uid", "job_name", "status")


_VERDICTS = """verdicts AS (
  SELECT T.job_id, T.task_id, CASE WHEN h.task_id IS NULL THEN 'VERIFIED_FAILED' ELSE 'VERIFIED_OK' END AS status,
    T.timestamp + INTERVAL 1 SECOND AS timestamp
  FROM fx_tasks_status T LEFT JOIN hits h ON h.job_uid = T.job_id AND h.task_id = T.task_id
  WHERE T.status = 'SUCCEEDED')"""


@query(
    "status_with_verdicts",
    fx.with_(
        [fx.TASKS_STATUS, fx.TASK_LOGS, _OK, _VERDICTS],
        """SELECT job_id, task_id, status, timestamp FROM fx_tasks_status
UNION ALL SELECT job_id, task_id, status, timestamp FROM verdicts""",
    ),
)
def status_with_verdicts(spark, sf):
    return plans.with_verdicts(
        fx.tasks_status(spark, sf), fx.task_logs(spark, sf), fx.SUCCESS, delay_seconds=1
    )


_LOG = """' Check the <https://console.cloud.google.com/logs/query;query=logName%3D%22projects%2Fp1%2Flogs%2Fbatch_task_logs%22%20OR%20%22projects%2Fp1%2Flogs%2Fbatch_agent_logs%22%20labels.job_uid%3D%22' || job_id || '%22%20' || task_part
    || 'timestamp%3E%3D%22' || strftime(clock - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '%22%20timestamp%3C%3D%22'
    || strftime(clock, '%Y-%m-%dT%H:%M:%S') || '%22?project=p1|logs> for more info.'"""
_JOB_LINK = """'<https://console.cloud.google.com/batch/jobsDetail/regions/r1/jobs/' || job_name || '/details?project=p1|' || job_name || '>'"""


@query(
    "notifications",
    fx.with_(
        [
            fx.TASKS_STATUS,
            fx.JOB_ARRAY,
            """told AS (SELECT T.job_id, T.task_id, T.status, 'n-' || T.job_id AS job_name,
  TIMESTAMP '2024-02-01 01:02:03' AS clock, J.sample_id,
  CASE WHEN T.status <> 'FAILED' THEN J.output_path END AS output_path,
  'resource.labels.task_id%3D%22task%2F' || T.task_id || '%2F0%2F0%22' AS task_part
FROM fx_tasks_status T LEFT JOIN fx_job_array J ON T.job_id = J.job_id
  AND nullif(regexp_extract(T.task_id, 'group0-([0-9]+)', 1), '')::BIGINT = J.batch_task_index
WHERE T.status IN ('FAILED', 'VERIFIED_OK', 'VERIFIED_FAILED'))""",
        ],
        f"""SELECT job_id, task_id, status, '_Task_ execution *' || status || '* for sample_id='
  || coalesce(sample_id, 'None') || ' within ' || {_JOB_LINK} || '.' || {_LOG}
  || CASE WHEN coalesce(output_path, '') = '' THEN '' ELSE
    ' See the <https://console.cloud.google.com/storage/browser/' || replace(output_path, 's3://', '')
    || '?project=p1|output directory> for the generated results.' END AS text FROM told""",
    ),
)
def notifications(spark, sf):
    events = fx.tasks_status(spark, sf).select(
        "job_id", "task_id", "status", fx.text("n-", c("job_id")).alias("job_name")
    )
    clock = F.lit("2024-02-01 01:02:03").cast("timestamp_ntz")
    return plans.task_notifications(events, fx.job_array(spark, sf), clock, "p1", "r1")


@query(
    "job_notifications",
    fx.with_(
        [
            fx.JOB_EVENTS,
            """told AS (SELECT job_uid AS job_id, job_name, status, '' AS task_part,
  TIMESTAMP '2024-02-01 01:02:03' AS clock FROM fx_job_events WHERE status IN ('SUCCEEDED', 'FAILED'))""",
        ],
        f"""SELECT job_id AS job_uid, job_name, status, '_Job_ execution *' || status || '* for '
  || {_JOB_LINK} || '. ' || {_LOG} AS text FROM told""",
    ),
)
def job_notifications(spark, sf):
    clock = F.lit("2024-02-01 01:02:03").cast("timestamp_ntz")
    return plans.job_notifications(job_events(fx.job_messages(spark, sf)), clock, "p1", "r1")
