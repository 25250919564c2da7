"""Streaming jobs run to completion over file streams of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom import schemas
from batchloom.catalog import fixtures as fx
from batchloom.catalog.events import _JOB_LINK, _LOG, _OK
from batchloom.catalog.fixtures import c, text
from batchloom.catalog.launching import LAUNCHER
from batchloom.catalog.registry import query
from batchloom.catalog.scheduling import _OBJECTS, _ROUTED, _STEPS, _TRIGGER, _routed, _stored
from batchloom.functions.status import payload_time
from batchloom.plans import schedule
from batchloom.session import is_folder, run_folder
from batchloom.sinks import tables
from batchloom.sinks.tables import read_table
from batchloom.sources.events import read_stream, task_events
from batchloom.sources.warehouse import tasks_status
from batchloom.streaming import counts, job_stream, latest_view, runner, status_stream


def _stream(spark, sf, name):
    """A table as a file stream: its parquet file, or all files of its folder."""
    schema, path = fx.table(spark, sf, name).schema, f"{sf}/{name}.parquet"
    if is_folder(spark, path):
        return read_stream(spark, path, schema, "parquet")
    # A stream reads folders only; the filter looks at the names of files.
    return read_stream(spark, sf, schema, "parquet", pathGlobFilter=f"{name}.parquet")


def _folders(spark, name):
    base = run_folder(spark, name)
    return base + "/out", base + "/checkpoint"


def _event_time(events):
    return payload_time(c("payload"))


def _task_messages(spark, sf):
    stream = fx.messages(spark, sf, _stream(spark, sf, "events"))
    return stream.select("attributes", "data")


_ROWS = """status_rows AS (
  SELECT job_id, task_id, status, date_trunc('second', ts)::TIMESTAMP + INTERVAL 7 HOUR AS timestamp
  FROM fx_messages WHERE has_attributes)"""
_VERDICTS = """verdicts AS (
  SELECT r.job_id, r.task_id, CASE WHEN h.task_id IS NULL THEN 'VERIFIED_FAILED' ELSE 'VERIFIED_OK' END AS status,
    timestamp + INTERVAL 1 SECOND AS timestamp
  FROM status_rows r LEFT JOIN hits h ON h.job_uid = r.job_id AND h.task_id = r.task_id
  WHERE r.status = 'SUCCEEDED')"""


@query("stream_ingest", fx.with_([fx.MESSAGES, _ROWS], "SELECT * FROM status_rows"))
def stream_ingest(spark, sf):
    out, checkpoint = _folders(spark, "ingest")
    status_stream.append_status(
        _task_messages(spark, sf), out, checkpoint, _event_time, once=True
    ).awaitTermination()
    return tasks_status(spark, out)


@query(
    "stream_enrich",
    fx.with_(
        [fx.MESSAGES, fx.JOB_ARRAY],
        """SELECT m.job_id, m.task_id, m.status, m.job_name, J.sample_id, J.input_path, J.output_path,
  J.input_type, J.command
FROM fx_messages m LEFT JOIN fx_job_array J ON m.job_id = J.job_id
  AND nullif(regexp_extract(m.task_id, 'group0-([0-9]+)', 1), '')::BIGINT = J.batch_task_index
WHERE has_attributes""",
    ),
)
def stream_enrich(spark, sf):
    out, checkpoint = _folders(spark, "enrich")
    status_stream.append_enriched(
        _task_messages(spark, sf), fx.job_array(spark, sf), out, checkpoint, once=True
    ).awaitTermination()
    return read_table(spark, out).drop("region", "payload")


def _ingest(spark, sf, name):
    out, checkpoint = _folders(spark, name)
    sinks = status_stream.StatusSinks(out + "/status", out + "/rejects", out + "/texts")
    status_stream.ingest_status(
        _task_messages(spark, sf),
        lambda: fx.task_logs(spark, sf),
        sinks,
        checkpoint,
        job_array=lambda: fx.job_array(spark, sf),
        clock=_event_time,
        patterns=fx.SUCCESS,
        project="p1",
        region="r1",
        message_clock=F.lit("2024-02-01 01:02:03").cast("timestamp_ntz"),
        once=True,
    ).awaitTermination()
    return sinks


@query(
    "stream_verify",
    fx.with_(
        [fx.MESSAGES, fx.TASK_LOGS, _ROWS, _OK, _VERDICTS],
        "SELECT * FROM status_rows UNION ALL SELECT * FROM verdicts",
    ),
)
def stream_verify(spark, sf):
    return tasks_status(spark, _ingest(spark, sf, "verify").status)


@query(
    "stream_rejects",
    fx.with_(
        [fx.MESSAGES],
        """SELECT base64(encode(payload)) AS data, 'missing attributes' AS reason
FROM fx_messages WHERE NOT has_attributes""",
    ),
)
def stream_rejects(spark, sf):
    return read_table(spark, _ingest(spark, sf, "rejects").rejects).select("data", "reason")


@query(
    "stream_notifications",
    fx.with_(
        [
            fx.MESSAGES,
            fx.TASK_LOGS,
            fx.JOB_ARRAY,
            _OK,
            """ended AS (SELECT m.job_id, m.task_id, m.job_name,
  CASE WHEN m.status = 'FAILED' THEN 'FAILED' WHEN h.task_id IS NULL THEN 'VERIFIED_FAILED'
    ELSE 'VERIFIED_OK' END AS status
  FROM fx_messages m LEFT JOIN hits h ON h.job_uid = m.job_id AND h.task_id = m.task_id
  WHERE has_attributes AND m.status IN ('SUCCEEDED', 'FAILED'))""",
            """told AS (SELECT T.job_id, T.task_id, T.status, T.job_name,
  TIMESTAMP '2024-02-01 01:02:03' AS clock, J.sample_id,
  CASE WHEN T.status <> 'FAILED' THEN J.output_path END AS output_path,
  'resource.labels.task_id%3D%22task%2F' || T.task_id || '%2F0%2F0%22' AS task_part
FROM ended T LEFT JOIN fx_job_array J ON T.job_id = J.job_id
  AND nullif(regexp_extract(T.task_id, 'group0-([0-9]+)', 1), '')::BIGINT = J.batch_task_index)""",
        ],
        f"""SELECT job_id, task_id, status, '_Task_ execution *' || status || '* for sample_id='
  || coalesce(sample_id, 'None') || ' within ' || {_JOB_LINK} || '.' || {_LOG}
  || CASE WHEN coalesce(output_path, '') = '' THEN '' ELSE
    ' See the <https://console.cloud.google.com/storage/browser/' || replace(output_path, 's3://', '')
    || '?project=p1|output directory> for the generated results.' END AS text FROM told""",
    ),
)
def stream_notifications(spark, sf):
    texts = read_table(spark, _ingest(spark, sf, "texts").notifications)
    return texts.select("job_id", "task_id", "status", "text")


@query(
    "stream_latest_status",
    fx.with_(
        [fx.DAY_STATUS],
        """SELECT DISTINCT job_id, task_id, status, timestamp FROM fx_day_status T
WHERE timestamp = (SELECT max(timestamp) FROM fx_day_status S WHERE S.task_id = T.task_id)""",
    ),
)
def stream_latest_status(spark, sf):
    out, checkpoint = _folders(spark, "latest")
    rows = fx.day_status(spark, sf, _stream(spark, sf, "events"))
    latest_view.follow_latest(rows, out, checkpoint, once=True).awaitTermination()
    compacted = out + "-compacted"
    latest_view.compact_view(tasks_status(spark, out), compacted)
    return latest_view.latest_view(tasks_status(spark, compacted))


@query(
    "stream_deduplicated",
    fx.with_(
        [fx.MESSAGES],
        """SELECT job_id, task_id, status, payload, job_name FROM (
  SELECT DISTINCT job_id, task_id, status, payload, job_name FROM fx_messages WHERE has_attributes)
UNION ALL SELECT NULL, NULL, NULL, payload, NULL FROM fx_messages, range(2) WHERE NOT has_attributes""",
    ),
)
def stream_deduplicated(spark, sf):
    """Every message is delivered twice; those without attributes all stay."""
    out, checkpoint = _folders(spark, "dedupe")
    twice = _task_messages(spark, sf).union(_task_messages(spark, sf))
    once = task_events(status_stream.deduplicated(twice))
    runner.append_rows(once, out, checkpoint, once=True).awaitTermination()
    return read_table(spark, out).select("job_id", "task_id", "status", "payload", "job_name")


# Rows of the day's log by two streams, and the complete ones by a batch append.
_THREE_TIMES = """SELECT job_id, task_id, status, timestamp FROM fx_day_status, range(2)
UNION ALL SELECT job_id, task_id, status, timestamp FROM fx_day_status
WHERE job_id IS NOT NULL AND task_id IS NOT NULL AND status IS NOT NULL AND timestamp IS NOT NULL"""


def _append_day(spark, sf, out, checkpoint):
    rows = fx.day_status(spark, sf, _stream(spark, sf, "events"))
    runner.append_rows(rows, out, checkpoint, once=True).awaitTermination()


@query("append_after_stream", fx.with_([fx.DAY_STATUS], _THREE_TIMES))
def append_after_stream(spark, sf):
    """A stream, a batch append and a second stream fill one table."""
    out, checkpoint = _folders(spark, "shared")
    _append_day(spark, sf, out, checkpoint)
    tables.append(fx.day_status(spark, sf), out, schemas.TASKS_STATUS)
    _append_day(spark, sf, out, checkpoint + "-2")
    return tasks_status(spark, out)


@query(
    "stream_restart",
    fx.with_([fx.DAY_STATUS], "SELECT job_id, task_id, status, timestamp FROM fx_day_status, range(2)"),
)
def stream_restart(spark, sf):
    """Restarted from its checkpoint a stream adds nothing; from a new one, all again."""
    out, checkpoint = _folders(spark, "restart")
    _append_day(spark, sf, out, checkpoint)
    _append_day(spark, sf, out, checkpoint)
    _append_day(spark, sf, out, checkpoint + "-new")
    compacted = out + "-compacted"
    tables.compact(spark, out, compacted, schemas.TASKS_STATUS)
    return tasks_status(spark, compacted)


# Every seventh order lacks its status.
_GAPPED = """gapped AS (SELECT o_orderkey::VARCHAR AS job_id, o_custkey::VARCHAR AS task_id,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders)"""


def _gapped(spark, sf):
    key = c("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        key.cast("string").alias("job_id"),
        c("o_custkey").cast("string").alias("task_id"),
        F.when(key % 7 != 0, c("o_orderstatus")).alias("status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
    )


@query("append_rejects", fx.with_([_GAPPED], "SELECT job_id, task_id FROM gapped WHERE status IS NULL"))
def append_rejects(spark, sf):
    out, _ = _folders(spark, "rejects")
    return tables.append(_gapped(spark, sf), out, schemas.TASKS_STATUS).select("job_id", "task_id")


@query(
    "truncated_table",
    fx.with_([_GAPPED], "SELECT job_id, task_id, status FROM gapped WHERE status IS NOT NULL"),
)
def truncated_table(spark, sf):
    """Filled, truncated, and filled again."""
    out, _ = _folders(spark, "truncated")
    rows = _gapped(spark, sf)
    tables.append(rows, out, schemas.TASKS_STATUS)
    tables.truncate(spark, out, schemas.TASKS_STATUS)
    tables.append(rows, out, schemas.TASKS_STATUS)
    return tasks_status(spark, out).drop("timestamp")


@query(
    "stream_triggers",
    fx.with_(
        [
            fx.JOB_EVENTS,
            fx.JOBS_DIRECTORY,
            fx.JOB_LIST,
            _STEPS,
            """all_steps AS (SELECT * FROM steps WHERE next_label IS NOT NULL
  UNION ALL SELECT * FROM (SELECT '' AS label, label AS next_label, config_uri AS next_config_uri
    FROM fx_job_list ORDER BY pos LIMIT 1))""",
        ],
        f"""SELECT e.job_name, {_TRIGGER}
FROM fx_job_events e JOIN fx_jobs j ON e.job_name = j.job_name
  JOIN all_steps s ON s.label = j.job_label
WHERE e.status IN ('SUCCEEDED', 'FAILED') AND j.job_label IS NOT NULL""",
    ),
)
def stream_triggers(spark, sf):
    out, checkpoint = _folders(spark, "triggers")
    messages = fx.job_messages(spark, sf, _stream(spark, sf, "orders"))
    job_stream.chain_jobs(
        messages.select("attributes", "data"),
        lambda: fx.jobs_directory(spark, sf),
        lambda: fx.job_list(spark, sf),
        out,
        checkpoint,
        once=True,
    ).awaitTermination()
    return read_table(spark, out).select("job_name", "target_uri", "body")


@query("stream_routes", fx.with_([fx.LISTING, _OBJECTS, _ROUTED], "SELECT * FROM routed"))
def stream_routes(spark, sf):
    out, checkpoint = _folders(spark, "routes")
    stored = _stored(spark, sf)
    contents = (
        stored.filter(c("content").isNotNull())
        .groupBy("bucket", "name")
        .agg(F.max("content").alias("content"))
    )
    job_stream.route_objects(
        _stored(spark, sf, _stream(spark, sf, "pages")).select("bucket", "name"),
        lambda: contents,
        lambda: stored.select("bucket", c("list_name").alias("name")),
        out,
        checkpoint,
        once=True,
    ).awaitTermination()
    return read_table(spark, out)


# --- triggers carried out ---------------------------------------------------------------

# What the routes lead to, by the length of their target: batch configs, of which
# every third is missing and every fifth broken, whose manifests hold some customers
# each; and job lists of two entries.
_CARRIED_OUT = f"""config_routes AS (SELECT DISTINCT 'gs://' || bucket || '/' || target AS config_uri, job_label, length(target) AS n
  FROM routed WHERE route = 'config'),
reasons AS (SELECT *, substr(sha256(config_uri || '|' || coalesce(job_label, '') || '|2024-03-05 06:07:08'), 1, 10) AS job_id,
    CASE WHEN n % 3 = 0 THEN 'batch config not found' WHEN n % 5 = 0 THEN 'batch config not usable' END AS reason FROM config_routes),
made AS (SELECT r.*, 'NA' || c_custkey AS sample, 's3://in/' || c_custkey || '.x' AS path,
    row_number() OVER (PARTITION BY job_id ORDER BY c_custkey) - 1 AS i
  FROM reasons r JOIN customer ON c_custkey % 40 = n WHERE reason IS NULL),
list_routes AS (SELECT DISTINCT 'gs://' || bucket || '/' || target AS uri, length(target) AS n FROM routed WHERE route = 'list')
SELECT 'task' AS kind, job_id AS place, job_label AS label, i AS n,
  '--api-host h --machine nx1 {K.APP_FLAG} app-1 --google-sa sa@p1 --   --cram-input ' || path
    || '  --output-directory s3://o/' || sample || '/2024-03-05-06-07-08 ' AS body FROM made
UNION ALL SELECT 'job', job_id, min(job_label), NULL, 'job-' || job_id FROM made GROUP BY job_id
UNION ALL SELECT 'reject', config_uri, job_label, NULL, reason FROM reasons WHERE reason IS NOT NULL
UNION ALL SELECT 'reject', config_uri, job_label, NULL, 'no input files' FROM reasons
  WHERE reason IS NULL AND n NOT IN (SELECT c_custkey % 40 FROM customer)
UNION ALL SELECT 'copy', 'gs://sched/jobs.csv', uri, NULL, 'a' || n || ', gs://cfg/a/x.json' || chr(10) || 'b' || n || ', gs://cfg/b/x.json'
  FROM list_routes
UNION ALL SELECT 'trigger', 'gs://cfg/a/{K.TRIGGER_FILE}', uri, NULL,
  to_json({{'{K.JOB_LABEL_KEY}': 'a' || n, '{K.TRIGGER_CONFIG_KEY}': 'x.json'}})::VARCHAR FROM list_routes"""


def _texts_of_routes(spark, sf):
    """Batch configs, job lists and the run config that the routes lead to: (uri, text)."""
    routed, n = _routed(spark, sf), F.length("target")
    config = text(
        '{"run_options": {}, "input_options": {"input_type": "cram", "input_list": "gs://in/', n,
        '.txt", "config": "gs://cfg/run.json"}}',
    )
    configs = routed.filter((c("route") == "config") & (n % 3 != 0)).select(
        schedule.routed_uri().alias("uri"), F.when(n % 5 == 0, "{broken").otherwise(config).alias("text")
    )
    lists = routed.filter(c("route") == "list").select(
        schedule.routed_uri().alias("uri"), text("a", n, ", gs://cfg/a/x.json\nb", n, ", gs://cfg/b/x.json").alias("text")
    )
    options = (
        f'{{"{K.OPTIONS_KEY}": {{"--output-directory": "s3://o/${{SAMPLE_ID}}/<date>"}}, '
        f'"{K.LAUNCHER_KEY}": {{"api_host": "h"}}}}'
    )
    run = fx.table(spark, sf, "region").limit(1).select(F.lit("gs://cfg/run.json").alias("uri"), F.lit(options).alias("text"))
    return configs.unionByName(lists).distinct().unionByName(run)


@query("stream_routed_jobs", fx.with_([fx.LISTING, _OBJECTS, _ROUTED], "").rstrip() + ",\n" + _CARRIED_OUT)
def stream_routed_jobs(spark, sf):
    """Task rows, directory rows and rejects of config routes, triggers and copies of list routes."""
    base, checkpoint = _folders(spark, "carried-out")
    stored, key = _stored(spark, sf), c("c_custkey")
    contents = stored.filter(c("content").isNotNull()).groupBy("bucket", "name").agg(F.max("content").alias("content"))
    manifests = fx.table(spark, sf, "customer").select(
        text("gs://in/", key % 40, ".txt").alias("uri"), key.alias("line_no"),
        F.array(text("NA", key), text("gs://in/", key, ".x")).alias("tokens"),
    )
    stores = job_stream.TriggerStores(
        lambda: contents, lambda: stored.select("bucket", c("list_name").alias("name")),
        lambda: _texts_of_routes(spark, sf), lambda: manifests,
    )
    sinks = job_stream.TriggerSinks(*[f"{base}/{n}" for n in ("routes", "tasks", "lists", "triggers", "jobs", "rejects")])
    job_stream.follow_triggers(
        _stored(spark, sf, _stream(spark, sf, "pages")).select("bucket", "name"), stores, sinks, LAUNCHER,
        "gs://sched/jobs.csv", checkpoint, F.lit("2024-03-05 06:07:08"), once=True,
    ).awaitTermination()

    def rows(kind, path, place, label, n, body):
        columns = [F.lit(kind).alias("kind"), place.alias("place"), label.alias("label"), n.alias("n"), body.alias("body")]
        return read_table(spark, path).select(*columns)

    none = F.lit(None).cast("bigint")
    label = c("labels")[K.JOB_LABEL_KEY]
    return (
        rows("task", sinks.tasks, c("job_id"), c("job_label"), c("batch_task_index"), c("command"))
        .unionByName(rows("job", sinks.jobs, c("job_uid"), label, none, c("job_name")))
        .unionByName(rows("reject", sinks.rejects, c("config_uri"), c("job_label"), none, c("reason")))
        .unionByName(rows("copy", sinks.lists, c("uri"), c("source_uri"), none, c("text")))
        .unionByName(rows("trigger", sinks.triggers, c("target_uri"), c("uri"), none, c("body")))
    )


# --- verdicts that wait ---------------------------------------------------------------------

# Documents as log lines at hours of a month. The first event and the first document
# lie far ahead, so that the watermarks pass all others.
_TIMED = """timed_logs AS (
  SELECT 'job-' || (u // 10) AS job_uid, 'job-' || (u // 10) || '-group0-' || (u % 10) AS task_id, text_payload,
    TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL '1' HOUR AS logged
  FROM (SELECT doc_id, doc_id % (SELECT max(user_id) + 1 FROM events) AS u, text AS text_payload FROM documents) WHERE doc_id <> 0),
successes AS (SELECT DISTINCT job_id, task_id, ts::TIMESTAMP AS done FROM (
  SELECT 'job-' || (user_id // 10) AS job_id, {task} AS task_id, {status} AS status, date_trunc('second', ts) AS ts, event_id FROM events)
  WHERE status = 'SUCCEEDED' AND event_id <> 0)""".format(task=fx._TASK_ID, status=fx._STATUS)


@query(
    "stream_verify_waiting",
    fx.with_(
        [_TIMED],
        """SELECT job_id, task_id, CASE WHEN EXISTS (SELECT 1 FROM timed_logs l WHERE l.job_uid = s.job_id AND l.task_id = s.task_id
    AND (contains(text_payload, 'License') OR contains(text_payload, 'license'))
    AND logged BETWEEN done - INTERVAL 5 DAY AND done + INTERVAL 12 HOUR) THEN 'VERIFIED_OK' ELSE 'VERIFIED_FAILED' END AS status,
  done + INTERVAL 1 SECOND AS timestamp FROM successes s""",
    ),
)
def stream_verify_waiting(spark, sf):
    """A line up to twelve hours after a success still counts for its verdict."""
    out, checkpoint = _folders(spark, "waiting")
    first, far = c("event_id") == 0, F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    rows = _stream(spark, sf, "events").select(
        text("job-", F.expr("user_id div 10")).alias("job_id"), fx.task_id("user_id").alias("task_id"),
        F.when(first, K.SUCCEEDED).otherwise(fx.status_name()).alias("status"),
        F.when(first, far).otherwise(fx.to_second()).alias("timestamp"),
    )
    users = fx.table(spark, sf, "events").agg((F.max("user_id") + 1).alias("n")).first().n
    user = c("doc_id") % users
    hours = F.make_dt_interval(F.lit(0), (c("doc_id") % 720).cast("int"), F.lit(0), F.lit(0))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    first_line = c("doc_id") == 0
    logs = _stream(spark, sf, "documents").select(
        F.when(first_line, "none").otherwise(text("job-", F.floor(user / 10))).alias("job_uid"),
        text("job-", F.floor(user / 10), "-group0-", user % 10).alias("task_id"),
        F.when(first_line, fx.SUCCESS[0]).otherwise(c("text")).alias("text_payload"),
        F.when(first_line, far).otherwise(start + hours).alias("timestamp"),
    )
    status_stream.append_verdicts(
        rows, logs, out, checkpoint, once=True, wait="12 hours", back="5 days", patterns=fx.SUCCESS
    ).awaitTermination()
    return tasks_status(spark, out).filter(c("timestamp") < far)


# --- counts kept up to date -------------------------------------------------------------------

@query(
    "stream_counts",
    fx.with_(
        [fx.DAY_STATUS, fx.JOB_ARRAY],
        """SELECT count(*)::BIGINT AS "TOTAL", count(*) FILTER (T.status = 'RUNNING')::BIGINT AS "RUNNING",
  count(*) FILTER (T.status IN ('VERIFIED_FAILED', 'VERIFIED_OK'))::BIGINT AS "SUCCEEDED",
  count(*) FILTER (T.status = 'FAILED')::BIGINT AS "FAILED",
  count(*) FILTER (T.status = 'VERIFIED_OK')::BIGINT AS "VERIFIED_OK",
  count(*) FILTER (T.status = 'VERIFIED_FAILED')::BIGINT AS "VERIFIED_FAILED"
FROM fx_day_status T JOIN fx_job_array J ON T.job_id = J.job_id
  AND J.batch_task_index::VARCHAR = nullif(regexp_extract(T.task_id, 'group0-([0-9]+)', 1), '')
WHERE T.timestamp = (SELECT max(timestamp) FROM fx_day_status S WHERE S.task_id = T.task_id)""",
    ),
)
def stream_counts(spark, sf):
    """The log in three micro-batches, in no order of time."""
    base, checkpoint = _folders(spark, "counts")
    fx.day_status(spark, sf).repartition(3).write.parquet(base + "/log")
    log = read_stream(spark, base + "/log", schemas.TASKS_STATUS, "parquet", maxFilesPerTrigger=1)
    sinks = counts.CountSinks(base + "/state", base + "/counts")
    counts.follow_counts(log, lambda: fx.job_array(spark, sf), sinks, checkpoint, once=True).awaitTermination()
    return counts.count_now(spark, sinks)
