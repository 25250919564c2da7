"""Views that give the test tables the shape of the library's own tables.

Each view exists twice: as a DataFrame and as a SQL common table expression.
All of them are projections of whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import constants as K

SUCCESS = ["License", "license"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(*parts) -> Column:
    """Concatenate texts and columns."""
    return F.concat(
        *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts]
    )


def c(name: str) -> Column:
    return F.col(name)


def job_array(spark: SparkSession, sf: str) -> DataFrame:
    """One task per customer, ten per job; every seventh has no label."""
    key = c("c_custkey")
    job = F.expr("c_custkey div 10")
    path = text("gs://demo/NA", key, "/NA", key, ".cram")
    return table(spark, sf, "customer").select(
        text("job-", job).alias("job_id"),
        text("jobname-", job).alias("job_name"),
        F.when(key % 7 != 0, c("c_mktsegment")).alias("job_label"),
        (key % 10).alias("batch_task_index"),
        text("NA", key).alias("sample_id"),
        path.alias("input_path"),
        F.lit("cram").alias("input_type"),
        text("s3://out/", c("c_mktsegment"), "/NA", key).alias("output_path"),
        text("run --cram-input ", path).alias("command"),
        (
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"), F.lit(0))
        ).alias("timestamp"),
    )


JOB_ARRAY = """fx_job_array AS (
  SELECT 'job-' || (c_custkey // 10) AS job_id, 'jobname-' || (c_custkey // 10) AS job_name,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS job_label,
    c_custkey % 10 AS batch_task_index, 'NA' || c_custkey AS sample_id,
    'gs://demo/NA' || c_custkey || '/NA' || c_custkey || '.cram' AS input_path,
    'cram' AS input_type, 's3://out/' || c_mktsegment || '/NA' || c_custkey AS output_path,
    'run --cram-input gs://demo/NA' || c_custkey || '/NA' || c_custkey || '.cram' AS command,
    TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS timestamp
  FROM customer)"""


def task_id(user: str) -> Column:
    """Task id of a user; users with ``user % 11 = 10`` get one without an index."""
    u = c(user)
    return text(
        "job-",
        F.expr(f"{user} div 10"),
        F.when(u % 11 == 10, "-x").otherwise("-group0-"),
        u % 10,
    )


def status_name() -> Column:
    return (
        F.when(c("event_type") == "click", "RUNNING")
        .when(c("event_type") == "view", "SUCCEEDED")
        .when(c("event_type") == "purchase", "VERIFIED_OK")
        .when(c("event_type") == "signup", "VERIFIED_FAILED")
        .otherwise("FAILED")
    )


def to_second(ts: str = "ts") -> Column:
    return F.date_trunc("second", c(ts)).cast("timestamp_ntz")


def tasks_status(spark: SparkSession, sf: str) -> DataFrame:
    """One status row per event."""
    return table(spark, sf, "events").select(
        text("job-", F.expr("user_id div 10")).alias("job_id"),
        task_id("user_id").alias("task_id"),
        status_name().alias("status"),
        to_second().alias("timestamp"),
    )


_TASK_ID = """'job-' || (user_id // 10)
      || CASE WHEN user_id % 11 = 10 THEN '-x' ELSE '-group0-' END || (user_id % 10)"""
_STATUS = """CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'SUCCEEDED'
      WHEN 'purchase' THEN 'VERIFIED_OK' WHEN 'signup' THEN 'VERIFIED_FAILED' ELSE 'FAILED' END"""

TASKS_STATUS = f"""fx_tasks_status AS (
  SELECT 'job-' || (user_id // 10) AS job_id, {_TASK_ID} AS task_id, {_STATUS} AS status,
    date_trunc('second', ts)::TIMESTAMP AS timestamp
  FROM events)"""


def day_status(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Status rows at whole days, so that many times are equal, and with null task ids."""
    e = table(spark, sf, "events") if events is None else events
    return e.select(
        text("job-", F.expr("user_id div 10")).alias("job_id"),
        F.when(c("user_id") % 7 != 0, task_id("user_id")).alias("task_id"),
        status_name().alias("status"),
        F.date_trunc("day", c("ts")).cast("timestamp_ntz").alias("timestamp"),
    )


DAY_STATUS = f"""fx_day_status AS (
  SELECT 'job-' || (user_id // 10) AS job_id,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE {_TASK_ID} END AS task_id, {_STATUS} AS status,
    date_trunc('day', ts)::TIMESTAMP AS timestamp
  FROM events)"""


def task_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is one log line of a task; documents are dealt out over the users."""
    users = table(spark, sf, "events").agg((F.max("user_id") + 1).alias("n")).scalar()
    return (
        table(spark, sf, "documents")
        .select((c("doc_id") % users).alias("user_id"), "text")
        .select(
            text("job-", F.expr("user_id div 10")).alias("job_uid"),
            text("job-", F.expr("user_id div 10"), "-group0-", c("user_id") % 10).alias("task_id"),
            c("text").alias("text_payload"),
        )
    )


TASK_LOGS = """fx_task_logs AS (
  SELECT 'job-' || (u // 10) AS job_uid, 'job-' || (u // 10) || '-group0-' || (u % 10) AS task_id,
    text AS text_payload
  FROM (SELECT doc_id % (SELECT max(user_id) + 1 FROM events) AS u, text FROM documents))"""


def encoded(body: Column) -> Column:
    """Base64 text on one line."""
    return F.replace(F.base64(body.cast("binary")), F.lit("\r\n"), F.lit(""))


def messages(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Every event as a task message; every thirteenth carries no attributes.

    ``key`` is the event number, kept for joining results back.
    """
    e = table(spark, sf, "events") if events is None else events
    user = c("user_id")
    job = text("job-", F.expr("user_id div 10"))
    name = text(
        "projects/p1/locations/r1/jobs/jobname-",
        F.expr("user_id div 10"),
        "/taskGroups/group0/tasks/",
        user % 10,
    )
    body = text(
        "Task state was updated: taskUID=",
        task_id("user_id"),
        ", previousState=PENDING, currentState=",
        status_name(),
        ", timestamp=",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "-07:00",
    )
    attributes = F.create_map(
        F.lit("JobUID"), job,
        F.lit("NewTaskState"), status_name(),
        F.lit("TaskName"), name,
        F.lit("TaskUID"), task_id("user_id"),
        F.lit("Region"), F.lit("r1"),
    )
    return e.select(
        c("event_id").alias("key"),
        F.when(c("event_id") % 13 != 0, attributes).alias("attributes"),
        encoded(body).alias("data"),
    )


MESSAGE_TEXT = f"""'Task state was updated: taskUID=' || {_TASK_ID}
      || ', previousState=PENDING, currentState=' || {_STATUS}
      || ', timestamp=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-07:00'"""

MESSAGES = f"""fx_messages AS (
  SELECT event_id AS key, event_id % 13 <> 0 AS has_attributes,
    'job-' || (user_id // 10) AS job_id, {_TASK_ID} AS task_id, {_STATUS} AS status,
    'jobname-' || (user_id // 10) AS job_name, {MESSAGE_TEXT} AS payload, ts
  FROM events)"""


def job_messages(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Every order as a job message; one job per customer."""
    o = table(spark, sf, "orders") if orders is None else orders
    state = (
        F.when(c("o_orderstatus") == "F", "SUCCEEDED")
        .when(c("o_orderstatus") == "P", "FAILED")
        .otherwise("RUNNING")
    )
    attributes = F.create_map(
        F.lit("JobUID"), text("uid-", c("o_custkey")),
        F.lit("JobName"), text("projects/p1/locations/r1/jobs/job-", c("o_custkey")),
        F.lit("NewJobState"), state,
        F.lit("Region"), F.lit("r1"),
    )
    body = text("Job state was updated: jobUID=uid-", c("o_custkey"), ", currentState=", state)
    return o.select(
        c("o_orderkey").alias("key"),
        attributes.alias("attributes"),
        encoded(body).alias("data"),
    )


JOB_EVENTS = """fx_job_events AS (
  SELECT o_orderkey AS key, 'uid-' || o_custkey AS job_uid, 'job-' || o_custkey AS job_name,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status
  FROM orders)"""


def jobs_directory(spark: SparkSession, sf: str) -> DataFrame:
    """One job per customer; every fifth carries no label, every eleventh an empty one."""
    key = c("c_custkey")
    label = F.when(key % 11 == 0, F.lit("")).otherwise(text("Supplier-", key % 150))
    labels = F.when(
        key % 5 != 0, F.create_map(F.lit(K.JOB_LABEL_KEY), label, F.lit("team"), c("c_mktsegment"))
    ).otherwise(F.create_map(F.lit("team"), c("c_mktsegment")))
    return table(spark, sf, "customer").select(
        text("job-", key).alias("job_name"), text("uid-", key).alias("job_uid"), labels.alias("labels")
    )


JOBS_DIRECTORY = """fx_jobs AS (
  SELECT 'job-' || c_custkey AS job_name, 'uid-' || c_custkey AS job_uid,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
      ELSE 'Supplier-' || (c_custkey % 150) END AS job_label, c_mktsegment AS team
  FROM customer)"""


def job_list(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered list with one entry per order; labels repeat."""
    key = c("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("pos"),
        text("Supplier-", c("o_custkey") % 1000).alias("label"),
        text("gs://cfg/d", key % 9, "/batch_config", key, ".json").alias("config_uri"),
    )


JOB_LIST = """fx_job_list AS (
  SELECT o_orderkey AS pos, 'Supplier-' || (o_custkey % 1000) AS label,
    'gs://cfg/d' || (o_orderkey % 9) || '/batch_config' || o_orderkey || '.json' AS config_uri
  FROM orders)"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as an object listing, without query and fragment."""
    uri = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "gs://")
    return table(spark, sf, "pages").select("page_id", uri.alias("uri"))


LISTING = r"""fx_listing AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', 'gs://') AS uri
  FROM pages),
fx_objects AS (
  SELECT page_id, uri, regexp_extract(uri, '^gs://([^/]+)/?(.*)$', 1) AS bucket,
    regexp_extract(uri, '^gs://([^/]+)/?(.*)$', 2) AS name
  FROM fx_listing)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per customer, grouped in jobs by nation."""
    key = c("c_custkey")
    return table(spark, sf, "customer").select(
        c("c_nationkey").cast("string").alias("job_id"),
        key.alias("pos"),
        F.array(text("NA", key), text("gs://in/NA", key, ".cram"), F.lit("extra")).alias("tokens"),
    )


SAMPLES = """fx_samples AS (
  SELECT c_nationkey::VARCHAR AS job_id, c_custkey AS pos, 'NA' || c_custkey AS sample_id,
    'gs://in/NA' || c_custkey || '.cram' AS path
  FROM customer)"""


def with_(ctes: list[str], body: str) -> str:
    """A SQL text from view definitions and a body."""
    return "WITH " + ",\n".join(ctes) + "\n" + body
