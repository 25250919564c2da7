"""Job lists, successors and trigger files."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.catalog import fixtures as fx
from batchloom.catalog.fixtures import c, text
from batchloom.catalog.registry import query
from batchloom.operators.ordering import first_entry, successors
from batchloom.plans import schedule, submit
from batchloom.session import run_folder
from batchloom.sources import warehouse
from batchloom.sources.configs import trigger_fields
from batchloom.sources.events import job_events
from batchloom.sinks.files import write_job_list
from batchloom.sources.job_lists import TWO_FIELDS, job_list_rows, read_job_list
from batchloom.sources.manifests import split_lines

# --- job lists -------------------------------------------------------------------------

# Documents as job lists; every third gets its lines quoted in part.
_LIST_LINES = """lines AS (
  SELECT doc_id::VARCHAR AS uri, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(replace(body, chr(13), ''), chr(10)) AS parts FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '"a ""q"" , b" x,' || text || chr(10) || 'job,' ELSE text END AS body
    FROM documents)))"""


def _list_lines(spark, sf):
    body = F.when(
        c("doc_id") % 3 == 0, F.concat(F.lit('"a ""q"" , b" x,'), c("text"), F.lit("\njob,"))
    ).otherwise(c("text"))
    docs = fx.table(spark, sf, "documents").select(
        c("doc_id").cast("string").alias("uri"), body.alias("text")
    )
    return split_lines(docs)


def _sql_field(first: int) -> str:
    part = "regexp_extract(line, '{}', {})"
    quoted = part.format(TWO_FIELDS, first)
    rest = part.format(TWO_FIELDS, first + 1)
    plain = part.format(TWO_FIELDS, first + 2)
    whole = f"""replace({quoted}, '""', '"') || {rest} || {plain}"""
    return f"regexp_replace({whole}, '^{K.WS}+|{K.WS}+$', '', 'g')"


@query(
    "job_list_scan",
    fx.with_(
        [_LIST_LINES],
        f"""SELECT uri, line_no AS pos, {_sql_field(1)} AS label, {_sql_field(4)} AS config_uri
FROM lines WHERE regexp_matches(line, '{TWO_FIELDS}')""",
    ),
)
def job_list_scan(spark, sf):
    return job_list_rows(_list_lines(spark, sf))[0]


@query(
    "job_list_rejects",
    fx.with_(
        [_LIST_LINES],
        f"SELECT uri, line_no, line FROM lines WHERE NOT regexp_matches(line, '{TWO_FIELDS}')",
    ),
)
def job_list_rejects(spark, sf):
    return job_list_rows(_list_lines(spark, sf))[1]


_STEPS = """steps AS (
  SELECT label, next_label, next_config_uri FROM (
    SELECT label, lead(label) OVER (ORDER BY pos) AS next_label,
      lead(config_uri) OVER (ORDER BY pos) AS next_config_uri,
      row_number() OVER (PARTITION BY label ORDER BY pos) AS rn FROM fx_job_list) WHERE rn = 1)"""


@query("next_job", fx.with_([fx.JOB_LIST, _STEPS], "SELECT * FROM steps"))
def next_job(spark, sf):
    return successors(fx.job_list(spark, sf))


@query(
    "first_job",
    fx.with_([fx.JOB_LIST], "SELECT pos, label, config_uri FROM fx_job_list ORDER BY pos LIMIT 1"),
)
def first_job(spark, sf):
    return first_entry(fx.job_list(spark, sf))


# Suppliers as the names of lists; each has the orders of some customers.
_LISTS = """lists AS (SELECT 'list' || (o_custkey % 25) AS uri, o_orderkey AS pos,
    'job' || (o_custkey % 40) AS label, 'gs://cfg/' || o_orderkey || '.json' AS config_uri FROM orders)"""


def _lists(spark, sf):
    return fx.table(spark, sf, "orders").select(
        text("list", c("o_custkey") % 25).alias("uri"),
        c("o_orderkey").alias("pos"),
        text("job", c("o_custkey") % 40).alias("label"),
        text("gs://cfg/", c("o_orderkey"), ".json").alias("config_uri"),
    )


@query(
    "next_job_of_lists",
    fx.with_(
        [_LISTS],
        """SELECT uri, label, next_label, next_config_uri FROM (
  SELECT uri, label, lead(label) OVER l AS next_label, lead(config_uri) OVER l AS next_config_uri,
    row_number() OVER (PARTITION BY uri, label ORDER BY pos) AS rn
  FROM lists WINDOW l AS (PARTITION BY uri ORDER BY pos)) WHERE rn = 1""",
    ),
)
def next_job_of_lists(spark, sf):
    return successors(_lists(spark, sf))


@query(
    "job_list_round_trip",
    fx.with_(
        [_LISTS],
        """SELECT label, next_label, next_config_uri FROM (
  SELECT label, lead(label) OVER (ORDER BY pos) AS next_label, lead(config_uri) OVER (ORDER BY pos) AS next_config_uri
  FROM (SELECT pos, label || '-' || pos AS label, config_uri FROM lists))""",
    ),
)
def job_list_round_trip(spark, sf):
    """A list of many part files, written, read back and chained."""
    path = run_folder(spark, "list")
    rows = _lists(spark, sf).select("pos", text(c("label"), "-", c("pos")).alias("label"), "config_uri")
    lines = rows.withColumn("line", text(c("label"), ", ", c("config_uri")))
    write_job_list(lines, path, parts=9)
    return successors(read_job_list(spark, path)[0]).drop("uri")


# --- chaining ---------------------------------------------------------------------------------

@query(
    "job_lookup",
    fx.with_(
        [fx.JOB_EVENTS, fx.JOBS_DIRECTORY],
        """SELECT e.job_uid, e.job_name, e.status, j.job_label
FROM fx_job_events e LEFT JOIN fx_jobs j ON e.job_name = j.job_name""",
    ),
)
def job_lookup(spark, sf):
    events = job_events(fx.job_messages(spark, sf)).select("job_uid", "job_name", "status")
    return schedule.with_labels(events, fx.jobs_directory(spark, sf))


@query("job_by_name", fx.with_([fx.JOBS_DIRECTORY], "SELECT job_name, job_uid, job_label, team FROM fx_jobs WHERE job_name = 'job-17'"))
def job_by_name(spark, sf):
    return _directory_row(warehouse.job_by_name(fx.jobs_directory(spark, sf), "job-17"))


@query("job_by_uid", fx.with_([fx.JOBS_DIRECTORY], "SELECT job_name, job_uid, job_label, team FROM fx_jobs WHERE job_uid = 'uid-23'"))
def job_by_uid(spark, sf):
    return _directory_row(warehouse.job_by_uid(fx.jobs_directory(spark, sf), "uid-23"))


def _directory_row(jobs):
    labels = c("labels")
    return jobs.select("job_name", "job_uid", labels[K.JOB_LABEL_KEY].alias("job_label"), labels["team"].alias("team"))


_TRIGGER = r"""'gs://cfg/' || regexp_extract(next_config_uri, '^gs://cfg/(.*)/[^/]*$', 1) || '/START_PIPELINE' AS target_uri,
  to_json({'@LABEL@': next_label, 'config': regexp_extract(next_config_uri, '([^/]*)$', 1)})::VARCHAR AS body""".replace(
    "@LABEL@", K.JOB_LABEL_KEY
)


@query(
    "schedule_triggers",
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
        f"""SELECT e.job_uid, e.job_name, e.status, j.job_label, next_label, next_config_uri, {_TRIGGER}
FROM fx_job_events e JOIN fx_jobs j ON e.job_name = j.job_name
  JOIN all_steps s ON s.label = j.job_label
WHERE e.status IN ('SUCCEEDED', 'FAILED') AND j.job_label IS NOT NULL""",
    ),
)
def schedule_triggers(spark, sf):
    events = job_events(fx.job_messages(spark, sf)).select("job_uid", "job_name", "status")
    return schedule.next_triggers(events, fx.jobs_directory(spark, sf), fx.job_list(spark, sf))


# --- trigger files -------------------------------------------------------------------------------

# Every page stands for a stored object. Most are trigger files, in the page's
# directory or at the top; their contents vary, some are missing.
_OBJECTS = """stored AS (
  SELECT page_id, bucket, CASE page_id % 5 WHEN 0 THEN name || '/START_PIPELINE' WHEN 1 THEN 'START_PIPELINE'
    WHEN 2 THEN name || '/x_START_PIPELINE' ELSE 'd' || page_id || '/START_PIPELINE' END AS name,
    CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{"@LABEL@": "L' || page_id || '", "config": "c' || page_id || '.json"}'
      WHEN 2 THEN '{"@LABEL@": "L' || page_id || '"}' WHEN 3 THEN '{"config": "c.json"}'
      WHEN 4 THEN '{"@LABEL@": "L", "config"' WHEN 5 THEN NULL ELSE ' ' END AS content,
    CASE WHEN page_id % 2 = 0 THEN 'd' || page_id || '/jobs.csv' ELSE name || '/jobs.csv' END AS list_name
  FROM fx_objects)""".replace(
    "@LABEL@", K.JOB_LABEL_KEY
)


def _stored(spark, sf, pages=None):
    pages = fx.table(spark, sf, "pages") if pages is None else pages
    uri = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "gs://")
    key = c("page_id")
    label = f'{{"{K.JOB_LABEL_KEY}": '
    named = pages.select(
        "page_id",
        F.regexp_extract(uri, "^gs://([^/]+)/?(.*)$", 1).alias("bucket"),
        F.regexp_extract(uri, "^gs://([^/]+)/?(.*)$", 2).alias("page"),
    )
    name = (
        F.when(key % 5 == 0, text(c("page"), "/START_PIPELINE"))
        .when(key % 5 == 1, "START_PIPELINE")
        .when(key % 5 == 2, text(c("page"), "/x_START_PIPELINE"))
        .otherwise(text("d", key, "/START_PIPELINE"))
    )
    content = (
        F.when(key % 7 == 0, "")
        .when(key % 7 == 1, text(label, '"L', key, '", "config": "c', key, '.json"}'))
        .when(key % 7 == 2, text(label, '"L', key, '"}'))
        .when(key % 7 == 3, '{"config": "c.json"}')
        .when(key % 7 == 4, label + '"L", "config"')
        .when(key % 7 == 6, " ")
    )
    listed = F.when(key % 2 == 0, text("d", key, "/jobs.csv")).otherwise(
        text(c("page"), "/jobs.csv")
    )
    return named.select(
        "page_id", "bucket", name.alias("name"), content.alias("content"), listed.alias("list_name")
    )


@query(
    "trigger_gate",
    fx.with_(
        [fx.LISTING, _OBJECTS],
        "SELECT bucket, name FROM stored WHERE regexp_extract(name, '([^/]*)$', 1) = 'START_PIPELINE'",
    ),
)
def trigger_gate(spark, sf):
    return schedule.trigger_events(_stored(spark, sf).select("bucket", "name"))


_FIELDS = """fields AS (SELECT *, CASE page_id % 7 WHEN 1 THEN 'L' || page_id WHEN 2 THEN 'L' || page_id END AS job_label,
  CASE WHEN page_id % 7 = 1 THEN 'c' || page_id || '.json' ELSE 'batch_config.json' END AS config_name FROM stored)"""


@query(
    "trigger_parse",
    fx.with_(
        [fx.LISTING, _OBJECTS, _FIELDS],
        "SELECT page_id, content, job_label, config_name FROM fields",
    ),
)
def trigger_parse(spark, sf):
    return trigger_fields(_stored(spark, sf).select("page_id", "content"))


_ROUTED = """contents AS (SELECT bucket, name, max(content) AS content FROM stored WHERE content IS NOT NULL GROUP BY ALL),
parsed AS (SELECT bucket, name, content,
    CASE WHEN json_valid(content) THEN json_extract_string(content, '$."@LABEL@"') END AS label,
    CASE WHEN json_valid(content) THEN json_extract_string(content, '$.config') END AS config FROM contents),
gated AS (SELECT s.bucket, s.name, coalesce(p.content, '') AS content, p.label, p.config,
    regexp_replace(s.name, '[^/]*$', '') AS folder
  FROM stored s LEFT JOIN parsed p ON p.bucket = s.bucket AND p.name = s.name
  WHERE regexp_extract(s.name, '([^/]*)$', 1) = 'START_PIPELINE'),
lists AS (SELECT DISTINCT bucket, list_name FROM stored),
seen AS (SELECT g.*, l.list_name IS NOT NULL AND content = '' AS by_list,
    regexp_replace(folder, '/+$', '') || CASE WHEN folder = '' THEN '' ELSE '/' END AS base
  FROM gated g LEFT JOIN lists l ON l.bucket = g.bucket
    AND l.list_name = regexp_replace(folder, '/+$', '') || CASE WHEN folder = '' THEN '' ELSE '/' END || 'jobs.csv'),
routed AS (SELECT bucket, name, CASE WHEN by_list THEN 'list' ELSE 'config' END AS route,
    CASE WHEN by_list THEN NULL ELSE label END AS job_label,
    base || CASE WHEN by_list THEN 'jobs.csv' WHEN label IS NOT NULL AND config IS NOT NULL THEN config
      ELSE 'batch_config.json' END AS target FROM seen)""".replace(
    "@LABEL@", K.JOB_LABEL_KEY
)


def _routed(spark, sf):
    stored = _stored(spark, sf)
    contents = (
        stored.filter(c("content").isNotNull())
        .groupBy("bucket", "name")
        .agg(F.max("content").alias("content"))
    )
    listing = stored.select("bucket", c("list_name").alias("name"))
    return schedule.routed_triggers(stored.select("bucket", "name"), contents, listing)


@query("trigger_route", fx.with_([fx.LISTING, _OBJECTS, _ROUTED], "SELECT * FROM routed"))
def trigger_route(spark, sf):
    return _routed(spark, sf)


@query(
    "job_list_copy",
    fx.with_(
        [fx.LISTING, _OBJECTS, _ROUTED],
        """SELECT 'gs://' || bucket || '/' || target AS source_uri, 'gs://sched/jobs.csv' AS target_uri
FROM routed WHERE route = 'list' AND 'gs://' || bucket || '/' || target <> 'gs://sched/jobs.csv'""",
    ),
)
def job_list_copy(spark, sf):
    return schedule.lists_to_copy(_routed(spark, sf), "gs://sched/jobs.csv")


# What routes lead to: a list of three entries each, and batch configs, of which
# every third is missing and every fifth is broken.
_LIST_TRIGGERS = """first_entries AS (SELECT bucket, target, 'gs://' || bucket || '/' || target AS uri,
    'a' || length(target) AS label FROM routed WHERE route = 'list')"""


def _stored_lists(routed):
    uri = schedule.routed_uri()
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("letter")) for i, x in enumerate("abc")])
    found = routed.filter(c("route") == "list").select(uri.alias("uri"), "target").distinct()
    return found.select("uri", "target", F.explode(entries).alias("e")).select(
        "uri", c("e.pos").alias("pos"), text(c("e.letter"), F.length("target")).alias("label"),
        text("gs://cfg/", c("e.letter"), "/x.json").alias("config_uri"),
    )


@query(
    "routed_list_triggers",
    fx.with_(
        [fx.LISTING, _OBJECTS, _ROUTED, _LIST_TRIGGERS],
        f"""SELECT uri, 'gs://cfg/a/{K.TRIGGER_FILE}' AS target_uri,
  to_json({{'{K.JOB_LABEL_KEY}': label, '{K.TRIGGER_CONFIG_KEY}': 'x.json'}})::VARCHAR AS body FROM first_entries""",
    ),
)
def routed_list_triggers(spark, sf):
    routed = _routed(spark, sf)
    return schedule.list_triggers(routed, _stored_lists(routed)).select("uri", "target_uri", "body")


_CONFIG_ROUTES = """config_routes AS (SELECT DISTINCT 'gs://' || bucket || '/' || target AS config_uri, job_label,
    length(target) AS n FROM routed WHERE route = 'config'),
reasons AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'batch config not found'
    WHEN n % 5 = 0 THEN 'batch config not usable' END AS reason FROM config_routes)"""


def _routed_requests(spark, sf):
    routed = _routed(spark, sf)
    n = F.length("target")
    body = F.when(n % 5 == 0, "{broken").otherwise(
        text('{"run_options": {"parallelism": ', n, '}, "input_options": {"input_type": "cram", "input_path": "gs://b/d"}}')
    )
    texts = (
        routed.filter((c("route") == "config") & (n % 3 != 0))
        .select(schedule.routed_uri().alias("uri"), body.alias("text"))
        .distinct()
    )
    return submit.routed_requests(routed, texts, F.lit("2024-03-05 06:07:08"))


@query(
    "routed_jobs",
    fx.with_(
        [fx.LISTING, _OBJECTS, _ROUTED, _CONFIG_ROUTES],
        """SELECT config_uri, job_label, TIMESTAMP '2024-03-05 06:07:08' AS submitted,
  substr(sha256(config_uri || '|' || coalesce(job_label, '') || '|2024-03-05 06:07:08'), 1, 10) AS job_id,
  'cram' AS input_type, 'gs://b/d' AS input_path, n::BIGINT AS parallelism FROM reasons WHERE reason IS NULL""",
    ),
)
def routed_jobs(spark, sf):
    return _routed_requests(spark, sf)[0].select(
        "config_uri", "job_label", "submitted", "job_id", "input_type", "input_path", "parallelism"
    )


@query(
    "routed_rejects",
    fx.with_(
        [fx.LISTING, _OBJECTS, _ROUTED, _CONFIG_ROUTES],
        "SELECT config_uri, job_label, reason FROM reasons WHERE reason IS NOT NULL",
    ),
)
def routed_rejects(spark, sf):
    return _routed_requests(spark, sf)[1]
