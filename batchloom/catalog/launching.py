"""Command lines, templates, object paths and the task table."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.catalog import fixtures as fx
from batchloom.catalog.fixtures import c, text
from batchloom.catalog.registry import query
from batchloom.functions import commands, paths
from batchloom.functions.paths import bucket, prefix
from batchloom.functions.status import short_id
from batchloom.functions.text import fill_tokens, ordered_entries, replace_in_entries, replace_in_map
from batchloom.plans.prepare import prepare_jobs
from batchloom.plans.submit import create_jobs, routed_requests, run_configs
from batchloom.plans.task_array import (
    Launcher,
    cram_tasks,
    fastq_tasks,
    prepared_jobs,
    short_inputs,
    task_array,
)
from batchloom.session import run_folder
from batchloom.sinks.files import read_texts_table, write_texts
from batchloom.sources.manifests import manifest_rows, split_lines

LAUNCHER = Launcher(account="sa@p1", host="https://host/api", app="app-1")
_DATE = "2024-03-05-06-07-08"


# --- substitution ---------------------------------------------------------------

# One customer in four has a sample name that itself holds a variable name.
_VARIABLES = """vars AS (
  SELECT c_custkey, c_custkey % 10 AS idx,
    CASE WHEN c_custkey % 4 = 0 THEN 'NA-INPUT_PATH-' || c_custkey ELSE 'NA' || c_custkey END AS s,
    's3://in/' || c_custkey AS i, CASE WHEN c_custkey % 6 <> 0 THEN 's3://out/' || c_mktsegment END AS o,
    'run ${BATCH_TASK_INDEX} $BATCH_TASK_INDEX -s ${SAMPLE_ID} SAMPLE_ID -i ${INPUT_PATH} -o ${OUTPUT_PATH} OUTPUT_PATH' AS cmd
  FROM customer)"""
_SUBSTITUTED = fx.with_(
    [
        _VARIABLES,
        """a AS (SELECT *, replace(replace(cmd, '${BATCH_TASK_INDEX}', idx::VARCHAR), '$BATCH_TASK_INDEX', idx::VARCHAR) AS t FROM vars)""",
        "b AS (SELECT *, replace(replace(t, '${SAMPLE_ID}', s), 'SAMPLE_ID', s) AS t2 FROM a)",
        "d AS (SELECT *, replace(replace(t2, '${INPUT_PATH}', i), 'INPUT_PATH', i) AS t3 FROM b)",
    ],
    """SELECT c_custkey, CASE WHEN o IS NULL THEN t3
  ELSE replace(replace(t3, '${OUTPUT_PATH}', o), 'OUTPUT_PATH', o) END AS command FROM d""",
)
_TEMPLATE = (
    "run ${BATCH_TASK_INDEX} $BATCH_TASK_INDEX -s ${SAMPLE_ID} SAMPLE_ID -i ${INPUT_PATH}"
    " -o ${OUTPUT_PATH} OUTPUT_PATH"
)


def _variables(spark, sf):
    key = c("c_custkey")
    sample = F.when(key % 4 == 0, text("NA-INPUT_PATH-", key)).otherwise(text("NA", key))
    output = F.when(key % 6 != 0, text("s3://out/", c("c_mktsegment")))
    return fx.table(spark, sf, "customer").select(
        "c_custkey",
        (key % 10).alias("idx"),
        sample.alias("s"),
        text("s3://in/", key).alias("i"),
        output.alias("o"),
    )


@query("magic_replace", _SUBSTITUTED)
def magic_replace(spark, sf):
    named = list(zip(K.TASK_VARIABLES, [c("s"), c("i"), c("o")]))
    command = commands.substitute_variables(F.lit(_TEMPLATE), c("idx"), named)
    return _variables(spark, sf).select("c_custkey", command.alias("command"))


@query("magic_replace_entries", _SUBSTITUTED)
def magic_replace_entries(spark, sf):
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("key"), v.alias("value"))
            for n, v in zip(K.TASK_VARIABLES, [c("s"), c("i"), c("o")])
        ]
    )
    command = commands.substitute_entries(F.lit(_TEMPLATE), c("idx"), entries)
    return _variables(spark, sf).select("c_custkey", command.alias("command"))


def _options_json():
    """Run options of a customer as JSON text, in a fixed order."""
    return text(
        '{"--force": "", "-r": "s3://ref/',
        c("c_nationkey"),
        '", "--output-directory": "s3://out/${SAMPLE_ID}/<date>", "--vc-sample-name": "${SAMPLE_ID}",'
        ' "--label": "',
        c("c_mktsegment"),
        '"}',
    )


_OPTIONS_TEXT = (
    "' --force  -r s3://ref/' || c_nationkey || ' --output-directory s3://out/${SAMPLE_ID}/"
    + _DATE
    + " --vc-sample-name ${SAMPLE_ID} --label ' || c_mktsegment"
)


@query("option_templating", f"SELECT c_custkey, {_OPTIONS_TEXT} AS options FROM customer")
def option_templating(spark, sf):
    entries = replace_in_entries(ordered_entries(_options_json()), [(K.DATE_TOKEN, _DATE)])
    return fx.table(spark, sf, "customer").select(
        "c_custkey", commands.options_text(entries).alias("options")
    )


@query(
    "option_map_templating",
    f"SELECT c_custkey, 's3://out/${{SAMPLE_ID}}/{_DATE}' AS output, c_mktsegment AS label FROM customer",
)
def option_map_templating(spark, sf):
    options = replace_in_map(F.from_json(_options_json(), "map<string,string>"), [(K.DATE_TOKEN, _DATE)])
    return fx.table(spark, sf, "customer").select("c_custkey", options.alias("m")).select(
        "c_custkey", c("m")[K.OUTPUT_FLAG].alias("output"), c("m")["--label"].alias("label")
    )


@query(
    "config_tokens",
    """SELECT c_custkey, 'gs://' || c_mktsegment || '/in/' || c_custkey || '/' || c_mktsegment AS uri
FROM customer""",
)
def config_tokens(spark, sf):
    values = {"IN_BUCKET": c("c_mktsegment"), "KEY": c("c_custkey").cast("string")}
    marked = F.lit("gs://__IN_BUCKET__/in/__KEY__/__IN_BUCKET__")
    return fx.table(spark, sf, "customer").select(
        "c_custkey", fill_tokens(marked, values).alias("uri")
    )


# --- reading values back ----------------------------------------------------------

_COMMANDS = """commands AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag
    WHEN 'A' THEN 'x --cram-input s3://in/' || l_partkey || '.cram --qc-region-1 r --vc-sample-name  S' || l_orderkey || ' --output-directory s3://o/' || l_suppkey
    WHEN 'N' THEN 'x --fastq-list s3://in/' || l_partkey || '.csv --fastq-list-sample-id S' || l_orderkey || ' --output-directory s3://o/' || l_suppkey
    ELSE CASE WHEN l_linestatus = 'F' THEN 'x -1 s3://in/a' || l_partkey || ' -2 s3://in/b' || l_partkey || ' --vc-sample-name S' || l_orderkey
      ELSE 'x --qc-region-1 q -1 s3://in/a' || l_partkey || ' -2 s3://in/b' || l_partkey END END AS cmd
  FROM lineitem)"""


def _commands(spark, sf):
    part, order, supp = c("l_partkey"), c("l_orderkey"), c("l_suppkey")
    cram = text(
        "x --cram-input s3://in/", part, ".cram --qc-region-1 r --vc-sample-name  S", order,
        " --output-directory s3://o/", supp,
    )
    listed = text(
        "x --fastq-list s3://in/", part, ".csv --fastq-list-sample-id S", order,
        " --output-directory s3://o/", supp,
    )
    pair = text("x -1 s3://in/a", part, " -2 s3://in/b", part, " --vc-sample-name S", order)
    trap = text("x --qc-region-1 q -1 s3://in/a", part, " -2 s3://in/b", part)
    flag = c("l_returnflag")
    cmd = (
        F.when(flag == "A", cram)
        .when(flag == "N", listed)
        .otherwise(F.when(c("l_linestatus") == "F", pair).otherwise(trap))
    )
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cmd.alias("cmd"))


def _value(name: str) -> str:
    return (
        f"CASE WHEN contains(cmd, '{name}') THEN "
        f"string_split(trim(string_split(cmd, '{name}')[2]), ' ')[1] END"
    )


@query(
    "command_param",
    fx.with_(
        [_COMMANDS],
        f"""SELECT l_orderkey, l_linenumber, l_partkey, {_value('--output-directory')} AS output,
  {_value('--fastq-list')} AS fastq_list, {_value('-1')} AS first_read FROM commands""",
    ),
)
def command_param(spark, sf):
    cmd = c("cmd")
    return _commands(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        commands.option_value(cmd, "--output-directory").alias("output"),
        commands.option_value(cmd, "--fastq-list").alias("fastq_list"),
        commands.option_value(cmd, "-1").alias("first_read"),
    )


_KIND = """CASE WHEN contains(cmd, '--cram-input') THEN 'cram' WHEN contains(cmd, '--fastq-list') THEN 'fastq-list'
  WHEN contains(cmd, '-1 ') AND contains(cmd, '-2 ') THEN 'fastq' END"""


@query(
    "command_fields",
    fx.with_(
        [_COMMANDS, f"kinds AS (SELECT *, {_KIND} AS kind FROM commands)"],
        f"""SELECT l_orderkey, l_linenumber, l_partkey, kind AS input_type,
  CASE kind WHEN 'cram' THEN {_value('--cram-input')} WHEN 'fastq-list' THEN {_value('--fastq-list')}
    WHEN 'fastq' THEN ({_value('-1')}) || ',' || ({_value('-2')}) END AS input,
  {_value('--output-directory')} AS output, {_value('--vc-sample-name')} AS sample_id FROM kinds""",
    ),
)
def command_fields(spark, sf):
    return _fields(_commands(spark, sf), False)


def _word(name: str) -> str:
    return (
        f"CASE WHEN list_contains(words, '{name}') THEN "
        f"coalesce(words[list_position(words, '{name}') + 1], '') END"
    )


@query(
    "command_fields_by_word",
    fx.with_(
        [
            _COMMANDS,
            "worded AS (SELECT *, string_split_regex(trim(cmd), ' +') AS words FROM commands)",
            """kinds AS (SELECT *, CASE WHEN list_contains(words, '--cram-input') THEN 'cram'
  WHEN list_contains(words, '--fastq-list') THEN 'fastq-list'
  WHEN list_contains(words, '-1') AND list_contains(words, '-2') THEN 'fastq' END AS kind FROM worded)""",
        ],
        f"""SELECT l_orderkey, l_linenumber, l_partkey, kind AS input_type,
  CASE kind WHEN 'cram' THEN {_word('--cram-input')} WHEN 'fastq-list' THEN {_word('--fastq-list')}
    WHEN 'fastq' THEN ({_word('-1')}) || ',' || ({_word('-2')}) END AS input,
  {_word('--output-directory')} AS output, {_word('--vc-sample-name')} AS sample_id FROM kinds""",
    ),
)
def command_fields_by_word(spark, sf):
    return _fields(_commands(spark, sf), True)


def _fields(df, exact: bool):
    cmd = c("cmd")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        commands.command_input_type(cmd, exact).alias("input_type"),
        commands.command_input(cmd, exact).alias("input"),
        commands.command_output(cmd, exact).alias("output"),
        commands.command_sample(cmd, exact).alias("sample_id"),
    )


# --- paths ---------------------------------------------------------------------------

_URIS = """uris AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'gs://' || c_mktsegment || '/k/' || c_custkey || '.fastq.gz'
    WHEN 1 THEN 's3://' || c_mktsegment || '/' || c_custkey WHEN 2 THEN 'gs://' || c_mktsegment
    WHEN 3 THEN 'gs://' || c_mktsegment || '/' WHEN 4 THEN 'http://' || c_mktsegment || '/x' ELSE '' END AS uri
  FROM customer)"""


def _uris(spark, sf):
    key, seg = c("c_custkey"), c("c_mktsegment")
    uri = (
        F.when(key % 6 == 0, text("gs://", seg, "/k/", key, ".fastq.gz"))
        .when(key % 6 == 1, text("s3://", seg, "/", key))
        .when(key % 6 == 2, text("gs://", seg))
        .when(key % 6 == 3, text("gs://", seg, "/"))
        .when(key % 6 == 4, text("http://", seg, "/x"))
        .otherwise("")
    )
    return fx.table(spark, sf, "customer").select("c_custkey", uri.alias("uri"))


@query(
    "uri_split",
    fx.with_(
        [_URIS],
        """SELECT c_custkey, regexp_extract(uri, '^(?:gs|s3)://([^/]+)(?:/(.+))?', 1) AS bucket,
  regexp_extract(uri, '^(?:gs|s3)://([^/]+)(?:/(.+))?', 2) AS prefix,
  replace(uri, 'gs://', 's3://') AS s3_uri,
  replace(replace(uri, 's3://', ''), 'gs://', '') AS bare FROM uris""",
    ),
)
def uri_split(spark, sf):
    uri = c("uri")
    return _uris(spark, sf).select(
        "c_custkey",
        paths.bucket(uri).alias("bucket"),
        paths.prefix(uri).alias("prefix"),
        paths.to_s3(uri).alias("s3_uri"),
        paths.without_scheme(uri).alias("bare"),
    )


@query(
    "path_parts",
    r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base,
  coalesce(nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(?s)^(\.*[^.].*)\.[^.]*$', 1), ''),
    regexp_extract(url, '([^/]*)$', 1)) AS stem,
  regexp_replace(regexp_extract(url, '(?s)^(.*/)[^/]*$', 1), '/+$', '') AS dir FROM pages""",
)
def path_parts(spark, sf):
    url = c("url")
    return fx.table(spark, sf, "pages").select(
        "page_id",
        paths.basename(url).alias("base"),
        paths.stem(url).alias("stem"),
        paths.dirname(url).alias("dir"),
    )


@query(
    "path_segments",
    """SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[6] AS sixth,
  string_split(url, '/')[-1] AS last FROM pages""",
)
def path_segments(spark, sf):
    url = c("url")
    return fx.table(spark, sf, "pages").select(
        "page_id",
        paths.segment(url, 2).alias("host"),
        paths.segment(url, 5).alias("sixth"),
        paths.segment(url, -1).alias("last"),
    )


@query(
    "deterministic_id",
    "SELECT c_custkey, substring(sha256('NA' || c_custkey), 1, 10) AS id FROM customer",
)
def deterministic_id(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", short_id(text("NA", c("c_custkey"))).alias("id")
    )


# --- the task table ----------------------------------------------------------------------

# One job per customer; samples are the customer's orders. Types vary, some jobs
# lack the output option, some samples lack a path.
_JOBS = """jobs AS (
  SELECT 'uid-' || c_custkey AS job_id, 'job-' || c_custkey AS job_name,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS job_label,
    CASE c_custkey % 5 WHEN 0 THEN 'fastq' WHEN 1 THEN 'fastq-list' WHEN 2 THEN 'CRAM' ELSE 'cram' END AS raw_type,
    c_custkey % 8 <> 0 AS has_output, c_nationkey,
    CASE WHEN c_custkey % 3 = 0 THEN 'nx9' ELSE 'nx1' END AS machine,
    TIMESTAMP '2024-03-05 06:07:08' + (c_custkey % 50) * INTERVAL '1' MINUTE AS submitted
  FROM customer),
dated AS (SELECT *, lower(raw_type) AS input_type, strftime(submitted, '%Y-%m-%d-%H-%M-%S') AS stamp FROM jobs),
samples AS (
  SELECT 'uid-' || o_custkey AS job_id, o_orderkey AS pos, 'NA' || o_orderkey AS sample_id,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'gs://in/' || o_orderkey || '.cram' END AS path FROM orders),
broken AS (
  SELECT DISTINCT s.job_id FROM samples s JOIN dated j ON j.job_id = s.job_id
  WHERE j.input_type = 'fastq' AND s.path IS NULL)"""
_HEAD = (
    f"'--api-host https://host/api --machine ' || machine || ' {K.APP_FLAG} app-1"
    " --google-sa sa@p1 --  '"
)
_OUT = "'s3://out/' || c_nationkey || '/'"
_CRAM_ROWS = f"""cram_rows AS (
  SELECT j.*, s.sample_id, replace(s.path, 'gs://', 's3://') AS input_path,
    {_OUT} || s.sample_id || '/' || stamp AS output_path,
    row_number() OVER (PARTITION BY j.job_id ORDER BY pos) - 1 AS batch_task_index
  FROM dated j JOIN samples s ON j.job_id = s.job_id
  WHERE j.input_type = 'cram' AND j.has_output AND s.path IS NOT NULL)"""
_CRAM_SELECT = f"""SELECT job_id, job_name, job_label, batch_task_index,
  to_json({{'SAMPLE_ID': sample_id, 'INPUT_PATH': input_path, 'OUTPUT_PATH': output_path}})::VARCHAR AS variables,
  sample_id, input_path, input_type, output_path,
  {_HEAD} || ' --cram-input ' || input_path || '  --force  --output-directory ' || output_path
    || ' --vc-sample-name ' || sample_id || ' ' AS command, submitted AS timestamp
FROM cram_rows"""
_FASTQ_ROWS = f"""fastq_rows AS (
  SELECT j.job_id, any_value(job_name) AS job_name, any_value(job_label) AS job_label,
    any_value(input_type) AS input_type, any_value(machine) AS machine, any_value(submitted) AS submitted,
    any_value(has_output) AS has_output,
    string_agg(' -' || i || ' ' || replace(path, 'gs://', 's3://') || ' ', '' ORDER BY i) AS input_path,
    any_value({_OUT} || '${{SAMPLE_ID}}/' || stamp) AS raw_output
  FROM dated j JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS i FROM samples) s
    ON j.job_id = s.job_id
  WHERE j.input_type = 'fastq' AND j.job_id NOT IN (SELECT job_id FROM broken) GROUP BY j.job_id)"""
_FASTQ_SELECT = f"""SELECT job_id, job_name, job_label, 0::BIGINT AS batch_task_index,
  CASE WHEN has_output THEN to_json({{'INPUT_PATH': input_path, 'OUTPUT_PATH': raw_output}})::VARCHAR
    ELSE to_json({{'INPUT_PATH': input_path}})::VARCHAR END AS variables,
  NULL::VARCHAR AS sample_id, input_path, input_type,
  CASE WHEN has_output THEN raw_output END AS output_path,
  {_HEAD} || ' ' || input_path || '  --force '
    || CASE WHEN has_output THEN ' --output-directory ' || raw_output ELSE '' END
    || ' --vc-sample-name ${{SAMPLE_ID}} ' AS command, submitted AS timestamp
FROM fastq_rows"""


def _jobs(spark, sf):
    key = c("c_custkey")
    kind = (
        F.when(key % 5 == 0, "fastq")
        .when(key % 5 == 1, "fastq-list")
        .when(key % 5 == 2, "CRAM")
        .otherwise("cram")
    )
    output = F.when(
        key % 8 != 0,
        text('"--output-directory": "s3://out/', c("c_nationkey"), '/${SAMPLE_ID}/<date>", '),
    ).otherwise("")
    options = text('{"--force": "", ', output, '"--vc-sample-name": "${SAMPLE_ID}"}')
    launcher = F.struct(
        F.lit(None).cast("string").alias("api_host"),
        F.when(key % 3 == 0, "nx9").alias(K.LAUNCHER_MACHINE_KEY),
        F.lit(None).cast("string").alias(K.LAUNCHER_APP_KEY),
    )
    submitted = F.lit("2024-03-05 06:07:08").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), (key % 50).cast("int"), F.lit(0)
    )
    return fx.table(spark, sf, "customer").select(
        text("uid-", key).alias("job_id"),
        text("job-", key).alias("job_name"),
        F.when(key % 7 != 0, c("c_mktsegment")).alias("job_label"),
        kind.alias("input_type"),
        ordered_entries(options).alias("options"),
        launcher.alias("launcher"),
        submitted.alias("submitted"),
    )


def _job_samples(spark, sf):
    key = c("o_orderkey")
    name = text("NA", key)
    tokens = F.when(key % 29 == 0, F.array(name)).otherwise(
        F.array(name, text("gs://in/", key, ".cram"))
    )
    return fx.table(spark, sf, "orders").select(
        text("uid-", c("o_custkey")).alias("job_id"), key.alias("pos"), tokens.alias("tokens")
    )


def _ready(spark, sf):
    jobs = _jobs(spark, sf).withColumn("input_type", F.lower("input_type"))
    return prepared_jobs(jobs, LAUNCHER)


@query("cram_task_array", fx.with_([_JOBS, _CRAM_ROWS], _CRAM_SELECT))
def cram_task_array(spark, sf):
    return cram_tasks(_ready(spark, sf), _job_samples(spark, sf))


@query("fastq_task_array", fx.with_([_JOBS, _FASTQ_ROWS], _FASTQ_SELECT))
def fastq_task_array(spark, sf):
    return fastq_tasks(_ready(spark, sf), _job_samples(spark, sf))


@query(
    "job_array_rows",
    fx.with_([_JOBS, _CRAM_ROWS, _FASTQ_ROWS], f"{_CRAM_SELECT}\nUNION ALL\n{_FASTQ_SELECT}"),
)
def job_array_rows(spark, sf):
    return task_array(_jobs(spark, sf), _job_samples(spark, sf), LAUNCHER)[0]


@query(
    "job_array_rejects",
    fx.with_(
        [_JOBS],
        """SELECT job_id, 'unsupported input type' AS reason FROM dated WHERE input_type NOT IN ('cram', 'fastq')
UNION ALL SELECT job_id, 'no input files' FROM dated WHERE input_type IN ('cram', 'fastq')
  AND job_id NOT IN (SELECT job_id FROM samples)
UNION ALL SELECT job_id, 'unequal variable counts' FROM dated WHERE input_type = 'cram' AND NOT has_output
UNION ALL SELECT job_id, 'expected two fields' FROM broken""",
    ),
)
def job_array_rejects(spark, sf):
    return task_array(_jobs(spark, sf), _job_samples(spark, sf), LAUNCHER)[1]


# --- from batch configs to task rows ---------------------------------------------------------

# One request per supplier: its manifest holds fifteen customers, its input path
# 150 orders. Some requests lack one of the two or name an unknown run config.
_REQUESTS = """requests AS (
  SELECT s_suppkey AS k, 'uid-' || s_suppkey AS job_id, 'job-' || s_suppkey AS job_name, s_name AS job_label,
    CASE WHEN s_suppkey % 7 = 3 THEN 'bam' WHEN s_suppkey % 4 = 1 THEN 'fastq' ELSE 'cram' END AS input_type,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'gs://in/s' || s_suppkey || '.txt' END AS input_list,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'gs://b/d' || s_suppkey END AS input_path,
    CASE WHEN s_suppkey % 11 = 4 THEN NULL ELSE s_nationkey END AS cfg FROM supplier),
inputs AS (
  SELECT job_id, 0 AS source, c_custkey AS pos, 'NA' || c_custkey AS sample_id, 's3://in/' || c_custkey || '.x' AS path
  FROM requests JOIN customer ON k = c_custkey // 15 WHERE input_list IS NOT NULL
  UNION ALL
  SELECT job_id, 1, row_number() OVER (PARTITION BY job_id ORDER BY name), regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[.][^.]*$', ''),
    's3://b/' || name
  FROM requests JOIN (SELECT o_orderkey // 150 AS d, 'd' || (o_orderkey // 150) || '/o' || o_orderkey
      || CASE WHEN o_orderkey % 2 = 0 THEN '.cram' ELSE '.gz' END AS name FROM orders) o ON o.d = k
  WHERE input_path IS NOT NULL AND ((input_type = 'cram' AND ends_with(name, '.cram')) OR (input_type = 'fastq' AND ends_with(name, '.gz')))),
ok AS (SELECT * FROM requests WHERE input_type <> 'bam' AND cfg IS NOT NULL),
numbered AS (SELECT ok.*, sample_id, path, row_number() OVER (PARTITION BY ok.job_id ORDER BY source, pos) AS i
  FROM ok JOIN inputs ON ok.job_id = inputs.job_id)"""
_CREATED = fx.with_(
    [_REQUESTS],
    """SELECT job_id, job_name, job_label, i - 1 AS batch_task_index,
  to_json({'SAMPLE_ID': sample_id, 'INPUT_PATH': path, 'OUTPUT_PATH': 's3://o/' || cfg || '/' || sample_id || '/2024-03-05-06-07-08'})::VARCHAR AS variables,
  sample_id, path AS input_path, input_type, 's3://o/' || cfg || '/' || sample_id || '/2024-03-05-06-07-08' AS output_path,
  '--api-host h' || cfg || ' --machine nx1 @APP@ app-1 --google-sa sa@p1 --   --cram-input ' || path
    || '  -r ref' || cfg || ' --output-directory s3://o/' || cfg || '/' || sample_id || '/2024-03-05-06-07-08 ' AS command,
  TIMESTAMP '2024-03-05 06:07:08' AS timestamp
FROM numbered WHERE input_type = 'cram'
UNION ALL
SELECT job_id, any_value(job_name), any_value(job_label), 0::BIGINT,
  to_json({'INPUT_PATH': string_agg(' -' || i || ' ' || path || ' ', '' ORDER BY i), 'OUTPUT_PATH': 's3://o/' || any_value(cfg) || '/${SAMPLE_ID}/2024-03-05-06-07-08'})::VARCHAR,
  NULL, string_agg(' -' || i || ' ' || path || ' ', '' ORDER BY i), 'fastq', 's3://o/' || any_value(cfg) || '/${SAMPLE_ID}/2024-03-05-06-07-08',
  '--api-host h' || any_value(cfg) || ' --machine nx1 @APP@ app-1 --google-sa sa@p1 --   ' || string_agg(' -' || i || ' ' || path || ' ', '' ORDER BY i)
    || '  -r ref' || any_value(cfg) || ' --output-directory s3://o/' || any_value(cfg) || '/${SAMPLE_ID}/2024-03-05-06-07-08 ',
  TIMESTAMP '2024-03-05 06:07:08'
FROM numbered WHERE input_type = 'fastq' GROUP BY job_id""".replace("@APP@", K.APP_FLAG),
)


def _created(spark, sf):
    key = c("s_suppkey")
    kind = F.when(key % 7 == 3, "bam").when(key % 4 == 1, "fastq").otherwise("cram")
    requests = fx.table(spark, sf, "supplier").select(
        text("uid-", key).alias("job_id"),
        text("job-", key).alias("job_name"),
        c("s_name").alias("job_label"),
        F.lit("2024-03-05 06:07:08").cast("timestamp_ntz").alias("submitted"),
        kind.alias("input_type"),
        F.when(key % 5 != 0, text("gs://in/s", key, ".txt")).alias("input_list"),
        F.when(key % 3 != 0, text("gs://b/d", key)).alias("input_path"),
        F.when(key % 11 == 4, "gs://cfg/none.json")
        .otherwise(text("gs://cfg/", c("s_nationkey"), ".json"))
        .alias("config"),
    )
    nation = c("n_nationkey")
    configs = fx.table(spark, sf, "nation").select(
        text("gs://cfg/", nation, ".json").alias("uri"),
        text(
            '{"', K.OPTIONS_KEY, '": {"-r": "ref', nation, '", "--output-directory": "s3://o/', nation,
            '/${SAMPLE_ID}/<date>"}, "', K.LAUNCHER_KEY, '": {"api_host": "h', nation, '"}}',
        ).alias("text"),
    )
    cust = c("c_custkey")
    rows = fx.table(spark, sf, "customer").select(
        text("gs://in/s", F.expr("c_custkey div 15"), ".txt").alias("uri"),
        cust.alias("line_no"),
        F.array(text("NA", cust), text("gs://in/", cust, ".x")).alias("tokens"),
    )
    order = c("o_orderkey")
    ending = F.when(order % 2 == 0, ".cram").otherwise(".gz")
    listing = fx.table(spark, sf, "orders").select(
        F.lit("b").alias("bucket"),
        text("d", F.expr("o_orderkey div 150"), "/o", order, ending).alias("name"),
    )
    return create_jobs(requests, run_configs(configs), rows, listing, LAUNCHER)


@query("create_batch_jobs", _CREATED)
def create_batch_jobs(spark, sf):
    return _created(spark, sf)[0]


@query(
    "create_batch_jobs_rejects",
    fx.with_(
        [_REQUESTS],
        """SELECT job_id, 'unsupported input type' AS reason FROM requests WHERE input_type = 'bam'
UNION ALL SELECT job_id, 'run config not found' FROM requests WHERE input_type <> 'bam' AND cfg IS NULL
UNION ALL SELECT job_id, 'no input files' FROM ok WHERE job_id NOT IN (SELECT job_id FROM inputs)""",
    ),
)
def create_batch_jobs_rejects(spark, sf):
    return _created(spark, sf)[1]


# --- chunked jobs, written, read back and run ---------------------------------------------------

# Three lists of one file name in different folders; jobs of 50 tasks.
@query(
    "prepared_jobs_run",
    """WITH numbered AS (SELECT c_custkey % 3 AS n, c_custkey, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) - 1 AS i
  FROM customer),
starts AS (SELECT n, coalesce(sum(jobs) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_job
  FROM (SELECT n, (count(*) + 49) // 50 AS jobs FROM numbered GROUP BY n))
SELECT 'job' || (first_job + i // 50)::BIGINT AS job_label, (i % 50)::BIGINT AS batch_task_index, 'NA' || c_custkey AS sample_id,
  's3://b/' || c_custkey || '.cram' AS input_path
FROM numbered JOIN starts USING (n)""",
)
def prepared_jobs_run(spark, sf):
    key = c("c_custkey")
    uri = text("gs://in/d", key % 3, "/list.txt")
    customers = fx.table(spark, sf, "customer")
    inputs = customers.select((key % 3).alias("pos"), uri.alias("uri"), F.lit("gs://cfg/run.json").alias("config_uri")).distinct()
    rows = customers.select(
        uri.alias("uri"), key.alias("line_no"), F.array(text("NA", key), text("gs://b/", key, ".cram")).alias("tokens")
    )
    jobs = prepare_jobs(inputs, rows, 50, "b", "pre", "10")
    base = run_folder(spark, "prepared")
    write_texts(jobs["manifests"], base + "/lists", "b")
    write_texts(jobs["configs"], base + "/configs", "b")
    entries = jobs["job_list"].select(
        bucket(c("config_uri")).alias("bucket"), prefix(c("config_uri")).alias("target"),
        c("label").alias("job_label"), F.lit("config").alias("route"),
    )
    requests, _ = routed_requests(entries, read_texts_table(spark, base + "/configs"), F.lit("2024-03-05 06:07:08"))
    options = f'{{"{K.OPTIONS_KEY}": {{"--output-directory": "s3://o/x"}}, "{K.LAUNCHER_KEY}": {{"api_host": "h"}}}}'
    configs = run_configs(
        fx.table(spark, sf, "region").limit(1).select(F.lit("gs://cfg/run.json").alias("uri"), F.lit(options).alias("text"))
    )
    listing = fx.table(spark, sf, "region").limit(0).select(F.lit("").alias("bucket"), F.lit("").alias("name"))
    back = manifest_rows(split_lines(read_texts_table(spark, base + "/lists")))
    tasks = create_jobs(requests, configs, back, listing, LAUNCHER)[0]
    return tasks.select("job_label", "batch_task_index", "sample_id", "input_path")


@query(
    "short_input_rows",
    fx.with_(
        [_REQUESTS],
        """SELECT job_id, c_custkey AS pos, 'expected two fields' AS reason FROM ok JOIN customer ON k = c_custkey // 15
WHERE input_type = 'cram' AND c_custkey % 4 = 0""",
    ),
)
def short_input_rows(spark, sf):
    """Every fourth row of the manifests lacks its path."""
    kind = F.when(c("s_suppkey") % 7 == 3, "bam").when(c("s_suppkey") % 4 == 1, "fastq").otherwise("cram")
    jobs = fx.table(spark, sf, "supplier").filter(c("s_suppkey") % 11 != 4).select(
        text("uid-", c("s_suppkey")).alias("job_id"), kind.alias("input_type")
    )
    key = c("c_custkey")
    tokens = F.when(key % 4 == 0, F.array(text("NA", key))).otherwise(F.array(text("NA", key), text("gs://in/", key)))
    samples = fx.table(spark, sf, "customer").select(
        text("uid-", F.expr("c_custkey div 15")).alias("job_id"), key.alias("pos"), tokens.alias("tokens")
    )
    return short_inputs(jobs, samples).drop("tokens")
