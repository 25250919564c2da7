"""Manifests, listings, chunked jobs and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom import schemas
from batchloom.catalog import fixtures as fx
from batchloom.catalog.fixtures import c, text
from batchloom.catalog.registry import query
from batchloom.functions.text import get_or
from batchloom.operators import checks
from batchloom.operators.joins import existing, missing, nearest_ancestor_config, nearest_config, unpaired, zip_by_position
from batchloom.operators.ordering import chunks, row_index, row_index_by
from batchloom.plans import prepare
from batchloom.plans.task_array import combine_inputs, in_one_order, numbered_inputs_text
from batchloom.sources import manifests
from batchloom.sources.configs import batch_jobs, parse_json
from batchloom.sources.listings import inputs_below, listing_of, with_extension

WS = K.WS


# --- manifests ---------------------------------------------------------------

_LINES = f"""lines AS (
  SELECT doc_id::VARCHAR AS uri, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS parts FROM documents)),
stripped AS (
  SELECT uri, line_no, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS line FROM lines),
rows AS (
  SELECT uri, line_no, string_split_regex(line, '{WS}+') AS tokens
  FROM stripped WHERE line <> '' AND line_no > 1)"""


def _manifest(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        c("doc_id").cast("string").alias("uri"), "text"
    )
    return manifests.manifest_rows(manifests.split_lines(docs))


@query(
    "manifest_scan",
    fx.with_(
        [_LINES],
        """SELECT uri, line_no, tokens[1] AS sample_id, tokens[2] AS path,
  len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS line
FROM rows WHERE len(tokens) >= 2""",
    ),
)
def manifest_scan(spark, sf):
    good, _ = checks.two_fields(_manifest(spark, sf))
    return good.select(
        "uri",
        "line_no",
        c("tokens")[0].alias("sample_id"),
        c("tokens")[1].alias("path"),
        F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("line"),
    )


@query(
    "manifest_rejects",
    fx.with_(
        [_LINES],
        """SELECT uri, line_no, array_to_string(tokens, ' ') AS line,
  'expected two fields' AS reason FROM rows WHERE len(tokens) < 2""",
    ),
)
def manifest_rejects(spark, sf):
    _, bad = checks.two_fields(_manifest(spark, sf))
    return bad.select("uri", "line_no", F.array_join("tokens", " ").alias("line"), "reason")


@query(
    "manifest_chunks",
    fx.with_(
        [
            _LINES,
            "placed AS (SELECT uri, line_no, row_number() OVER (PARTITION BY uri ORDER BY line_no)"
            " - 1 AS row_index FROM rows)",
        ],
        """SELECT uri, line_no, row_index::BIGINT AS row_index, (row_index // 20)::BIGINT AS chunk,
  (row_index // 20 * 20)::BIGINT AS chunk_offset FROM placed""",
    ),
)
def manifest_chunks(spark, sf):
    rows = _manifest(spark, sf).select("uri", "line_no")
    return chunks(row_index(rows, "line_no", ["uri"]), 20)


@query(
    "generate_samples",
    """SELECT c_custkey AS pos, 'NA' || c_custkey AS sample_id,
  'gs://demo/NA' || c_custkey || '/NA' || c_custkey || '.cram' AS path,
  'NA' || c_custkey || ' gs://demo/NA' || c_custkey || '/NA' || c_custkey || '.cram' AS line
FROM customer""",
)
def generate_samples(spark, sf):
    return manifests.generate_samples(fx.table(spark, sf, "customer"), "demo", "c_custkey")


@query(
    "read_group_manifest",
    """SELECT sample_id, count(*)::BIGINT AS read_groups, count(DISTINCT lane)::BIGINT AS lanes,
  min(rgid) AS first_group, max(rgid) AS last_group
FROM (SELECT CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE 'S' || l_orderkey END AS sample_id,
    l_linenumber::VARCHAR AS lane, 'RG' || l_partkey || '.' || l_linenumber AS rgid FROM lineitem)
WHERE sample_id <> '' GROUP BY sample_id""",
)
def read_group_manifest(spark, sf):
    groups = fx.table(spark, sf, "lineitem").select(
        text("RG", c("l_partkey"), ".", c("l_linenumber")).alias("RGID"),
        F.when(c("l_orderkey") % 10 != 0, text("S", c("l_orderkey"))).otherwise("").alias("RGSM"),
        c("l_linenumber").cast("string").alias("Lane"),
    )
    return manifests.read_groups_per_sample(groups)


# --- listings ----------------------------------------------------------------

_STEM = r"""coalesce(nullif(regexp_extract(regexp_extract(name, '([^/]*)$', 1),
    '(?s)^(\.*[^.].*)\.[^.]*$', 1), ''), regexp_extract(name, '([^/]*)$', 1))"""


@query(
    "list_by_extension",
    fx.with_(
        [fx.LISTING],
        f"""SELECT bucket, name, {_STEM} AS sample_id, 's3://' || bucket || '/' || name AS path
FROM fx_objects WHERE ends_with(lower(name), '.html') OR ends_with(lower(name), '.gz')""",
    ),
)
def list_by_extension(spark, sf):
    objects = listing_of(fx.listing(spark, sf), "uri")
    return with_extension(objects, [".HTML", ".gz"])


_REQUESTS = r"""objects AS (
  SELECT bucket, CASE WHEN page_id % 3 = 0 THEN name || '.GZ' WHEN page_id % 3 = 1
    THEN name || '.cram' ELSE name END AS name FROM fx_objects),
requests AS (
  SELECT DISTINCT 'job-' || bucket || '-' || dir AS job_id, bucket, dir,
    CASE WHEN dir = 'en' THEN 'cram' ELSE 'FASTQ' END AS input_type
  FROM (SELECT bucket, regexp_extract(name, '^([^/]*)/', 1) AS dir FROM objects))"""


@query(
    "listed_inputs",
    fx.with_(
        [fx.LISTING, _REQUESTS],
        f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY name) - 1 AS pos,
  sample_id, path
FROM (SELECT r.job_id, o.name, {_STEM.replace('name', 'o.name')} AS sample_id,
    's3://' || o.bucket || '/' || o.name AS path
  FROM objects o JOIN requests r ON o.bucket = r.bucket
    AND starts_with(o.name, CASE WHEN r.dir = '' THEN '' ELSE r.dir || '/' END)
  WHERE (r.input_type = 'cram' AND ends_with(lower(o.name), '.cram'))
    OR (r.input_type = 'FASTQ' AND (ends_with(lower(o.name), '.ora') OR ends_with(lower(o.name), '.gz'))))""",
    ),
)
def listed_inputs(spark, sf):
    raw = fx.listing(spark, sf)
    ending = (
        F.when(c("page_id") % 3 == 0, ".GZ").when(c("page_id") % 3 == 1, ".cram").otherwise("")
    )
    objects = listing_of(raw.withColumn("uri", F.concat("uri", ending)), "uri")
    folder = F.regexp_extract("name", "^([^/]*)/", 1)
    requests = (
        objects.select("bucket", folder.alias("dir"))
        .distinct()
        .select(
            text("job-", c("bucket"), "-", c("dir")).alias("job_id"),
            text("gs://", c("bucket"), "/", c("dir")).alias("input_path"),
            F.when(c("dir") == "en", "cram").otherwise("FASTQ").alias("input_type"),
        )
    )
    return inputs_below(requests, objects).select(
        "job_id", "pos", c("tokens")[0].alias("sample_id"), c("tokens")[1].alias("path")
    )


@query(
    "path_exists_semi",
    fx.with_(
        [fx.LISTING],
        """SELECT page_id, name FROM fx_objects w
WHERE EXISTS (SELECT 1 FROM fx_objects l WHERE l.name = w.name || '.html')""",
    ),
)
def path_exists_semi(spark, sf):
    wanted, listing = _probes(spark, sf)
    return existing(wanted, listing, ["probe"]).select("page_id", "name")


@query(
    "path_exists_anti",
    fx.with_(
        [fx.LISTING],
        """SELECT page_id, name FROM fx_objects w
WHERE NOT EXISTS (SELECT 1 FROM fx_objects l WHERE l.name = w.name || '.html')""",
    ),
)
def path_exists_anti(spark, sf):
    wanted, listing = _probes(spark, sf)
    return missing(wanted, listing, ["probe"]).select("page_id", "name")


def _probes(spark, sf):
    pages = fx.listing(spark, sf)
    name = F.regexp_extract("uri", "^gs://([^/]+)/?(.*)$", 2)
    wanted = pages.select("page_id", name.alias("name"), F.concat(name, F.lit(".html")).alias("probe"))
    return wanted, pages.select(name.alias("probe"))


@query(
    "parent_config_fallback",
    fx.with_(
        [
            """configs AS (SELECT 'b' || (s_suppkey % 3) AS bucket,
  CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey || '/c.json' ELSE 'd' || s_suppkey || '/x/c.json' END AS path,
  s_name AS config FROM supplier)""",
            """wanted AS (SELECT c_custkey, 'b' || (c_custkey % 100 % 3) AS bucket,
  'd' || (c_custkey % 100) || '/x/c.json' AS path,
  'd' || (c_custkey % 100) || '/c.json' AS up FROM customer)""",
        ],
        """SELECT c_custkey, w.bucket, w.path,
  CASE WHEN a.path IS NOT NULL THEN w.path WHEN b.path IS NOT NULL THEN w.up END AS found_path,
  CASE WHEN a.path IS NOT NULL THEN a.config ELSE b.config END AS config
FROM wanted w LEFT JOIN configs a ON a.bucket = w.bucket AND a.path = w.path
LEFT JOIN configs b ON b.bucket = w.bucket AND b.path = w.up""",
    ),
)
def parent_config_fallback(spark, sf):
    key = c("s_suppkey")
    configs = fx.table(spark, sf, "supplier").select(
        text("b", key % 3).alias("bucket"),
        F.when(key % 2 == 0, text("d", key, "/c.json"))
        .otherwise(text("d", key, "/x/c.json"))
        .alias("path"),
        c("s_name").alias("config"),
    )
    cust = c("c_custkey")
    wanted = fx.table(spark, sf, "customer").select(
        "c_custkey",
        text("b", cust % 100 % 3).alias("bucket"),
        text("d", cust % 100, "/x/c.json").alias("path"),
    )
    return nearest_config(wanted, configs)


# Configs lie at the top of some buckets, one, two or four folders down; objects lie five down.
@query(
    "nearest_config_depths",
    fx.with_(
        [
            """configs AS (SELECT 'b' || (s_suppkey % 4) AS bucket, s_name AS config, CASE s_suppkey % 5 WHEN 0 THEN 'd' || s_suppkey || '/c.json'
    WHEN 1 THEN 'd' || s_suppkey || '/e/c.json' WHEN 2 THEN 'd' || s_suppkey || '/e/f/g/c.json'
    WHEN 3 THEN 'd' || s_suppkey || '/e/f/g/h/c.json' ELSE 'x' || s_suppkey || '/c.json' END AS path FROM supplier
  UNION ALL SELECT 'b1', 'top', 'c.json' UNION ALL SELECT 'b2', 'other', 'd.json')""",
            """wanted AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 3 THEN NULL ELSE 'b' || (c_custkey % 100 % 4) END AS bucket,
  'd' || (c_custkey % 100) || '/e/f/g/h/c.json' AS path FROM customer)""",
            """tried AS (SELECT c_custkey, w.bucket, w.path, a.path AS found_path, a.config, row_number() OVER (PARTITION BY c_custkey ORDER BY length(a.path) DESC) AS k
  FROM wanted w JOIN configs a ON a.bucket = w.bucket AND ends_with(a.path, 'c.json')
    AND starts_with(w.path, substr(a.path, 1, length(a.path) - 6)))""",
        ],
        """SELECT w.c_custkey, w.bucket, w.path, found_path, config
FROM wanted w LEFT JOIN (SELECT * FROM tried WHERE k = 1) t ON t.c_custkey = w.c_custkey""",
    ),
)
def nearest_config_depths(spark, sf):
    key = c("s_suppkey")
    place = (
        F.when(key % 5 == 0, text("d", key, "/c.json"))
        .when(key % 5 == 1, text("d", key, "/e/c.json"))
        .when(key % 5 == 2, text("d", key, "/e/f/g/c.json"))
        .when(key % 5 == 3, text("d", key, "/e/f/g/h/c.json"))
        .otherwise(text("x", key, "/c.json"))
    )
    configs = fx.table(spark, sf, "supplier").select(text("b", key % 4).alias("bucket"), place.alias("path"), c("s_name").alias("config"))
    top = spark.createDataFrame([("b1", "c.json", "top"), ("b2", "d.json", "other")], configs.schema)
    cust = c("c_custkey")
    wanted = fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(cust % 17 != 3, text("b", cust % 100 % 4)).alias("bucket"),
        text("d", cust % 100, "/e/f/g/h/c.json").alias("path"),
    )
    return nearest_ancestor_config(wanted, configs.unionByName(top))


# --- unions, positions and chunks ---------------------------------------------

@query(
    "union_inputs",
    """SELECT c_nationkey::VARCHAR AS job_id, 0 AS source, c_custkey AS pos, 'NA' || c_custkey AS sample_id
FROM customer
UNION ALL SELECT s_nationkey::VARCHAR, 1, s_suppkey, s_name FROM supplier""",
)
def union_inputs(spark, sf):
    combined = combine_inputs(fx.samples(spark, sf), _listed_suppliers(spark, sf))
    return combined.select("job_id", "source", "pos", c("tokens")[0].alias("sample_id"))


def _listed_suppliers(spark, sf):
    return fx.table(spark, sf, "supplier").select(
        c("s_nationkey").cast("string").alias("job_id"),
        c("s_suppkey").alias("pos"),
        F.array(c("s_name"), text("gs://in/", c("s_name"))).alias("tokens"),
    )


@query(
    "inputs_in_one_order",
    """SELECT job_id, sample_id, row_number() OVER (PARTITION BY job_id ORDER BY source, pos) - 1
  AS row_index
FROM (SELECT c_nationkey::VARCHAR AS job_id, 0 AS source, c_custkey AS pos, 'NA' || c_custkey AS sample_id
  FROM customer UNION ALL SELECT s_nationkey::VARCHAR, 1, s_suppkey, s_name FROM supplier)""",
)
def inputs_in_one_order(spark, sf):
    combined = combine_inputs(fx.samples(spark, sf), _listed_suppliers(spark, sf))
    return row_index(in_one_order(combined), "pos", ["job_id"]).select(
        "job_id", c("tokens")[0].alias("sample_id"), "row_index"
    )


@query(
    "task_index",
    """SELECT c_mktsegment, c_custkey,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row_index FROM customer""",
)
def task_index(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    return row_index(rows, "c_custkey", ["c_mktsegment"])


@query(
    "global_row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
)
def global_row_index(spark, sf):
    return row_index(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "row_index_by_name",
    """SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY name, page_id) - 1 AS row_index
FROM (SELECT l_returnflag AS bucket, 'p' || l_partkey || '/s' || l_suppkey AS name,
  l_orderkey * 10 + l_linenumber AS page_id FROM lineitem)""",
)
def row_index_by_name(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("bucket"),
        text("p", c("l_partkey"), "/s", c("l_suppkey")).alias("name"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("page_id"),
    )
    return row_index_by(rows, ["name", "page_id"], ["bucket"]).drop("page_id")


@query(
    "zip_configs",
    """SELECT c_custkey AS pos, c_name AS list_name, s_name AS config_name
FROM customer JOIN supplier ON c_custkey = s_suppkey""",
)
def zip_configs(spark, sf):
    return zip_by_position(*_zip_sides(spark, sf))


@query(
    "zip_length_check",
    """SELECT coalesce(c_custkey, s_suppkey) AS pos FROM customer FULL JOIN supplier
ON c_custkey = s_suppkey WHERE c_custkey IS NULL OR s_suppkey IS NULL""",
)
def zip_length_check(spark, sf):
    return unpaired(*_zip_sides(spark, sf))


def _zip_sides(spark, sf):
    lists = fx.table(spark, sf, "customer").select(
        c("c_custkey").alias("pos"), c("c_name").alias("list_name")
    )
    configs = fx.table(spark, sf, "supplier").select(
        c("s_suppkey").alias("pos"), c("s_name").alias("config_name")
    )
    return lists, configs


_CHUNKS = """inputs AS (
  SELECT n_nationkey AS pos, 'gs://in/list.' || n_name || '.txt' AS uri,
    'gs://cfg/' || n_name || '.json' AS config_uri FROM nation),
placed AS (
  SELECT n_nationkey AS input_pos, uri, config_uri, c_custkey,
    row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS row_index,
    'NA' || c_custkey || ' gs://in/NA' || c_custkey || '.cram' AS line
  FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN inputs ON inputs.pos = n_nationkey),
chunked AS (
  SELECT *, row_index // 20 AS chunk, row_index // 20 * 20 AS chunk_offset,
    dense_rank() OVER (ORDER BY input_pos, row_index // 20) - 1 AS job_no FROM placed),
jobs AS (SELECT DISTINCT job_no, uri, config_uri, chunk_offset,
    'pre/fix/input_list/' || regexp_replace(regexp_extract(uri, '([^/]*)$', 1), '\\.[^.]*$', '')
      || '_' || job_no || '_' || chunk_offset || '.txt' AS list_path,
    'pre/fix/jobs/batch_config' || job_no || '.json' AS config_path FROM chunked)""".replace(
    "\\\\", "\\"
)


def _chunked(spark, sf):
    """Customers of a nation are one list; the lists follow each other by nation key."""
    nation = fx.table(spark, sf, "nation")
    uri = text("gs://in/list.", c("n_name"), ".txt")
    inputs = nation.select(
        c("n_nationkey").alias("pos"),
        uri.alias("uri"),
        text("gs://cfg/", c("n_name"), ".json").alias("config_uri"),
    )
    key = c("c_custkey")
    rows = (
        fx.table(spark, sf, "customer")
        .join(nation.select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
        .select(
            uri.alias("uri"),
            key.alias("line_no"),
            F.array(text("NA", key), text("gs://in/NA", key, ".cram")).alias("tokens"),
        )
    )
    return prepare.chunk_rows(inputs, rows, 20)


@query(
    "chunk_jobs",
    fx.with_(
        [_CHUNKS],
        """SELECT input_pos, uri, config_uri, job_no, chunk, chunk_offset, row_index, line
FROM chunked""",
    ),
)
def chunk_jobs(spark, sf):
    return _chunked(spark, sf)


@query(
    "chunk_offsets",
    fx.with_([_CHUNKS], "SELECT job_no, uri, config_uri, chunk_offset FROM jobs"),
)
def chunk_offsets(spark, sf):
    return prepare.job_keys(_chunked(spark, sf))


@query(
    "chunk_manifest_text",
    fx.with_(
        [_CHUNKS],
        """SELECT c.job_no, list_path AS path, 'collaborator_sample_id' || chr(9) || 'cram_file_ref' || chr(10)
  || string_agg(line || chr(10), '' ORDER BY row_index) AS text
FROM chunked c JOIN jobs j ON c.job_no = j.job_no GROUP BY c.job_no, list_path""",
    ),
)
def chunk_manifest_text(spark, sf):
    return prepare.chunk_manifests(_chunked(spark, sf), "pre/fix")


@query(
    "batch_config_json",
    fx.with_(
        [_CHUNKS],
        """SELECT job_no, config_path AS path, to_json({
  'run_options': {'parallelism': '10', 'max_run_duration': '7200s', 'memory_mib': 512,
    'cpu_milli': 1000, 'max_retry_count': 1},
  'input_options': {'input_type': 'cram', 'input_list': 'gs://bkt/' || list_path,
    'config': config_uri}})::VARCHAR AS body FROM jobs""",
    ),
)
def batch_config_json(spark, sf):
    jobs = prepare.job_keys(_chunked(spark, sf))
    return prepare.batch_configs(jobs, "bkt", "pre/fix", "10")


@query(
    "job_list_text",
    fx.with_(
        [_CHUNKS],
        """SELECT job_no AS pos, 'job' || job_no AS label, 'gs://bkt/' || config_path AS config_uri,
  'job' || job_no || ', gs://bkt/' || config_path AS line FROM jobs""",
    ),
)
def job_list_text(spark, sf):
    return prepare.job_list(prepare.job_keys(_chunked(spark, sf)), "bkt", "pre/fix")


@query(
    "fastq_combined_inputs",
    """SELECT o_custkey::VARCHAR AS job_id,
  string_agg(' -' || i || ' gs://in/' || o_orderkey || '.gz ', '' ORDER BY o_orderkey) AS inputs
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
GROUP BY o_custkey""",
)
def fastq_combined_inputs(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        c("o_custkey").cast("string").alias("job_id"),
        c("o_orderkey").alias("pos"),
        F.array(text("S", c("o_orderkey")), text("gs://in/", c("o_orderkey"), ".gz")).alias("tokens"),
    )
    return numbered_inputs_text(rows)


# --- checks and configurations --------------------------------------------------

@query(
    "task_count_check",
    fx.with_(
        [fx.JOB_ARRAY],
        """SELECT *, (task_count = sample_count AND task_count = input_count
  AND task_count = output_count) AS consistent
FROM (SELECT job_id, count(*) AS task_count, count(sample_id) AS sample_count,
    count(input_path) AS input_count,
    count(CASE WHEN job_label IS NOT NULL THEN output_path END) AS output_count
  FROM fx_job_array GROUP BY job_id)""",
    ),
)
def task_count_check(spark, sf):
    tasks = fx.job_array(spark, sf).withColumn(
        "output_path", F.when(c("job_label").isNotNull(), c("output_path"))
    )
    return checks.variable_counts(tasks)


_TYPES = """typed AS (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'CRAM' WHEN 'N' THEN 'fastq'
    ELSE 'fastq-list' END AS input_type FROM lineitem)"""


@query(
    "input_type_validate",
    fx.with_(
        [_TYPES],
        """SELECT l_orderkey, l_linenumber, lower(input_type) AS input_type,
  CASE lower(input_type) WHEN 'cram' THEN '.cram' ELSE '.ora,.gz' END AS extensions
FROM typed WHERE lower(input_type) IN ('cram', 'fastq')""",
    ),
)
def input_type_validate(spark, sf):
    good, _ = checks.supported_inputs(_typed(spark, sf))
    return good.withColumn(
        "extensions", F.array_join(checks.input_extensions(c("input_type")), ",")
    )


@query(
    "input_type_rejects",
    fx.with_(
        [_TYPES],
        """SELECT l_orderkey, l_linenumber, input_type, 'unsupported input type' AS reason
FROM typed WHERE lower(input_type) NOT IN ('cram', 'fastq')""",
    ),
)
def input_type_rejects(spark, sf):
    return checks.supported_inputs(_typed(spark, sf))[1]


def _typed(spark, sf):
    flag = c("l_returnflag")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag == "A", "CRAM").when(flag == "N", "fastq").otherwise("fastq-list").alias("input_type"),
    )


_CONFIG = """configs AS (
  SELECT c_custkey, '{"run_options": {"parallelism": "' || (c_custkey % 20)
    || '"' || CASE WHEN c_custkey % 3 = 0 THEN ', "machine": "n2", "cpu_milli": 2000' ELSE '' END
    || '}, "input_options": {"input_type": "cram", "input_list": "gs://in/' || c_custkey
    || '.txt", "config": "gs://cfg/c.json"}' || CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '}' END
    AS body FROM customer)"""


@query(
    "batch_config_parse",
    fx.with_(
        [_CONFIG],
        """SELECT c_custkey, json_extract_string(b, '$.input_options.input_type') AS input_type,
  json_extract_string(b, '$.input_options.input_list') AS input_list,
  json_extract_string(b, '$.input_options.input_path') AS input_path,
  json_extract_string(b, '$.input_options.config') AS config,
  coalesce(json_extract_string(b, '$.run_options.cpu_milli')::BIGINT, 1000) AS cpu_milli,
  coalesce(json_extract_string(b, '$.run_options.memory_mib')::BIGINT, 512) AS memory_mib,
  coalesce(json_extract_string(b, '$.run_options.machine'), 'e2-micro') AS machine,
  coalesce(json_extract_string(b, '$.run_options.parallelism')::BIGINT, 3) AS parallelism,
  coalesce(json_extract_string(b, '$.run_options.max_retry_count')::BIGINT, 2) AS max_retry_count,
  coalesce(json_extract_string(b, '$.run_options.max_run_duration'), '7200s') AS max_run_duration
FROM (SELECT c_custkey, CASE WHEN json_valid(body) THEN body END AS b FROM configs)""",
    ),
)
def batch_config_parse(spark, sf):
    key = c("c_custkey")
    body = text(
        '{"run_options": {"parallelism": "',
        key % 20,
        '"',
        F.when(key % 3 == 0, ', "machine": "n2", "cpu_milli": 2000').otherwise(""),
        '}, "input_options": {"input_type": "cram", "input_list": "gs://in/',
        key,
        '.txt", "config": "gs://cfg/c.json"}',
        F.when(key % 17 == 0, "").otherwise("}"),
    )
    configs = fx.table(spark, sf, "customer").select("c_custkey", body.alias("body"))
    parsed = parse_json(configs, "body", schemas.BATCH_CONFIG)
    return batch_jobs(parsed.select("c_custkey", "parsed.*"))


@query(
    "json_parse",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
)
def json_parse(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "props")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "map_defaults",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k,
  coalesce(json_extract_string(props, '$.machine'), 'e2-micro') AS machine FROM events""",
)
def map_defaults(spark, sf):
    props = F.from_json("props", "map<string,string>")
    events = fx.table(spark, sf, "events").select("event_id", props.alias("m"))
    return events.select(
        "event_id",
        get_or(c("m")["k"], "-").alias("k"),
        get_or(c("m")["machine"], K.RUN_DEFAULTS["machine"]).alias("machine"),
    )
