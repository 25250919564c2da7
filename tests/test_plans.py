"""Task arrays, chunked jobs, scheduling and triggers."""

import json

import pytest
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.text import ordered_entries
from batchloom.plans import prepare, schedule
from batchloom.plans import task_array as ta
from batchloom.sinks import files, tables
from batchloom.sources import manifests, warehouse
from batchloom.sources.job_lists import read_job_list
from batchloom import schemas

LAUNCHER = ta.Launcher(account="sa", host="H", app="A")
JOB = (
    "job_id string, job_name string, job_label string, input_type string, opts string,"
    " launcher struct<api_host:string,%s:string,%s:string>, submitted string"
) % (K.LAUNCHER_MACHINE_KEY, K.LAUNCHER_APP_KEY)
OPTS = json.dumps(
    {"--force": "", "--output-directory": "s3://o/${SAMPLE_ID}/<date>", "--vc-sample-name": "${SAMPLE_ID}"}
)


def jobs_of(spark, *rows):
    df = spark.createDataFrame(
        [(i, f"n-{i}", "L", kind, opts, (None, None, None), "2024-01-02 03:04:05") for i, kind, opts in rows],
        JOB,
    )
    return df.withColumn("options", ordered_entries(F.col("opts"))).withColumn(
        "submitted", F.col("submitted").cast("timestamp_ntz")
    ).drop("opts")


def samples_of(spark, *rows):
    return spark.createDataFrame(list(rows), "job_id string, pos long, tokens array<string>")


def test_cram_tasks(spark):
    jobs = jobs_of(spark, ("j", "CRAM", OPTS))
    samples = samples_of(
        spark, ("j", 9, ["B", "gs://b/B.cram"]), ("j", 2, ["A", "gs://b/A.cram", "x"]), ("j", 5, ["bad"])
    )
    rows, down = ta.task_array(jobs, samples, LAUNCHER)
    got = rows.orderBy("batch_task_index").collect()
    assert [(r.batch_task_index, r.sample_id, r.input_path) for r in got] == [
        (0, "A", "s3://b/A.cram"), (1, "B", "s3://b/B.cram")
    ]
    assert got[0].output_path == "s3://o/A/2024-01-02-03-04-05"
    assert got[0].command == (
        f"--api-host H --machine nx1 {K.APP_FLAG} A --google-sa sa --   --cram-input s3://b/A.cram"
        "  --force  --output-directory s3://o/A/2024-01-02-03-04-05 --vc-sample-name A "
    )
    assert json.loads(got[0].variables) == {
        "SAMPLE_ID": "A", "INPUT_PATH": "s3://b/A.cram", "OUTPUT_PATH": "s3://o/A/2024-01-02-03-04-05"
    }
    assert down.count() == 0
    assert [f.name for f in rows.schema] == schemas.JOB_ARRAY.fieldNames()


def test_fastq_task(spark):
    jobs = jobs_of(spark, ("j", "fastq", json.dumps({"-r": "ref"})))
    samples = samples_of(spark, *[("j", i, [f"s{i}", f"gs://b/{i}.gz"]) for i in range(12)])
    row = ta.task_array(jobs, samples, LAUNCHER)[0].first()
    want = "".join(f" -{i + 1} s3://b/{i}.gz " for i in range(12))
    assert (row.input_path, row.sample_id, row.output_path) == (want, None, None)
    assert json.loads(row.variables) == {"INPUT_PATH": want}
    assert f"--   {want}  -r ref " in row.command


def test_pieces_of_a_long_input_text(spark):
    samples = samples_of(spark, *[("j", 3 * i, ["s", f"p{i}"]) for i in range(50)])
    text = ta.numbered_inputs_text(samples, piece_rows=7).first().inputs
    assert text == "".join(f" -{i + 1} p{i} " for i in range(50))


def test_jobs_that_are_turned_down(spark):
    no_output = json.dumps({"-r": "x"})
    jobs = jobs_of(
        spark, ("type", "fastq-list", OPTS), ("empty", "cram", OPTS), ("output", "cram", no_output),
        ("fields", "fastq", OPTS), ("options", "cram", "{}"),
    )
    rows = [(j, 0, ["a", "p"]) for j in ("type", "output", "options")] + [("fields", 0, ["a", "p", "x"])]
    tasks, down = ta.task_array(jobs, samples_of(spark, *rows), LAUNCHER)
    assert {r.job_id: r.reason for r in down.collect()} == {
        "type": "unsupported input type",
        "empty": "no input files",
        "output": "unequal variable counts",
        "fields": "expected two fields",
        "options": "no options",
    }
    assert tasks.count() == 0


def test_inputs_are_appended_without_dedupe(spark):
    one = samples_of(spark, ("j", 5, ["a", "p"]), ("j", 7, ["b", "q"]))
    two = samples_of(spark, ("j", 0, ["a", "p"]), ("k", 0, ["c", "r"]))
    got = ta.in_one_order(ta.combine_inputs(one, two)).orderBy("job_id", "pos").collect()
    assert [(r.job_id, r.tokens[0]) for r in got] == [("j", "a"), ("j", "b"), ("j", "a"), ("k", "c")]


def _inputs(spark, *uris):
    return spark.createDataFrame(
        [(i, u, f"gs://cfg/{i}.json") for i, u in enumerate(uris)], "pos long, uri string, config_uri string"
    )


def _rows(spark, **sizes):
    data = [(f"gs://in/{k}.v1.txt", i + 2, [f"NA{i}", f"p{i}"]) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "uri string, line_no long, tokens array<string>")


def test_hundred_samples_make_five_jobs(spark):
    out = prepare.prepare_jobs(
        _inputs(spark, "gs://in/a.v1.txt"), _rows(spark, a=100), 20, "b", "pre", "10"
    )
    assert sorted(r.path for r in out["manifests"].collect()) == [
        f"pre/input_list/a.v1_{n}_{20 * n}.txt" for n in range(5)
    ]
    assert [r.line for r in out["job_list"].orderBy("pos").collect()] == [
        f"job{n}, gs://b/pre/jobs/batch_config{n}.json" for n in range(5)
    ]
    body = json.loads(out["configs"].orderBy("job_no").first().body)
    assert body == {
        "run_options": {"parallelism": "10", **K.CHUNK_RUN_OPTIONS},
        "input_options": {
            "input_type": "cram", "input_list": "gs://b/pre/input_list/a.v1_0_0.txt",
            "config": "gs://cfg/0.json",
        },
    }


def test_job_numbers_run_on_and_texts_are_whole(spark):
    inputs = _inputs(spark, "gs://in/z.v1.txt", "gs://in/none.v1.txt", "gs://in/a.v1.txt", "gs://in/m.v1.txt")
    out = prepare.prepare_jobs(inputs, _rows(spark, a=2, m=1, z=23), 20, "b", "", "10")
    texts = {r.job_no: (r.path, r.text) for r in out["manifests"].collect()}
    assert [texts[n][0] for n in range(4)] == [
        "input_list/z.v1_0_0.txt", "input_list/z.v1_1_20.txt", "input_list/a.v1_2_0.txt",
        "input_list/m.v1_3_0.txt",
    ]
    assert texts[1][1] == K.MANIFEST_HEADER + "\n" + "".join(f"NA{i} p{i}\n" for i in range(20, 23))


def test_lists_must_be_equally_long(spark):
    lists = spark.createDataFrame([(0, "u")], "pos long, uri string")
    configs = spark.createDataFrame([(0, "c"), (1, "d")], "pos long, config_uri string")
    assert prepare.pair_inputs(lists, configs.filter("pos = 0")).count() == 1
    with pytest.raises(ValueError):
        prepare.pair_inputs(lists, configs)


def test_written_jobs_read_back(spark, tmp_path):
    out = prepare.prepare_jobs(
        _inputs(spark, "gs://in/a.v1.txt"), _rows(spark, a=45), 20, "b", "pre", "10"
    )
    files.write_chunk_manifests(out["manifests"], str(tmp_path / "lists"))
    files.write_batch_configs(out["configs"], str(tmp_path / "configs"))
    files.write_job_list(out["job_list"], str(tmp_path / "jobs"))
    back = manifests.read_manifests(spark, str(tmp_path / "lists/*"))
    assert back.count() == 45 and back.select("uri").distinct().count() == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "jobs").glob("part-*")))
    assert text == "".join(f"job{n}, gs://b/pre/jobs/batch_config{n}.json\n" for n in range(3))
    bodies = spark.read.text(str(tmp_path / "configs"))
    assert bodies.count() == 3 and json.loads(bodies.first().value)["run_options"]["parallelism"] == "10"
    (one,) = (tmp_path / "lists" / "job_no=2").glob("part-*")
    assert one.read_text() == K.MANIFEST_HEADER + "\n" + "".join(f"NA{i} p{i}\n" for i in range(40, 45))
    single = tmp_path / "jobs.csv"
    single.write_text(text)
    assert read_job_list(spark, str(single))[0].count() == 3
    assert read_job_list(spark, str(tmp_path / "jobs"))[0].count() == 3


LIST = [
    (0, "job1", "gs://bk/cram/dry/batch_config1.json"),
    (1, "job2", "gs://bk/cram/dry/batch_config2.json"),
    (2, "job3", "gs://bk/batch_config3.json"),
]


def test_next_triggers(spark):
    job_list = spark.createDataFrame(LIST, "pos long, label string, config_uri string")
    key = K.JOB_LABEL_KEY
    jobs = spark.createDataFrame(
        [("a", "ua", {key: "job1"}), ("b", "ub", {key: "job3"}), ("c", "uc", {"x": "y"}),
         ("d", "ud", {key: ""}), ("e", "ue", {key: "other"}), ("f", "uf", {key: "job2"})],
        schemas.JOB_DIRECTORY,
    )
    events = spark.createDataFrame(
        [("ua", "a", "SUCCEEDED"), ("ub", "b", "SUCCEEDED"), ("uc", "c", "FAILED"), ("ud", "d", "FAILED"),
         ("ue", "e", "FAILED"), ("uf", "f", "RUNNING"), ("ug", "unknown", "FAILED"), ("uf", "f", "FAILED")],
        "job_uid string, job_name string, status string",
    )
    got = {r.job_name: (r.target_uri, json.loads(r.body)) for r in schedule.next_triggers(events, jobs, job_list).collect()}
    assert got == {
        "a": ("gs://bk/cram/dry/" + K.TRIGGER_FILE, {key: "job2", "config": "batch_config2.json"}),
        "d": ("gs://bk/cram/dry/" + K.TRIGGER_FILE, {key: "job1", "config": "batch_config1.json"}),
        "f": ("gs://bk//" + K.TRIGGER_FILE, {key: "job3", "config": "batch_config3.json"}),
    }


def test_trigger_routes(spark):
    t, label = K.TRIGGER_FILE, K.JOB_LABEL_KEY
    objects = spark.createDataFrame(
        [("b", f"in/{t}"), ("b", t), ("b", f"x/{t}"), ("b", f"y/{t}"), ("b", "in/other"), ("c", f"in/{t}")],
        schemas.OBJECT_EVENT,
    )
    contents = spark.createDataFrame(
        [("b", f"in/{t}", f'{{"{label}": "L", "config": "c.json"}}'), ("b", t, ""), ("b", f"x/{t}", "oops")],
        "bucket string, name string, content string",
    )
    listing = spark.createDataFrame(
        [("b", "jobs.csv"), ("b", "x/jobs.csv"), ("c", "in/jobs.csv")], schemas.OBJECT_EVENT
    )
    routed = schedule.routed_triggers(objects, contents, listing)
    got = {(r.bucket, r.name): (r.route, r.job_label, r.target) for r in routed.collect()}
    assert got == {
        ("b", f"in/{t}"): ("config", "L", "in/c.json"),
        ("b", t): ("list", None, "jobs.csv"),
        ("b", f"x/{t}"): ("config", None, "x/batch_config.json"),
        ("b", f"y/{t}"): ("config", None, "y/batch_config.json"),
        ("c", f"in/{t}"): ("list", None, "in/jobs.csv"),
    }
    copies = schedule.lists_to_copy(routed, "gs://b/jobs.csv").collect()
    assert [(r.source_uri, r.target_uri) for r in copies] == [("gs://c/in/jobs.csv", "gs://b/jobs.csv")]
    files.append_triggers(
        spark.createDataFrame([("gs://a/T", "{}")], schemas.TRIGGER_ROW), str(_new_folder(spark))
    )


def _new_folder(spark):
    from batchloom.session import run_folder

    return run_folder(spark, "test")


def test_table_sinks(spark, tmp_path):
    path = str(tmp_path / "status")
    rows = spark.createDataFrame(
        [("j", "t", "RUNNING", "2024-01-01 00:00:00"), ("j", None, "FAILED", "2024-01-01 00:00:00")],
        "job_id string, task_id string, status string, timestamp string",
    )
    bad = tables.append(rows, path, schemas.TASKS_STATUS)
    tables.append(rows, path, schemas.TASKS_STATUS)
    assert bad.count() == 1
    assert warehouse.tasks_status(spark, path).count() == 2
    tables.truncate(spark, path, schemas.TASKS_STATUS)
    back = warehouse.tasks_status(spark, path)
    assert back.count() == 0 and back.columns == schemas.TASKS_STATUS.fieldNames()


def test_job_directory_lookups(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame([("n", "u", {"k": "v"})], schemas.JOB_DIRECTORY).write.parquet(path)
    jobs = warehouse.job_directory(spark, path)
    assert warehouse.job_by_name(jobs, "n").first().job_uid == "u"
    assert warehouse.job_by_uid(jobs, "u").first().labels == {"k": "v"}


def test_create_jobs_from_configs(spark):
    from batchloom.plans import submit

    body = json.dumps({K.OPTIONS_KEY: json.loads(OPTS), K.LAUNCHER_KEY: {"api_host": "HH", "stub": "s"}})
    configs = submit.run_configs(
        spark.createDataFrame([("gs://c/a.json", body), ("gs://c/bad.json", "{oops")], "uri string, text string")
    )
    requests = spark.createDataFrame(
        [
            ("j1", "n1", "L", "2024-01-02 03:04:05", "CRAM", "gs://in/l.txt", "gs://b/d", "gs://c/a.json"),
            ("j2", "n2", None, "2024-01-02 03:04:05", "fastq", "gs://in/l.txt", None, "gs://c/a.json"),
            ("j3", "n3", "L", "2024-01-02 03:04:05", "cram", "gs://in/l.txt", None, "gs://c/bad.json"),
            ("j4", "n4", "L", "2024-01-02 03:04:05", "fastq-list", "gs://in/l.txt", None, "gs://c/a.json"),
            ("j5", "n5", "L", "2024-01-02 03:04:05", "cram", None, "gs://b/none", "gs://c/a.json"),
        ],
        "job_id string, job_name string, job_label string, submitted string, input_type string,"
        " input_list string, input_path string, config string",
    ).withColumn("submitted", F.col("submitted").cast("timestamp_ntz"))
    rows = spark.createDataFrame(
        [("gs://in/l.txt", 3, ["B", "gs://b/B"]), ("gs://in/l.txt", 2, ["A", "gs://b/A"])],
        "uri string, line_no long, tokens array<string>",
    )
    listing = spark.createDataFrame([("b", "d/x.cram"), ("b", "d/y.gz")], "bucket string, name string")
    tasks, down, short = submit.create_jobs(requests, configs, rows, listing, LAUNCHER)
    assert short.count() == 0
    got = tasks.orderBy("job_id", "batch_task_index").collect()
    assert [(r.job_id, r.batch_task_index, r.sample_id, r.input_path) for r in got] == [
        ("j1", 0, "A", "s3://b/A"), ("j1", 1, "B", "s3://b/B"), ("j1", 2, "x", "s3://b/d/x.cram"),
        ("j2", 0, None, " -1 s3://b/A  -2 s3://b/B "),
    ]
    assert all(r.command.startswith("--api-host HH --machine nx1 ") for r in got)
    assert {r.job_id: r.reason for r in down.collect()} == {
        "j3": "run config not found", "j4": "unsupported input type", "j5": "no input files",
    }


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_few_scans_of_samples_and_manifests(spark, tmp_path):
    """Numbers are made once: of all scans in a plan, those of the large inputs count."""
    from batchloom.catalog import inputs, launching
    from tests.conftest import SMALL

    assert scans(inputs.chunk_jobs(spark, SMALL)) <= 3
    assert scans(launching.job_array_rows(spark, SMALL)) <= 8
    assert scans(launching.job_array_rejects(spark, SMALL)) <= 8
    assert scans(launching.prepared_jobs_run(spark, SMALL)) <= 16
