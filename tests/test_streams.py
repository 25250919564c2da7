"""Streams over message files: verdicts, rejects, restarts and repeated batches."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom import schemas
from batchloom.functions.status import payload_time
from batchloom.plans.reports import count_report
from batchloom.operators.joins import with_verdict
from batchloom.operators.latest import latest_status
from batchloom.sinks.tables import append, compact, read_table, truncate, write_batch
from batchloom.sources.events import message_stream, object_stream
from batchloom.sources.warehouse import tasks_status
from batchloom.streaming import job_stream, latest_view, status_stream

T = "2024-01-01T00:00:{:02d}Z"


def message(job, index, state, second):
    body = f"Task state was updated: taskUID={job}-group0-{index}, currentState={state}, timestamp={T.format(second)}"
    return {
        "attributes": {
            "JobUID": job, "NewTaskState": state, "TaskUID": f"{job}-group0-{index}", "Region": "r",
            "TaskName": f"projects/p/locations/r/jobs/name-{job}/taskGroups/group0/tasks/{index}",
        },
        "data": base64.b64encode(body.encode()).decode(),
    }


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


@pytest.fixture
def tables_(spark):
    logs = spark.createDataFrame(
        [("u", "u-group0-0", K.SUCCESS_PATTERNS[0]), ("u", "u-group0-1", "nothing"), ("v", "u-group0-1", K.SUCCESS_PATTERNS[0])],
        schemas.TASK_LOG,
    )
    array = spark.createDataFrame(
        [("u", "n", "L", i, None, f"NA{i}", "p", "cram", "s3://o/x", "c", datetime(2024, 1, 1)) for i in range(3)],
        schemas.JOB_ARRAY,
    )
    return logs, array


def test_status_stream_end_to_end(spark, tmp_path, tables_):
    logs, array = tables_
    source = tmp_path / "in"
    sinks = status_stream.StatusSinks(*[str(tmp_path / n) for n in ("status", "rejects", "texts")])

    def run():
        status_stream.ingest_status(
            message_stream(spark, str(source)), lambda: logs, sinks, str(tmp_path / "cp"),
            job_array=lambda: array, clock=lambda e: payload_time(F.col("payload")), once=True,
            project="p", region="r",
        ).awaitTermination()

    put(source, "a.json", [message("u", 0, "RUNNING", 1), message("u", 0, "SUCCEEDED", 5), {"data": "eA=="}])
    run()
    put(source, "b.json", [message("u", 1, "SUCCEEDED", 6), message("u", 2, "FAILED", 7), message("x", 9, "FAILED", 7)])
    run()
    run()  # nothing new: no further rows
    rows = tasks_status(spark, sinks.status)
    got = sorted((r.task_id, r.status, r.timestamp.second) for r in rows.collect())
    assert got == [
        ("u-group0-0", "RUNNING", 1), ("u-group0-0", "SUCCEEDED", 5), ("u-group0-0", "VERIFIED_OK", 6),
        ("u-group0-1", "SUCCEEDED", 6), ("u-group0-1", "VERIFIED_FAILED", 7),
        ("u-group0-2", "FAILED", 7), ("x-group0-9", "FAILED", 7),
    ]
    assert read_table(spark, sinks.rejects).count() == 1
    texts = {(r.task_id, r.status): r.text for r in read_table(spark, sinks.notifications).collect()}
    assert set(texts) == {
        ("u-group0-0", "VERIFIED_OK"), ("u-group0-1", "VERIFIED_FAILED"), ("u-group0-2", "FAILED"),
        ("x-group0-9", "FAILED"),
    }
    assert "sample_id=NA0 " in texts["u-group0-0", "VERIFIED_OK"]
    assert "output directory" in texts["u-group0-1", "VERIFIED_FAILED"]
    assert "output directory" not in texts["u-group0-2", "FAILED"]
    assert "sample_id=None" in texts["x-group0-9", "FAILED"]
    assert tuple(count_report(rows, array).first()) == (3, 0, 2, 1, 1, 1)


def test_latest_view_follows_the_log(spark, tmp_path):
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")

    def add(*rows):
        spark.createDataFrame(
            [("j", t, s, datetime(2024, 1, 1, 0, 0, n)) for t, s, n in rows], schemas.TASKS_STATUS
        ).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schemas.TASKS_STATUS).parquet(log)
        latest_view.follow_latest(stream, out, cp, once=True).awaitTermination()
        view = latest_view.latest_view(tasks_status(spark, out))
        return sorted((r.task_id, r.status) for r in view.collect())

    assert add(("a", "RUNNING", 1), ("b", "RUNNING", 1)) == [("a", "RUNNING"), ("b", "RUNNING")]
    assert add(("a", "SUCCEEDED", 5), ("a", "VERIFIED_OK", 5)) == [
        ("a", "SUCCEEDED"), ("a", "VERIFIED_OK"), ("b", "RUNNING")
    ]
    # A row that arrives late does not move the view back.
    assert add(("a", "RUNNING", 2), ("b", "FAILED", 9)) == [
        ("a", "SUCCEEDED"), ("a", "VERIFIED_OK"), ("b", "FAILED")
    ]


def test_redelivered_messages(spark, tmp_path):
    source = tmp_path / "in"
    one = message("u", 0, "RUNNING", 1)
    bare = [{"data": base64.b64encode(f"m{i % 3}".encode()).decode()} for i in range(9)]
    other = {**one, "data": base64.b64encode(b"another body, timestamp=2024-01-01T00:00:01Z").decode()}
    put(source, "a.json", [one, one, message("u", 0, "RUNNING", 2), other, *bare])
    unique = status_stream.deduplicated(message_stream(spark, str(source)))
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")

    def run():
        status_stream.append_status(unique, out, str(tmp_path / "cp"), once=True, rejects=bad).awaitTermination()
        return tasks_status(spark, out).count()

    assert run() == 3 and read_table(spark, bad).count() == 9
    # Hours older than all before, yet not lost; again, and dropped.
    late = message("v", 0, "RUNNING", 1)
    late["data"] = base64.b64encode(b"x, timestamp=2023-12-31T20:00:00Z").decode()
    put(source, "b.json", [late, one])
    assert run() == 4


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        write_batch(spark.range(3), path, 7, "w")
    write_batch(spark.range(2), path, 8, "w")
    write_batch(spark.range(4), path, 7, "v")
    assert read_table(spark, path).count() == 9 and read_table(spark, path).columns == ["id"]


def test_no_writer_hides_the_rows_of_another(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    put(source, "a.json", [message("u", i, "RUNNING", i) for i in range(3)])

    def stream(checkpoint):
        status_stream.append_status(
            message_stream(spark, str(source)), path, str(tmp_path / checkpoint), once=True, rejects=str(tmp_path / "bad")
        ).awaitTermination()
        return tasks_status(spark, path).count()

    assert stream("one") == 3
    rows = spark.createDataFrame([("j", "t", "RUNNING", datetime(2024, 1, d)) for d in (1, 2)], schemas.TASKS_STATUS)
    assert append(rows, path, schemas.TASKS_STATUS).count() == 0
    assert tasks_status(spark, path).count() == 5
    put(source, "b.json", [message("u", 7, "RUNNING", 7), {"data": "eA=="}])
    assert stream("one") == 6
    assert stream("new") == 10
    assert read_table(spark, str(tmp_path / "bad")).count() == 2
    compact(spark, path, str(tmp_path / "small"), schemas.TASKS_STATUS)
    assert tasks_status(spark, str(tmp_path / "small")).count() == 10
    day = read_table(spark, path, schemas.TASKS_STATUS).where("day = '2024-01-02'")
    assert day.count() == 1 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    truncate(spark, path, schemas.TASKS_STATUS)
    assert tasks_status(spark, path).count() == 0


def test_only_lines_of_the_batch_are_matched(spark, tables_):
    logs, _ = tables_
    tasks = spark.createDataFrame([("u", "u-group0-0")], "job_id string, task_id string")
    plan = with_verdict(tasks, logs)._jdf.queryExecution().optimizedPlan().toString()
    # The keys meet the logs below the distinct; lines are matched on the way there.
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")


def test_job_chain_and_routes(spark, tmp_path):
    source = tmp_path / "jobs"
    attributes = {"JobUID": "u", "JobName": "projects/p/locations/r/jobs/j1", "NewJobState": "SUCCEEDED", "Region": "r"}
    put(source, "a.json", [{"attributes": attributes, "data": "eA=="}, {"data": "eA=="}])
    jobs = spark.createDataFrame([("j1", "u", {K.JOB_LABEL_KEY: "one"})], schemas.JOB_DIRECTORY)
    job_list = spark.createDataFrame(
        [(0, "one", "gs://b/d/1.json"), (1, "two", "gs://b/d/2.json")], "pos long, label string, config_uri string"
    )
    out, texts = str(tmp_path / "triggers"), str(tmp_path / "texts")
    job_stream.chain_jobs(
        message_stream(spark, str(source)), lambda: jobs, lambda: job_list, out, str(tmp_path / "cp"),
        notifications=texts, project="p", region="r", once=True,
    ).awaitTermination()
    row = read_table(spark, out).first()
    assert (row.target_uri, json.loads(row.body)[K.JOB_LABEL_KEY]) == ("gs://b/d/" + K.TRIGGER_FILE, "two")
    assert read_table(spark, texts).first().text.startswith("_Job_ execution *SUCCEEDED*")

    put(tmp_path / "objects", "a.json", [{"bucket": "b", "name": f"d/{K.TRIGGER_FILE}"}, {"bucket": "b", "name": "x"}])
    empty = spark.createDataFrame([], "bucket string, name string, content string")
    routes = str(tmp_path / "routes")
    job_stream.route_objects(
        object_stream(spark, str(tmp_path / "objects")), lambda: empty, lambda: empty.drop("content"),
        routes, str(tmp_path / "cp2"), once=True,
    ).awaitTermination()
    assert [r.target for r in read_table(spark, routes).collect()] == ["d/batch_config.json"]


class Lost(Exception):
    pass


def trigger_setup(spark, tmp_path):
    """Two config routes (one broken), a list route told twice, an object that is no trigger."""
    trigger = K.TRIGGER_FILE
    put(tmp_path / "objects", "a.json", [
        {"bucket": "b", "name": f"a/{trigger}"}, {"bucket": "b", "name": f"c/{trigger}"}, {"bucket": "b", "name": "x"},
        {"bucket": "b", "name": f"l/{trigger}"}, {"bucket": "b", "name": f"l/{trigger}"},
    ])
    label = json.dumps({K.JOB_LABEL_KEY: "one", K.TRIGGER_CONFIG_KEY: "my.json"})
    contents = spark.createDataFrame([("b", f"a/{trigger}", label)], "bucket string, name string, content string")
    listing = spark.createDataFrame([("b", "l/jobs.csv"), ("in", "d/NA9.cram")], "bucket string, name string")
    config = {"input_options": {"input_type": "cram", "input_list": "gs://in/m.txt", "input_path": "gs://in/d", "config": "gs://b/run.json"}}
    run = {K.OPTIONS_KEY: {K.OUTPUT_FLAG: "s3://o/${SAMPLE_ID}/<date>"}, K.LAUNCHER_KEY: {"api_host": "h"}}
    texts = spark.createDataFrame(
        [
            ("gs://b/a/my.json", json.dumps(config)), ("gs://b/c/batch_config.json", "{oops"),
            ("gs://b/run.json", json.dumps(run)), ("gs://b/l/jobs.csv", "one, gs://b/j/1.json\ntwo, gs://b/j/2.json"),
        ],
        "uri string, text string",
    )
    rows = spark.createDataFrame([("gs://in/m.txt", 2, ["NA1", "gs://in/1.cram"]), ("gs://in/m.txt", 3, ["NA2"])], "uri string, line_no long, tokens array<string>")
    stores = job_stream.TriggerStores(lambda: contents, lambda: listing, lambda: texts, lambda: rows)
    names = ("routes", "tasks", "lists", "triggers", "jobs", "rejects", "short")
    return stores, job_stream.TriggerSinks(*[str(tmp_path / n) for n in names])


def test_triggers_are_carried_out_and_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    from batchloom.plans.task_array import Launcher
    from batchloom.sinks import tables
    from batchloom.streaming import runner

    stores, sinks = trigger_setup(spark, tmp_path)

    def run():
        job_stream.follow_triggers(
            object_stream(spark, str(tmp_path / "objects")), stores, sinks, Launcher("sa@p", "H", "app"),
            "gs://sched/jobs.csv", str(tmp_path / "cp"), once=True,
        ).awaitTermination()

    def all_rows():
        return {n: sorted(read_table(spark, getattr(sinks, n)).collect()) for n in ("routes", "tasks", "lists", "triggers", "jobs", "rejects", "short_inputs")}

    def broken(rows, path, batch_id, writer, layout=None):
        if path == sinks.triggers:
            raise Lost("the last table of the batch")
        tables.write_batch(rows, path, batch_id, writer, layout)

    with monkeypatch.context() as m:
        m.setattr(runner, "write_batch", broken)
        with pytest.raises(Exception, match="Lost|last table"):
            run()
    first = sorted(read_table(spark, sinks.tasks).collect())
    assert len(first) == 2
    run()  # the batch again: same clock, same ids, every row once
    found = all_rows()
    assert found["tasks"] == first
    run()  # nothing new
    assert all_rows() == found
    assert [(r.sample_id, r.batch_task_index, r.job_label) for r in found["tasks"]] == [("NA1", 0, "one"), ("NA9", 1, "one")]
    (job,) = found["jobs"]
    assert job.labels == {K.JOB_LABEL_KEY: "one"} and job.job_uid == found["tasks"][0].job_id
    assert [(r.config_uri, r.reason) for r in found["rejects"]] == [("gs://b/c/batch_config.json", "batch config not usable")]
    assert [(r.source_uri, r.uri) for r in found["lists"]] == [("gs://b/l/jobs.csv", "gs://sched/jobs.csv")]
    (trigger,) = found["triggers"]
    assert trigger.target_uri == f"gs://b/j/{K.TRIGGER_FILE}" and json.loads(trigger.body)[K.JOB_LABEL_KEY] == "one"
    assert [r.tokens for r in found["short_inputs"]] == [["NA2"]]
    assert len(found["routes"]) == 3 and len({r.routed_at for r in found["routes"]}) == 1


def test_verdicts_wait_for_their_log_lines(spark, tmp_path):
    status = "job_id string, task_id string, status string, timestamp timestamp"
    log = "job_uid string, task_id string, text_payload string, timestamp timestamp"
    good = K.SUCCESS_PATTERNS[0]
    out = str(tmp_path / "out")

    def at(minute):
        return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"

    def step(name, events, lines):
        put(tmp_path / "events", name, [{"job_id": "j", "task_id": t, "status": s, "timestamp": at(m)} for t, s, m in events])
        put(tmp_path / "logs", name, [{"job_uid": "j", "task_id": t, "text_payload": x, "timestamp": at(m)} for t, x, m in lines])
        status_stream.append_verdicts(
            spark.readStream.schema(status).json(str(tmp_path / "events")), spark.readStream.schema(log).json(str(tmp_path / "logs")),
            out, str(tmp_path / "cp"), once=True, wait="10 minutes", back="1 hour", delay="5 minutes",
        ).awaitTermination()
        return sorted((r.task_id, r.status) for r in tasks_status(spark, out).collect())

    first = [("early", "SUCCEEDED", 60), ("late", "SUCCEEDED", 60), ("too-late", "SUCCEEDED", 60), ("early", "RUNNING", 59), ("old", "SUCCEEDED", 90)]
    lines = [("early", good, 58), ("early", "again " + good, 59), ("late", "nothing", 60), ("old", good, 20)]
    assert step("a.json", first, lines) == [("early", "VERIFIED_OK")]
    assert step("b.json", [("x", "RUNNING", 61)], [("late", good, 70), ("too-late", good, 71)]) == [("early", "VERIFIED_OK"), ("late", "VERIFIED_OK")]
    later = step("c.json", [("y", "SUCCEEDED", 600)], [("y", good, 600)])
    later = step("d.json", [("z", "SUCCEEDED", 700)], [("z", good, 700)])
    assert [r for r in later if r[0] in ("early", "late", "old", "too-late")] == [
        ("early", "VERIFIED_OK"), ("late", "VERIFIED_OK"), ("old", "VERIFIED_FAILED"), ("too-late", "VERIFIED_FAILED"),
    ]
    again = step("e.json", [], [("too-late", good, 70)])  # behind the watermark
    assert ("too-late", "VERIFIED_OK") not in again


def test_state_of_the_latest_view_ends(spark, tmp_path):
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "job_id string, task_id string, status string, timestamp timestamp_ntz, came timestamp"

    def add(day, *rows):
        came = datetime(2024, 1, day)
        spark.createDataFrame(
            [("j", t, s, datetime(2024, 1, 1, 0, 0, n), came) for t, s, n in rows], schema
        ).write.mode("append").parquet(log)
        query = latest_view.follow_latest(
            spark.readStream.schema(schema).parquet(log), out, cp, once=True, keep="1 day", delay="1 hour", arrival=F.col("came")
        )
        query.awaitTermination()
        view = latest_view.latest_view(tasks_status(spark, out))
        whole = spark.read.parquet(log).select(*schemas.TASKS_STATUS.fieldNames())
        assert sorted(view.collect()) == sorted(latest_status(whole).distinct().collect())
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    many = [(f"t{i}", s, n) for i in range(50) for n, s in enumerate(("RUNNING", "SUCCEEDED", "VERIFIED_OK"))]
    assert add(1, *many) == 150
    assert add(4, ("a", "RUNNING", 1)) <= 151
    assert add(7, ("b", "RUNNING", 1)) <= 2
    # A task whose state has ended goes on, with an old row and a new one.
    assert add(7, ("t3", "RUNNING", 1), ("t4", "FAILED", 9)) <= 4


def test_nearest_config_at_any_depth(spark):
    from batchloom.operators.joins import nearest_ancestor_config

    configs = spark.createDataFrame(
        [("b", "c.json", "top"), ("b", "x/y/c.json", "two"), ("b", "x/y/z/d.json", "other"), ("e", "/c.json", "slash"), ("e", "a//c.json", "empty")],
        "bucket string, path string, config string",
    )
    wanted = spark.createDataFrame(
        [
            (1, "b", "x/y/z/u/v/c.json"), (2, "b", "x/y/c.json"), (3, "b", "x/c.json"), (4, "b", "c.json"), (5, "b", "x/y/zz/d.json"),
            (6, "n", "x/c.json"), (7, None, "c.json"), (8, "b", None), (9, "e", "/c.json"), (10, "e", "a//c.json"), (11, "b", ""),
            (1, "b", "x/y/z/u/v/c.json"),
        ],
        "k int, bucket string, path string",
    ).withColumn("config_key", F.lit(0))
    out = nearest_ancestor_config(wanted, configs)
    assert out.columns == [*wanted.columns, "found_path", "config"]
    got = sorted(((r.k, r.config) for r in out.collect()), key=repr)
    assert got == sorted([
        (1, "two"), (1, "two"), (2, "two"), (3, "top"), (4, "top"), (5, None), (6, None), (7, None), (8, None), (9, "slash"),
        (10, "empty"), (11, None),
    ], key=repr)
    assert nearest_ancestor_config(wanted, configs.limit(0)).where("config is not null").count() == 0
