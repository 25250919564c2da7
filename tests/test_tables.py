"""Tables with records: what readers see while batches come, repeat and are compacted."""

import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import schemas
from batchloom.sinks import tables
from batchloom.sources import warehouse
from batchloom.streaming.runner import Write

DAY = schemas.TASKS_STATUS


def rows(spark, *values):
    return spark.createDataFrame([("j", f"t{v}", "RUNNING", datetime(2024, 1, 1 + v % 3)) for v in values], DAY)


def seen(spark, path):
    return sorted(r.task_id for r in tables.read_table(spark, path, DAY).collect())


@pytest.fixture
def watched(spark, monkeypatch):
    """Looks at a table in the moment before a record appears."""
    looks = []

    def put(session, path, name, **fields):
        looks.append(seen(spark, path) if tables.records(spark, path) else None)
        real(session, path, name, **fields)

    real = tables._put
    monkeypatch.setattr(tables, "_put", put)
    return looks


def test_readers_see_old_rows_or_new_ones(spark, tmp_path, watched):
    path = str(tmp_path / "t")
    tables.write_batch(rows(spark, 1, 2), path, 0, "w")
    tables.write_batch(rows(spark, 3), path, 1, "w")
    tables.write_batch(rows(spark, 4, 5, 6), path, 1, "w")  # the batch again, with other rows
    assert seen(spark, path) == ["t1", "t2", "t4", "t5", "t6"]
    tables.compact_in_place(spark, path, DAY)
    assert seen(spark, path) == ["t1", "t2", "t4", "t5", "t6"]
    tables.truncate(spark, path, DAY)
    assert seen(spark, path) == []
    tables.append(rows(spark, 7), path, DAY)
    assert seen(spark, path) == ["t7"]
    full = ["t1", "t2", "t4", "t5", "t6"]
    assert watched == [None, ["t1", "t2"], ["t1", "t2", "t3"], full, full, []]


def test_a_reader_keeps_what_it_planned(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(rows(spark, 1), path, 0, "w")
    before = tables.read_table(spark, path, DAY)
    tables.write_batch(rows(spark, 2, 3), path, 0, "w")
    tables.compact_in_place(spark, path, DAY)
    assert before.count() == 1 and seen(spark, path) == ["t2", "t3"]


def test_a_batch_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_batch(rows(spark, 1), path, 0, "w")
    with monkeypatch.context() as m:
        m.setattr(tables, "_put", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.write_batch(rows(spark, 2), path, 1, "w")
    assert seen(spark, path) == ["t1"]
    tables.write_batch(rows(spark, 2), path, 1, "w")
    assert seen(spark, path) == ["t1", "t2"]


def test_batches_beside_and_after_a_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_batch(rows(spark, 1), path, 0, "w")
    real = tables._put

    def put(session, place, name, **fields):
        if name.startswith("compact"):  # while it is at work, a batch comes in
            monkeypatch.setattr(tables, "_put", real)
            tables.write_batch(rows(spark, 9), path, 1, "w")
        real(session, place, name, **fields)

    monkeypatch.setattr(tables, "_put", put)
    tables.compact_in_place(spark, path, DAY)
    assert seen(spark, path) == ["t1", "t9"]
    tables.write_batch(rows(spark, 1), path, 0, "w")  # a late repetition adds nothing
    assert seen(spark, path) == ["t1", "t9"]


def test_vacuum_removes_what_is_not_in_use(spark, tmp_path):
    path = tmp_path / "t"
    tables.append(rows(spark, 1, 2), str(path), DAY)
    for _ in range(3):
        tables.write_batch(rows(spark, 3), str(path), 0, "w")
    assert tables.vacuum(spark, str(path)) == 0  # all is young
    assert tables.vacuum(spark, str(path), hours=0) == 4
    tables.compact_in_place(spark, str(path), DAY)
    assert tables.vacuum(spark, str(path), hours=0) == 4
    assert seen(spark, str(path)) == ["t1", "t2", "t3"]
    assert len(list(path.glob("writer=*/batch_id=*/attempt=*"))) == 1 == len(list((path / "_records").glob("*.json")))
    assert tables.vacuum(spark, str(tmp_path / "none"), hours=0) == 0


def test_files_from_before_the_first_record_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, 1, 2).write.parquet(path)
    assert seen(spark, path) == ["t1", "t2"]
    tables.append(rows(spark, 3), path, DAY)
    assert seen(spark, path) == ["t1", "t2", "t3"]
    tables.compact_in_place(spark, path, DAY)
    assert seen(spark, path) == ["t1", "t2", "t3"]
    assert tables.vacuum(spark, path, hours=0) > 0 and seen(spark, path) == ["t1", "t2", "t3"]


def test_rows_kept_by_the_first_attempt(spark, tmp_path):
    path, write = str(tmp_path / "t"), Write(5, "w")
    assert [r.id for r in write.kept(spark.range(1), path).collect()] == [0]
    assert [r.id for r in write.kept(spark.range(7, 9), path).collect()] == [0]
    tables.compact_in_place(spark, path, spark.range(1).schema)
    assert [r.id for r in write.kept(spark.range(7, 9), path).collect()] == [0]
    assert sorted(r.id for r in Write(6, "w").kept(spark.range(7, 9), path).collect()) == [7, 8]


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(rows(spark).limit(0), path, 0, "w")
    table = tables.read_table(spark, path)
    assert table.count() == 0 and table.columns == [*DAY.fieldNames(), "day"]
    tables.write_batch(rows(spark, 1), path, 1, "w")
    assert seen(spark, path) == ["t1"]


def scanned(df):
    """Files and rows that the scans of a query have read."""
    df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return tuple(sum(m.apply(name).value() for m in found) for name in ("numFiles", "numOutputRows"))


@pytest.fixture(scope="module")
def many_tasks(spark, tmp_path_factory):
    """A task table of 60 jobs with 200 tasks each."""
    path = str(tmp_path_factory.mktemp("tasks") / "t")
    n = F.col("id")
    job = F.concat(F.lit("job-"), (n % 60).cast("string"))
    values = {"job_id": job, "job_name": job, "batch_task_index": n, "sample_id": n.cast("string"), "timestamp": F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")}
    whole = spark.range(12_000).select(
        *[values.get(f.name, F.lit("x")).cast(f.dataType).alias(f.name) for f in schemas.JOB_ARRAY.fields]
    )
    tables.append(whole, path, schemas.JOB_ARRAY, tables.TASK_LAYOUT)
    tables.append(whole.withColumn("job_id", F.concat(F.lit("late-"), "job_id")), path, schemas.JOB_ARRAY, tables.TASK_LAYOUT)
    return path


def test_the_files_of_one_job_are_read(spark, many_tasks):
    files, rows_read = scanned(warehouse.job_array(spark, many_tasks))
    assert rows_read == 24_000
    one = warehouse.job_array(spark, many_tasks, ["job-7"])
    files_of_one, rows_of_one = scanned(one)
    # One folder of 64 per batch of the table.
    assert files_of_one <= 2 and files > 60 and rows_of_one <= 1_600
    assert one.count() == 200 and one.columns == schemas.JOB_ARRAY.fieldNames()
    assert warehouse.job_array(spark, many_tasks, []).count() == 0
    assert warehouse.job_array(spark, many_tasks, ["no such job", "late-job-1"]).count() == 200


def test_tables_without_the_layout_are_looked_up_too(spark, many_tasks, tmp_path):
    plain, mixed = str(tmp_path / "plain"), str(tmp_path / "mixed")
    whole = warehouse.job_array(spark, many_tasks)
    tables.append(whole, plain, schemas.JOB_ARRAY)
    tables.append(whole.limit(0), mixed, schemas.JOB_ARRAY)
    tables.append(whole, mixed, schemas.JOB_ARRAY)
    tables.append(whole, mixed, schemas.JOB_ARRAY, tables.TASK_LAYOUT)
    assert warehouse.job_array(spark, plain, ["job-7"]).count() == 200
    assert warehouse.job_array(spark, mixed, ["job-7"]).count() == 400
    tables.compact_in_place(spark, mixed, schemas.JOB_ARRAY, tables.TASK_LAYOUT)
    files, _ = scanned(warehouse.job_array(spark, mixed, ["job-7"]))
    assert files == 1 and warehouse.job_array(spark, mixed).count() == 48_000


def test_rows_are_sorted_and_have_bloom_filters(many_tasks):
    import pyarrow.parquet as pq

    files = [str(f) for f in pathlib.Path(many_tasks).glob("writer=*/**/*.parquet")]
    for file in files:
        found = pq.ParquetFile(file).read(["job_id", "batch_task_index"]).to_pylist()
        keys = [(r["job_id"], r["batch_task_index"]) for r in found]
        assert keys == sorted(keys)
    assert b"job_id" in pathlib.Path(files[0]).read_bytes()


def test_few_jobs(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "job_id string")
    assert sorted(warehouse.few_jobs(rows)) == ["a", "b"]
    assert warehouse.few_jobs(rows, most=1) is None


# -- counts --------------------------------------------------------------------


def test_counts_follow_every_batch(spark, tmp_path, monkeypatch):
    import random

    from batchloom import constants as K
    from batchloom.plans.reports import count_report
    from batchloom.streaming import counts, runner

    rng = random.Random(4)
    statuses = [K.RUNNING, K.SUCCEEDED, K.FAILED, K.VERIFIED_OK, K.VERIFIED_FAILED]
    array = spark.createDataFrame(
        [(f"j{i % 3}", "n", "L", i, None, "s", "p", "cram", "o", "c", datetime(2024, 1, 1)) for i in range(30)], schemas.JOB_ARRAY
    )
    log, sinks = str(tmp_path / "log"), counts.CountSinks(str(tmp_path / "state"), str(tmp_path / "counts"))

    def run():
        stream = spark.readStream.schema(DAY).parquet(log)
        counts.follow_counts(stream, lambda: array, sinks, str(tmp_path / "cp"), once=True).awaitTermination()

    def same():
        whole = count_report(spark.read.schema(DAY).parquet(log), array).collect()
        assert counts.count_now(spark, sinks).collect() == whole

    def fails(rows, path, batch_id, writer, layout=None):
        if path == sinks.counts:
            raise OSError("after the state, before the counts")
        tables.write_batch(rows, path, batch_id, writer, layout)

    for batch in range(5):  # few times, so many are equal; tasks that nobody knows; repeated rows
        some = []
        for _ in range(60):
            i = rng.randrange(36)
            task = None if rng.random() < 0.05 else f"j{i % 3}-group0-{i}" if rng.random() < 0.9 else f"j{i % 3}-x"
            some += [(f"j{i % 3}", task, rng.choice(statuses), datetime(2024, 1, 1 + rng.randrange(4)))] * rng.choice([1, 1, 2])
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in DAY.fields])
        spark.createDataFrame(some, nullable).coalesce(1).write.mode("append").parquet(log)
        if batch == 2:
            with monkeypatch.context() as m:
                m.setattr(runner, "write_batch", fails)
                with pytest.raises(Exception, match="before the counts"):
                    run()
        run()
        same()
        if batch == 3:
            counts.compact_counts(spark, sinks)
            same()
    assert tables.read_table(spark, sinks.counts, counts.COUNTS).count() <= 11
