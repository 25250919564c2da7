"""Reports on known histories: golden counts, ties, nulls and filters."""

from datetime import datetime, timedelta

import pytest

from batchloom import schemas
from batchloom.operators.latest import first_match, latest_status, latest_status_ranked
from batchloom.plans import reports

T0 = datetime(2023, 10, 7, 3, 18, 29)


def array_row(job, index, sample, label, created=T0, path=None):
    return (
        job, f"name-{job}", label, index, None, sample, path or f"s3://d/{sample}.cram", "cram",
        f"s3://o/{sample}", "cmd", created,
    )


@pytest.fixture(scope="module")
def dry_run(spark):
    """Three jobs: 20 samples end well, 2 without a success line, 1 fails."""
    tasks, log = [], []

    def run(job, index, sample, label, states, created):
        tasks.append(array_row(job, index, sample, label, created))
        for k, state in enumerate(states):
            log.append((job, f"{job}-group0-{index}", state, created + timedelta(seconds=90 + 9 * k)))

    for i in range(20):
        run("u0", i, f"NA{i}", "job0", ["RUNNING", "SUCCEEDED", "VERIFIED_OK"], T0)
    for i in (20, 21):
        run("u1", i - 20, f"NA{i}", "job1", ["RUNNING", "SUCCEEDED", "VERIFIED_FAILED"],
            T0 + timedelta(minutes=3))
    run("u2", 0, "NA22", "job2", ["RUNNING", "FAILED"], T0 + timedelta(minutes=5))
    return (
        spark.createDataFrame(log, schemas.TASKS_STATUS),
        spark.createDataFrame(tasks, schemas.JOB_ARRAY),
    )


def test_golden_count(dry_run):
    row = reports.count_report(*dry_run).first()
    assert tuple(row) == (23, 0, 22, 1, 20, 2)


def test_count_of_nothing(dry_run):
    assert tuple(reports.count_report(*dry_run, label="none").first()) == (0, 0, 0, 0, 0, 0)


def test_golden_history(dry_run):
    rows = reports.sample_report(*dry_run, sample_id="NA3").collect()
    assert [r.status for r in rows] == ["RUNNING", "SUCCEEDED", "VERIFIED_OK"]


def test_golden_samples(spark):
    """26 listed tasks; label and time filters, alone and together."""
    early, late = datetime(2023, 10, 7, 3, 18, 29), datetime(2023, 10, 11, 0, 12, 33)
    spec = [("u0", i, f"NA{i}", "job0", early, "VERIFIED_OK") for i in range(20)]
    spec += [("u1", i, f"NA{20 + i}", "job1", early, "VERIFIED_FAILED") for i in range(2)]
    spec += [("u2", 0, "NA22", "job2", early, "FAILED")]
    spec += [("u3", 0, "NA22", "batch_config_fail", late, "FAILED")]
    spec += [("u4", i, f"NA{20 + i}", "batch_config_pass", late, "VERIFIED_FAILED") for i in range(2)]
    tasks = spark.createDataFrame([array_row(*s[:5]) for s in spec], schemas.JOB_ARRAY)
    log = spark.createDataFrame(
        [(s[0], f"{s[0]}-group0-{s[1]}", s[5], s[4] + timedelta(seconds=100)) for s in spec],
        schemas.TASKS_STATUS,
    )
    cut = "2023-10-10 23:36:10"
    assert reports.samples_report(log, tasks).count() == 26
    assert reports.samples_report(log, tasks, label="job0").count() == 20
    assert reports.samples_report(log, tasks, after=cut).count() == 3
    both = reports.samples_report(log, tasks, after=cut, label="batch_config_fail").collect()
    assert [r.sample_id for r in both] == ["NA22"]
    listed = reports.samples_report(log, tasks).collect()
    order = [(r.status, r.batch_index, r.creation_time) for r in listed]
    assert order == sorted(order)
    assert [f.name for f in reports.samples_report(log, tasks).schema] == (
        "job_name job_label batch_index sample_id status input_path output_path input_type"
        " last_status_time creation_time"
    ).split()


def test_time_filter_is_inclusive_and_on_creation(spark):
    tasks = spark.createDataFrame([array_row("u", 0, "A", "l")], schemas.JOB_ARRAY)
    log = spark.createDataFrame(
        [("u", "u-group0-0", "RUNNING", T0 + timedelta(days=9))], schemas.TASKS_STATUS
    )
    exact = str(T0)
    assert reports.count_report(log, tasks, after=exact, before=exact).first().TOTAL == 1


def test_equal_times_are_all_latest_and_counted(spark):
    tasks = spark.createDataFrame([array_row("u", 0, "A", None)], schemas.JOB_ARRAY)
    log = spark.createDataFrame(
        [
            ("u", "u-group0-0", "SUCCEEDED", T0),
            ("u", "u-group0-0", "VERIFIED_OK", T0),
            ("u", "u-group0-0", "VERIFIED_OK", T0),
            ("u", "u-group0-0", "RUNNING", T0 - timedelta(seconds=1)),
        ],
        schemas.TASKS_STATUS,
    )
    assert tuple(reports.count_report(log, tasks).first()) == (3, 0, 2, 0, 2, 0)
    assert latest_status(log).count() == latest_status_ranked(log).count() == 3
    # The listing is distinct, the count is not.
    assert reports.samples_report(log, tasks).count() == 2
    # A null label passes an empty filter only.
    assert reports.count_report(log, tasks, label="x").first().TOTAL == 0


def test_succeeded_without_verdict_is_in_total_only(spark):
    tasks = spark.createDataFrame([array_row("u", 0, "A", "l")], schemas.JOB_ARRAY)
    log = spark.createDataFrame([("u", "u-group0-0", "SUCCEEDED", T0)], schemas.TASKS_STATUS)
    assert tuple(reports.count_report(log, tasks).first()) == (1, 0, 0, 0, 0, 0)


def test_null_task_ids_and_padded_indexes(spark):
    tasks = spark.createDataFrame([array_row("u", 7, "A", "l")], schemas.JOB_ARRAY)
    log = spark.createDataFrame(
        [("u", None, "RUNNING", T0), ("u", "u-group0-07", "RUNNING", T0), ("u", "odd", "RUNNING", T0)],
        "job_id string, task_id string, status string, timestamp timestamp_ntz",
    )
    assert latest_status(log).count() == latest_status_ranked(log).count() == 2
    assert reports.count_report(log, tasks).first().TOTAL == 0


def test_latest_is_per_task_over_all_jobs(spark):
    """A later row of the same task id under another job hides the earlier one."""
    tasks = spark.createDataFrame([array_row("u", 0, "A", "l")], schemas.JOB_ARRAY)
    log = spark.createDataFrame(
        [("u", "x-group0-0", "RUNNING", T0), ("v", "x-group0-0", "FAILED", T0 + timedelta(seconds=1))],
        schemas.TASKS_STATUS,
    )
    assert reports.count_report(log, tasks).first().TOTAL == 0
    assert reports.count_report(log, tasks, sample_id="A").first().TOTAL == 0


def test_filters_narrow_the_log(dry_run):
    assert tuple(reports.count_report(*dry_run, label="job0").first()) == (20, 0, 20, 0, 20, 0)
    assert tuple(reports.count_report(*dry_run, after="2023-10-07 03:22:00").first()) == (1, 0, 0, 1, 0, 0)
    assert tuple(reports.count_report(*dry_run, sample_id="NA3").first()) == (1, 0, 1, 0, 1, 0)
    assert reports.sample_report(*dry_run, sample_id="NA22").count() == 2
    assert reports.samples_report(*dry_run, sample_id="none").count() == 0


def test_reports_are_lazy_and_filtered_ones_join_keys_first(spark, dry_run):
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "reports are only planned")
    found = reports.count_report(*dry_run, label="job0")
    reports.samples_report(*dry_run, sample_id="NA3")
    reports.sample_report(*dry_run, sample_id="NA3")
    assert not sc.statusTracker().getJobIdsForGroup("lazy")
    sc._jsc.clearJobGroup()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    # Below the keys of the semi join nothing of the log but these keys is moved.
    assert plan.count("LeftSemi") >= 2 and "Cartesian" not in plan


def test_rows_equal_in_output_stay_when_their_keys_differ(spark):
    same = dict(created=T0, path="s3://d/x")
    tasks = [array_row("u", 0, "A", "l", **same), array_row("v", 0, "A", "l", **same)]
    tasks = [(t[0], "same-name", *t[2:]) for t in tasks]
    log = [("u", "u-group0-0", "FAILED", T0), ("v", "v-group0-0", "FAILED", T0)]
    report = reports.samples_report(
        spark.createDataFrame(log, schemas.TASKS_STATUS),
        spark.createDataFrame(tasks, schemas.JOB_ARRAY),
    )
    assert report.count() == 2 and report.distinct().count() == 1


def test_shown_rows_and_parameters(spark):
    assert reports.shown(spark.range(20_000), 10_000).count() == 10_000
    assert reports.shown(spark.range(5), 10).count() == 5
    got = reports.run_query(spark, "SELECT :a AS a", a="x' OR '1'='1")
    assert got.first().a == "x' OR '1'='1"


def test_first_match_is_in_the_given_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("m", 5, "q")], "k string, o int, v string")
    got = {r.k: r.v for r in first_match(df, ["k"], ["o"]).collect()}
    assert got == {"k": "z", "m": "q"}


def test_hot_task_and_copies_are_kept_whole(spark):
    """A third of the rows is one task, a third are copies of one row."""
    from pyspark.sql import functions as F

    n = 30_000
    base = spark.range(n).select(
        F.lit("u").alias("job_id"),
        F.when(F.col("id") < n // 3, "u-group0-1")
        .when(F.col("id") < 2 * n // 3, "u-group0-2")
        .otherwise(F.concat(F.lit("u-group0-"), F.col("id"))).alias("task_id"),
        F.when(F.col("id") % 2 == 0, "RUNNING").otherwise("FAILED").alias("status"),
        F.when(
            F.col("id") < n // 3,
            F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 500).cast("int")),
        ).otherwise(F.lit(T0)).cast("timestamp_ntz").alias("timestamp"),
    )
    tasks = spark.range(n).select(
        F.lit("u").alias("job_id"), F.lit("n").alias("job_name"), F.lit("l").alias("job_label"),
        F.col("id").alias("batch_task_index"), F.lit("s").alias("sample_id"),
        F.lit("p").alias("input_path"), F.lit("cram").alias("input_type"),
        F.lit("o").alias("output_path"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"),
    )
    ties_hot = sum(1 for i in range(n // 3) if i % 500 == 499)
    want = ties_hot + n // 3 + (n - 2 * (n // 3))
    assert reports.count_report(base, tasks).first().TOTAL == want
    assert latest_status_ranked(base).count() == want
