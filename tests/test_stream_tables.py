"""Stream queries over tables that are folders of several files."""

from dataclasses import replace
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from batchloom.plans.task_array import Launcher
from batchloom.sinks import tables
from batchloom.sinks.tables import read_table
from batchloom.sources.events import object_stream
from batchloom.streaming import job_stream, runner
from tests.test_queries import rows_of
from tests.test_streams import trigger_setup


def put_tables(spark, folder):
    pages = [(i, f"https://h{i % 3}.org/a{i % 4}/p{i}?q={i}", "<p>") for i in range(60)]
    kinds = ("click", "view", "purchase")
    events = [(i, i % 12, kinds[i % 3], datetime(2024, 1, 1 + i % 25, i % 24)) for i in range(120)]
    documents = [(i, "License" if i % 2 else "none") for i in range(80)]
    frames = {
        "events": spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz"),
        "documents": spark.createDataFrame(documents, "doc_id bigint, text string"),
        "pages": spark.createDataFrame(pages, "page_id bigint, url string, html string"),
        "customer": spark.range(1, 90).withColumnRenamed("id", "c_custkey"),
        "region": spark.range(5).withColumnRenamed("id", "r_regionkey"),
    }
    for name, rows in frames.items():
        rows.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def wanted(folder, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}/*.parquet')")
    return con.sql(entry.oracle_sql()[name]).to_arrow_table()


@pytest.mark.parametrize("name", ["stream_routed_jobs", "stream_routes", "stream_verify_waiting"])
def test_streams_read_all_files_of_a_folder(spark, tmp_path, name):
    folder = put_tables(spark, tmp_path)
    got, want = entry.queries()[name](spark, str(folder)).toArrow(), wanted(folder, name)
    assert want.num_rows > 0
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_tables_of_a_micro_batch_do_not_read_the_whole_store_of_texts(spark, tmp_path, monkeypatch):
    stores, sinks = trigger_setup(spark, tmp_path)
    store, read = str(tmp_path / "store"), {}
    stores.texts().write.parquet(store)

    def noted(rows, path, *rest):
        read[path] = [f for f in rows.inputFiles() if store in f]
        tables.write_batch(rows, path, *rest)

    monkeypatch.setattr(runner, "write_batch", noted)
    job_stream.follow_triggers(
        object_stream(spark, str(tmp_path / "objects")), replace(stores, texts=lambda: spark.read.parquet(store)),
        sinks, Launcher("sa@p", "H", "app"), "gs://sched/jobs.csv", str(tmp_path / "cp"), once=True,
    ).awaitTermination()
    assert {sinks.tasks, sinks.lists, sinks.jobs, sinks.rejects, sinks.triggers} < set(read)
    assert not any(read.values())
    assert read_table(spark, sinks.tasks).count() == 2
