"""Writes to warehouse tables. A table is a folder of parquet files and of records.

Every write goes to a folder of its own, ``writer=<id>/batch_id=<n>/attempt=<id>[/day=<date>]``,
and counts from the moment its record stands in ``_records``: a small JSON file that
names the folder, and the records it replaces. Readers take the folders of all
records that no other record replaces. So a batch is seen as a whole or not at all, and
a repeated batch, a compaction or a truncation puts new rows in the place of old ones in
one step; folders that no record names are left over from lost attempts and are
never read. ``vacuum`` removes what is not in use any more.

Batch appends, streams and compaction can share a table. A stream's id is that of its
checkpoint, so a new checkpoint, or a second stream, never replaces what another
one wrote. Files that lay in the folder before the first record belong to the table, too.
Tables with a ``timestamp`` are cut by day, so readers can prune days. A table that is
looked up by a key can be cut by the key's hash instead, each file sorted by its ``Layout``, with Bloom
filters, so that a lookup of a few keys (``of_keys``) opens few files and reads few row groups.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS = ["writer", "batch_id", "attempt"]
RECORDS = "_records"
_ADOPTED = "adopted"
_RECORD = "id string, writer string, batch_id bigint, folders array<string>, replaces array<string>, fields string, cut string"
_BUCKET = "bucket_of_"
KEY_BUCKETS = 64
ROW_GROUP = 16 << 20  # bytes


@dataclass(frozen=True)
class Layout:
    """Files of a table that is looked up by its first key: cut by its hash, sorted by all keys."""

    keys: tuple[str, ...]

    @property
    def cut(self) -> str:
        return _BUCKET + self.keys[0]


TASK_LAYOUT = Layout(("job_id", "batch_task_index"))
LOG_LAYOUT = Layout(("job_uid", "task_id"))


def bucket_of(key: Column) -> Column:
    """The folder number of a key."""
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def of_keys(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """The rows of some keys; where the table is cut by the key, only their folders are read."""
    wanted = F.col(key).isin(list(values))
    if _BUCKET + key in table.columns:
        wanted = wanted & F.col(_BUCKET + key).isin(*[bucket_of(F.lit(v)) for v in values])
    return table.filter(wanted)


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows in a table's column order and types, and rows missing a required value."""
    fitted = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    complete = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            complete = complete & F.col(f.name).isNotNull()
    return fitted.filter(complete), fitted.filter(~complete)


# -- records ---------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own type."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _glob(spark: SparkSession, pattern: str) -> list:
    fs, place = _files(spark, pattern)
    return list(fs.globStatus(place) or [])


def _visible(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that hold data."""
    names = [found.getPath().getName() for found in _glob(spark, path + "/*")]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def records(spark: SparkSession, path: str) -> list[Row]:
    """All records of a table: a few per batch since its last vacuum."""
    if not _glob(spark, f"{path}/{RECORDS}/*.json"):
        return []
    return spark.read.schema(_RECORD).json(f"{path}/{RECORDS}/*.json").collect()


def live(found: list[Row]) -> list[Row]:
    """The records that no other one replaces."""
    gone = {old for record in found for old in record.replaces}
    return sorted((r for r in found if r.id not in gone), key=lambda r: r.id)


def _put(spark: SparkSession, path: str, name: str, **fields) -> None:
    """A record appears under its name by one rename, complete."""
    fs, place = _files(spark, f"{path}/{RECORDS}/.{name}")
    out = fs.create(place, True)
    out.write(bytearray(json.dumps({"id": name, **fields}), "utf-8"))
    out.close()
    if not fs.rename(place, _files(spark, f"{path}/{RECORDS}/{name}.json")[1]):
        fs.delete(place, False)


def _adopt(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """A first record for files that were there before any record."""
    if _glob(spark, f"{path}/{RECORDS}/*.json"):
        return
    before = [name for name in _visible(spark, path) if not name.startswith("writer=")]
    if before:
        _put(spark, path, _ADOPTED, writer=_ADOPTED, batch_id=0, folders=before, replaces=[], fields=schema.json())


# -- writes ----------------------------------------------------------------


def append(df: DataFrame, path: str, schema: T.StructType, layout: Layout | None = None) -> DataFrame:
    """Append all complete rows in one write; returns the rejected rows."""
    good, bad = conform(df, schema)
    write_batch(good, path, 0, f"append-{uuid.uuid4().hex}", layout)
    return bad


def write_batch(df: DataFrame, path: str, batch_id: int, writer: str, layout: Layout | None = None) -> None:
    """Write one batch of a writer; a repeated batch replaces itself.

    A batch that a compaction or truncation has taken over since stays as it is.
    """
    spark = df.sparkSession
    mine = batch_records(spark, path, batch_id, writer)
    if mine is None:
        return
    _write(df, path, batch_id, writer, [r.id for r in mine], layout)


def batch_records(spark: SparkSession, path: str, batch_id: int, writer: str) -> list[Row] | None:
    """Live records of a batch: none before its first write, None if they were all replaced."""
    if not _glob(spark, f"{path}/{RECORDS}/{writer}.{batch_id}.*.json"):
        return []
    kept = [r for r in live(records(spark, path)) if (r.writer, r.batch_id) == (writer, batch_id)]
    return kept or None


def _write(df: DataFrame, path: str, batch_id: int, writer: str, replaces: list[str], layout: Layout | None = None) -> None:
    spark, attempt = df.sparkSession, f"a{uuid.uuid4().hex}"
    _adopt(spark, path, df.schema)
    folder = f"writer={writer}/batch_id={batch_id}/attempt={attempt}"
    cut = layout.cut if layout else "day" if "timestamp" in df.columns else None
    if layout:
        _sorted_by(df, layout).partitionBy(cut).parquet(f"{path}/{folder}")
    elif cut:
        by_day = df.withColumn(cut, F.to_date("timestamp")).hint("rebalance", cut)  # few files per day
        by_day.write.partitionBy(cut).parquet(f"{path}/{folder}")
    else:
        df.write.parquet(f"{path}/{folder}")
    folders = [folder] if _visible(spark, f"{path}/{folder}") else []
    _put(
        spark, path, f"{writer}.{batch_id}.{attempt}", writer=writer, batch_id=batch_id, folders=folders,
        replaces=replaces, fields=df.schema.json(), cut=cut,
    )


def _sorted_by(df: DataFrame, layout: Layout) -> DataFrameWriter:
    """Rows of one hash together, in as many files as their size asks for, sorted inside."""
    cut = df.withColumn(layout.cut, bucket_of(F.col(layout.keys[0]))).hint("rebalance", layout.cut)
    writer = cut.sortWithinPartitions(layout.cut, *layout.keys).write.option("parquet.block.size", ROW_GROUP)
    text = [k for k in layout.keys if df.schema[k].dataType == T.StringType()]
    for key in text:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", 20_000)
    return writer


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType, layout: Layout | None = None) -> None:
    """A copy of a table in a few files, in a new folder ``target``.

    Readers and writers of ``path`` go on meanwhile; whoever owns the table
    switches over when its writers stand still.
    """
    rows = _in_few_files(read_table(spark, path, schema), schema, layout)
    _write(rows, target, 0, f"compact-{uuid.uuid4().hex}", [], layout)


def compact_in_place(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    layout: Layout | None = None,
    fold: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Put a few files in the place of all batches that are there now.

    Readers see the old files or the new ones; batches written meanwhile stay beside
    them. ``fold`` makes fewer rows of the old ones, where a table allows that.
    """
    now = live(records(spark, path))
    if not now:
        raise ValueError(f"{path} has no records")
    rows = _rows(spark, path, now, schema)
    folded = fold(rows.select(*schema.fieldNames())) if fold else rows
    _write(_in_few_files(folded, schema, layout), path, 0, f"compact-{uuid.uuid4().hex}", [r.id for r in now], layout)


def _in_few_files(rows: DataFrame, schema: T.StructType, layout: Layout | None) -> DataFrame:
    rows = rows.select(*schema.fieldNames())
    # Tables that are cut have their rows gathered by the write.
    return rows if layout or "timestamp" in rows.columns else rows.hint("rebalance")


def truncate(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Remove all rows of a table; it stays readable by its schema."""
    _adopt(spark, path, schema)
    now, name = live(records(spark, path)), f"truncate-{uuid.uuid4().hex}"
    cut = "day" if "timestamp" in schema.fieldNames() else None
    _put(spark, path, name, writer=name, batch_id=0, folders=[], replaces=[r.id for r in now], fields=schema.json(), cut=cut)


def vacuum(spark: SparkSession, path: str, hours: float = 24 * 7) -> int:
    """Delete files and records that have not been in use for ``hours``; returns their number.

    Readers that planned before, and batches that may be repeated, should be
    younger than that.
    """
    found = records(spark, path)
    if not found:
        return 0
    kept = live(found)
    in_use = {folder for r in kept for folder in r.folders}
    old = (time.time() - hours * 3600) * 1000
    names = {r.id for r in kept}
    left = [s for s in _glob(spark, f"{path}/writer=*/batch_id=*/attempt=*")]
    unused = [s for s in left if "/".join(s.getPath().toString().split("/")[-3:]) not in in_use]
    first = [s for r in found if r.id not in names and r.writer == _ADOPTED for f in r.folders for s in _glob(spark, f"{path}/{f}")]
    replaced = [s for s in _glob(spark, f"{path}/{RECORDS}/*.json") if s.getPath().getName()[:-5] not in names]
    fs, _ = _files(spark, path)
    # A record goes before the one that replaced it: what was replaced never counts again.
    replaced.sort(key=lambda s: s.getModificationTime())
    gone = [s for s in [*unused, *first, *replaced] if s.getModificationTime() <= old]
    for status in gone:
        fs.delete(status.getPath(), True)
    return len(gone)


# -- reads -----------------------------------------------------------------


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, without: tuple[str, int] | None = None
) -> DataFrame:
    """All rows of a table as it stands now, whoever wrote them.

    The column a table is cut by (``day``, ``bucket_of_<key>``) stays, for pruning.
    Without a schema the columns are those of the files. A folder without
    records is read as it is. ``without`` leaves out one (writer, batch).
    """
    found = records(spark, path)
    if not found:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path).drop(*FOLDERS)
    kept = live(found)
    if without:
        fields = schema or T.StructType.fromJson(json.loads(kept[-1].fields)) if kept else schema
        kept = [r for r in kept if (r.writer, r.batch_id) != without]
        if not kept:
            return spark.createDataFrame([], fields)
    return _rows(spark, path, kept, schema)


def first_written(spark: SparkSession, path: str, batch_id: int, writer: str) -> DataFrame | None:
    """The rows a batch has written, also if a compaction holds them now; None before its first write."""
    if not _glob(spark, f"{path}/{RECORDS}/{writer}.{batch_id}.*.json"):
        return None
    own = [r for r in records(spark, path) if (r.writer, r.batch_id) == (writer, batch_id)]
    newest = live(own)[:1]
    fields = T.StructType.fromJson(json.loads(newest[0].fields))
    return _rows(spark, path, newest, fields).select(*fields.fieldNames())


def _rows(spark: SparkSession, path: str, found: list[Row], schema: T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    by_cut: dict[str | None, list[str]] = {}
    for r in found:  # folders that are cut alike are one read
        kind = _ADOPTED if r.writer == _ADOPTED else r.cut
        by_cut.setdefault(kind, []).extend(f"{path}/{folder}" for folder in r.folders)
    parts = [reader.option("basePath", path).parquet(*some).drop(*FOLDERS) for some in by_cut.values() if some]
    if not parts:
        parts = [spark.createDataFrame([], schema or T.StructType.fromJson(json.loads(found[-1].fields)))]
    for cut in {r.cut for r in found} - {None}:
        value = F.to_date("timestamp") if cut == "day" else bucket_of(F.col(cut[len(_BUCKET) :]))
        parts = [p if cut in p.columns else p.withColumn(cut, value) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
