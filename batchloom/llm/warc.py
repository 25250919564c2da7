"""WARC archives: a distributed writer, and a Python data source that reads them.

Writing: every page is one record, and Spark's text sink writes the records, so
archives go to any store Spark can write to. Of pages with equal payloads the
one with the largest id is a ``response``; the others are ``revisit`` records
that carry the head, the digest and a reference, and no payload.

Reading, ``spark.read.format("warc").load(folder)``: files are listed once and
packed into partitions of about ``partitionBytes``; a file is never cut, since a
payload may look like the start of a record. Predicates on record type and on
header columns are pushed down: headers are parsed first, and the block of a
record that fails is passed over (by a seek, or read and dropped in a compressed
file) and never decoded. ``payload`` = ``false`` passes over all blocks.

Defined cases: a null html is an empty payload; a null url leaves out its header;
line breaks in a url are percent-encoded. A null page id counts as smallest.
Rows that share the largest id of a payload are all responses. Payloads smaller
than ``min_bytes`` are always responses. An empty table gives an archive without
records. Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from batchloom.llm.common import ship
from batchloom.session import run_folder

VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"
NEW_LINE = "\r\n"

# Column of the data source -> header of the record.
HEADER_COLUMNS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 32 characters of 5 bits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with digest, payload_bytes and ``refers_to`` (null for responses).

    The largest id per payload is combined before the shuffle. Only payloads
    that occur twice are joined back, and that side has one row per payload, so a
    payload of a third of all pages can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    twice = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .drop("copies")
    )
    joined = rows.join(twice, ["digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", refers.alias("refers_to"))


def records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text per page: the record without the blank lines that end it."""
    rows = with_originals(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEW_LINE}Content-Type: text/html; charset=utf-8{NEW_LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(NEW_LINE * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(NEW_LINE))

    def urn(page_id: Column) -> Column:
        return F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    nothing = F.lit("")
    head = F.concat(
        F.lit(VERSION + NEW_LINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), nothing),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(nothing),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(NEW_LINE),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, records_per_file: int = 50_000, compression: str = "gzip", **options) -> None:
    """Write pages as WARC files below ``path``."""
    (
        records(pages, **options)
        .write.option("lineSep", NEW_LINE * 2)
        .option("compression", compression)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.allowed: dict[str, set] = {}
        self.starts: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self._allow(name, {f.value})
            elif isinstance(f, In):
                self._allow(name, set(f.value))
            elif isinstance(f, StringStartsWith):
                self.starts.append((name, f.value))
            elif isinstance(f, IsNotNull):
                self.starts.append((name, ""))
            else:
                yield f

    def _allow(self, name: str, values: set) -> None:
        self.allowed[name] = self.allowed[name] & values if name in self.allowed else values

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _file_system(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
        parts, now, total = [], [], 0
        for path, size in files:
            if now and total + size > self.partition_bytes:
                parts.append(Files(now))
                now, total = [], 0
            now.append(path)
            total += size
        return [*parts, Files(now)] if now else parts or [Files([])]

    def wanted(self, columns: dict[str, str | None]) -> bool:
        return all(columns[c] in values for c, values in self.allowed.items()) and all(
            columns[c] is not None and columns[c].startswith(start) for c, start in self.starts
        )

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.files:
            for row in self._records(path):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    def _records(self, path: str) -> Iterator[dict]:
        store, _ = _file_system(self.path)
        plain = not path.endswith(".gz")
        raw = store.open_input_file(path) if plain else store.open_input_stream(path, compression="gzip")
        with io.BufferedReader(raw, 1 << 20) as stream:
            while line := stream.readline():
                if line in (b"\r\n", b"\n"):
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: a record begins with {line[:40]!r}")
                head = _headers(stream)
                length = int(head["content-length"])
                row: dict = {c: head.get(h) for c, h in HEADER_COLUMNS.items()}
                if not self.wanted(row) or not self.with_payload:
                    skipped = stream.seek(length, io.SEEK_CUR) if plain else _drop(stream, length)
                    if not self.wanted(row) or skipped is None:
                        continue
                    yield row | {"headers": list(head.items()), "content_length": length, "payload_length": None, "payload": None}
                    continue
                block = stream.read(length)
                if len(block) != length:
                    raise ValueError(f"{path}: a block ends after {len(block)} of {length} bytes")
                body, told = block, length
                if (row["content_type"] or "").startswith("application/http"):
                    part = io.BytesIO(block)
                    part.readline()
                    told = int(_headers(part).get("content-length", length - part.tell()))
                    body = part.read()
                has_body = row["warc_type"] != "revisit"
                yield row | {
                    "headers": list(head.items()), "content_length": length,
                    "payload_length": len(body) if has_body else told, "payload": body if has_body else None,
                }


def _headers(stream) -> dict[str, str]:
    """Lines up to a blank one, names in lower case; a folded line goes on."""
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().lower().decode("utf-8", "replace")
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def _drop(stream, length: int) -> int:
    while length > 0 and (piece := stream.read(min(length, 1 << 16))):
        length -= len(piece)
    return 0


SCHEMA = (
    ", ".join(f"{c} string" for c in HEADER_COLUMNS)
    + ", headers map<string,string>, content_length bigint, payload_length bigint, payload binary"
)
ARROW_SCHEMA = pa.schema(
    [(c, pa.string()) for c in HEADER_COLUMNS]
    + [
        ("headers", pa.map_(pa.string(), pa.string())), ("content_length", pa.int64()),
        ("payload_length", pa.int64()), ("payload", pa.binary()),
    ]
)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of all WARC files below ``path``."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a new archive in the shared folder and tell what it holds.

    Length and digest of responses come from the payload that was read.
    """
    spark = pages.sparkSession
    path = run_folder(spark, "warc")
    write_archive(pages, path, min_bytes=min_bytes)
    read = read_archive(spark, path).where(F.col("warc_type").isin("response", "revisit"))

    def page(urn: Column) -> Column:
        number = F.regexp_extract(urn, f"^<{PAGE_URN}(.*)>$", 1)
        return F.when(number != "", number).cast("long")

    whole = F.col("payload").isNotNull()
    return read.select(
        page(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )
