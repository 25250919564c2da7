"""Quality rules: lines that many documents of a host share, and what is left.

Lines are normalised (A-Z lower case, digits as 0, white space collapsed) and
hashed. A line is common on its host (here: the source) when it is in more than
``max_docs`` distinct texts, however many the host has; whole copies of a text
count once. Common lines are removed, and a document is rejected when fewer than
``min_words`` words or less than ``min_left`` of its words are left. Base rules
reject texts of fewer than ``min_words`` words, and those where over a fifth of
the words repeat.

Defined cases: null and empty texts have no words and fail the base rules. A
null source is a host. Equal rows are judged alike, each on its own. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm import textscan
from batchloom.llm.common import map_batches, row_key, stored

_PLAIN = textscan.byte_table(textscan.not_blank, lower=False)
_LINE = bytes(0x30 if 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_LINES = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
REPEAT_WINDOW = 5


def _sums(words: textscan.Words, values: np.ndarray) -> np.ndarray:
    """Sums of a value per byte, for each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[words.text_start[1:] - 1] - total[words.text_start[:-1]]


def _repeated(words: textscan.Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    at, keys = words.windows(hashes, REPEAT_WINDOW)
    own = textscan.mixed(keys + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    twin = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), dtype=bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return inside[words.first[1:]] - inside[words.first[:-1]]


def _lines(text: bytes | None) -> tuple[int, list[dict]]:
    """Repeated lines of a text; hash and words of each different normalised line."""
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for line in lines:
        words = line.translate(_LINE).split()
        key = b" ".join(words)
        seen[key] = seen.get(key, 0) + len(words)
    rows = [{"hash": xxhash.xxh3_64_intdigest(k) - (1 << 63), "words": n} for k, n in seen.items()]
    return len(lines) - len(set(lines)), rows


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = textscan.utf8(batch.column("text"))
        for begin, end in textscan.in_pieces(texts):
            words = textscan.Words(texts[begin:end], _PLAIN)
            raw = words.array
            chars = ((raw & 0xC0) != 0x80) & (raw != 32)
            lines = [_lines(t) for t in texts[begin:end]]
            part = batch.slice(begin, end - begin)
            columns = {
                "key": part.column("key"),
                "doc_id": part.column("doc_id"),
                "source": part.column("source"),
                "text_key": part.column("text_key"),
                "n_words": pa.array(words.count, pa.int64()),
                "word_chars": pa.array(_sums(words, chars), pa.int64()),
                "n_symbols": pa.array(_sums(words, _SYMBOL[raw]), pa.int64()),
                "n_dup_lines": pa.array([n for n, _ in lines], pa.int64()),
                "n_repeat_words": pa.array(_repeated(words, words.hashes()), pa.int64()),
                "lines": pa.array([rows for _, rows in lines], _LINES),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def measured(docs: DataFrame) -> DataFrame:
    """Base figures and line hashes of every document."""
    types = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    rows = docs.select(
        row_key("doc_id", "source", "text").alias("key"), "doc_id", "source", F.xxhash64("text").alias("text_key"), "text"
    )
    schema = (
        f"key binary, doc_id {types['doc_id']}, source {types['source']}, text_key bigint, n_words bigint, word_chars bigint, "
        "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<hash:bigint,words:int>>"
    )
    return map_batches(rows, _measure, schema)


def common_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """Lines above the limit: host, hash, n_texts.

    Copies of a text fall together first, then counts are added up before the
    shuffle by line, so a line of a third of all documents is one row per task.
    """
    each = rows.select("source", "text_key", F.explode("lines.hash").alias("hash")).distinct()
    counts = each.groupBy("source", "hash").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > max_docs)
    return counts.withColumnRenamed("source", "host")


def judged(docs: DataFrame, max_docs: int = 10, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """A row per document: doc_id, base figures, base_failed, n_common_words, kept."""
    rows = stored(measured(docs), "line-figures")
    common = common_lines(rows, max_docs)
    each = rows.select("key", "source", F.explode("lines").alias("line")).distinct().select("key", "source", "line.*")
    same = F.col("source").eqNullSafe(F.col("host")) & (F.col("hash") == F.col("line_hash"))
    removed = (
        each.join(common.withColumnRenamed("hash", "line_hash"), same)
        .groupBy("key")
        .agg(F.sum("words").alias("n_common_words"))
    )
    n = F.col("n_words")
    out = rows.drop("lines", "text_key").join(removed, "key", "left")
    out = out.withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > 20 * n)
    left = n - F.col("n_common_words")
    depleted = (left < min_words) | (left < min_left * n)
    return out.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~failed & ~depleted).alias("kept"), "n_common_words",
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, hashes in zip(textscan.utf8(batch.column("text")), batch.column("__common").to_pylist()):
            gone = set(hashes)
            lines = text.split(b"\n")
            keep = [x for x in lines if xxhash.xxh3_64_intdigest(b" ".join(x.translate(_LINE).split())) - (1 << 63) not in gone]
            out.append(b"\n".join(keep).decode("utf-8"))
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def cleaned(docs: DataFrame, max_docs: int = 10) -> DataFrame:
    """The documents without the common lines of their host; all columns in their order."""
    rows = stored(measured(docs), "line-figures")
    common = common_lines(rows, max_docs)
    each = rows.select("key", "source", F.explode("lines.hash").alias("line_hash")).distinct()
    same = F.col("source").eqNullSafe(F.col("host")) & (F.col("hash") == F.col("line_hash"))
    per_doc = each.join(common, same).groupBy(F.col("key").alias("__key")).agg(F.collect_list("line_hash").alias("__common"))
    joined = docs.withColumn("__key", row_key("doc_id", "source", "text")).join(per_doc, "__key", "left").drop("__key")
    hit = joined.where(F.col("__common").isNotNull())
    both = joined.where(F.col("__common").isNull()).unionByName(map_batches(hit, _strip, hit.schema))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
