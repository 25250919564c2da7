"""Benchmark decontamination: find test passages in documents, and remove them.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all
characters beyond ASCII. A window is ``window`` consecutive words of one
benchmark item, or all words of an item that has fewer. The hashes of all
windows are broadcast; documents are scanned with them, and every hit is then
compared word by word with the windows, by a join.

The broadcast is bounded: more than ``max_hashes`` window hashes are taken in
blocks of the hash range, with one scan of the documents per block.

Defined cases: null and empty texts, and those without a word, have no words and
no hits; such items have no window. Equal documents give equal results. Items
with equal texts all count; an item whose id is null hits words but is not
listed. Empty tables on either side give no hits. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm import textscan
from batchloom.llm.common import map_batches, row_key, stored

WINDOW = 10
MAX_HASHES = 8_000_000
_TABLE = textscan.byte_table(textscan.alphanumeric, lower=True)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("item_id"), textscan.utf8(batch.column("text"))
            for begin, end in textscan.in_pieces(texts):
                words = textscan.Words(texts[begin:end], _TABLE)
                hashes = words.hashes()
                sizes = np.minimum(words.count, window)
                rows: list[tuple[int, int, int, bytes]] = []
                for size in np.unique(sizes[sizes > 0]):
                    at, keys = words.windows(hashes, int(size))
                    mine = sizes[words.text[at]] == size
                    for i, key in zip(at[mine], keys[mine].view(np.int64)):
                        rows.append((int(words.text[i]) + begin, int(size), int(key), words.window_bytes(i, int(size))))
                if rows:
                    owner, n, key, text = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(owner)).cast(pa.string()), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(text, pa.binary())],
                        ["item_id", "n", "hash", "window"],
                    )

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All windows of the benchmark: item_id, n (words), hash, window."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    return map_batches(rows, _item_windows(window), "item_id string, n int, hash bigint, window binary").distinct()


_HITS = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("window", pa.binary())]))


def _scan(wanted, block: int):
    """wanted: a broadcast dict from window size to the sorted hashes of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textscan.utf8(batch.column("text"))
            for begin, end in textscan.in_pieces(texts):
                words = textscan.Words(texts[begin:end], _TABLE)
                hashes = words.hashes()
                hits: list[list[dict]] = [[] for _ in range(end - begin)]
                for size, known in wanted.value.items():
                    at, keys = words.windows(hashes, size)
                    place = np.searchsorted(known, keys)
                    found = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == keys)
                    for i in found:
                        p = int(at[i])
                        text = int(words.text[p])
                        hits[text].append(
                            {"pos": p - int(words.first[text]), "n": size, "hash": int(keys[i].view(np.int64)), "window": words.window_bytes(p, size)}
                        )
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(hits, _HITS), pa.array([block] * part.num_rows, pa.int32())],
                    ["key", "doc_id", "n_words", "hits", "block"],
                )

    return run


def scanned(docs: DataFrame, windows: DataFrame, max_hashes: int = MAX_HASHES) -> DataFrame:
    """Key, doc_id, n_words and candidate hits of every document, per block of hashes."""
    spark = docs.sparkSession
    keys = windows.select("n", "hash").distinct()
    total = keys.count()
    blocks = max(1, -(-total // max_hashes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key binary, doc_id {id_type}, n_words bigint, hits array<struct<pos:int,n:int,hash:bigint,window:binary>>, block int"
    rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    out = None
    for block in range(blocks):
        part = keys if blocks == 1 else keys.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block)
        table = part.toArrow()
        sizes, hashes = table["n"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
        wanted = spark.sparkContext.broadcast({int(n): np.sort(hashes[sizes == n]) for n in np.unique(sizes)})
        scan = map_batches(rows, _scan(wanted, block), schema)
        out = scan if out is None else out.unionByName(scan)
    return out


def covered(ranges: Column) -> Column:
    """Number of positions in the union of ``(pos, end)`` ranges."""
    start = F.struct(F.lit(0).alias("till"), F.lit(0).cast("bigint").alias("total"))

    def add(s: Column, r: Column) -> Column:
        new = F.greatest(r["end"] - F.greatest(r["pos"], s["till"]), F.lit(0))
        return F.struct(F.greatest(s["till"], r["end"]).alias("till"), (s["total"] + new).alias("total"))

    return F.aggregate(F.sort_array(ranges), start, add, lambda s: s["total"])


class Decontaminator:
    """Hits of one benchmark in one corpus."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_hashes: int = MAX_HASHES):
        self.docs = docs
        windows = stored(item_windows(benchmark, window), "benchmark-windows")
        scan = stored(scanned(docs, windows, max_hashes), "benchmark-hits")
        self.base = scan.where(F.col("block") == 0).select("key", "doc_id", "n_words")
        hits = scan.where(F.size("hits") > 0).select("key", F.explode("hits").alias("h")).select("key", "h.*").distinct()
        # The comparison of the words themselves: equal hashes are not enough.
        real = hits.join(windows, ["n", "hash", "window"])
        ranges = real.groupBy("key").agg(
            F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))).alias("ranges"),
            F.sort_array(F.collect_set("item_id")).alias("items"),
        )
        self.hits = stored(ranges, "benchmark-ranges")

    def report(self) -> DataFrame:
        """A row per document: key, doc_id, n_words, n_hit, items, ranges of words."""
        out = self.base.join(self.hits, "key", "left")
        no_range = F.array().cast("array<struct<pos:int,end:int>>")
        out = out.withColumn("ranges", F.coalesce("ranges", no_range)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        return out.withColumn("n_hit", covered(F.col("ranges")))

    def without_documents(self) -> DataFrame:
        """The documents that have no hit."""
        names = self.docs.columns
        keyed = self.docs.withColumn("__key", row_key("doc_id", "text"))
        bad = self.hits.select(F.col("key").alias("__key"))
        return keyed.join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in names])

    def without_spans(self) -> DataFrame:
        """The documents without the passages that were hit; the rest of a text stays."""
        names = self.docs.columns
        keyed = self.docs.withColumn("__key", row_key("doc_id", "text"))
        cuts = self.hits.select(F.col("key").alias("__key"), F.col("ranges").alias("__ranges"))
        joined = keyed.join(cuts, "__key", "left").drop("__key")
        hit = joined.where(F.col("__ranges").isNotNull())
        cut = map_batches(hit, _cut, hit.schema)
        both = joined.where(F.col("__ranges").isNull()).unionByName(cut)
        if "n_chars" in names:
            both = both.withColumn("n_chars", F.when(F.col("__ranges").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
        return both.select(*[F.col(f"`{c}`") for c in names])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ranges = textscan.utf8(batch.column("text")), batch.column("__ranges").to_pylist()
        out = []
        for text, pairs in zip(texts, ranges):
            words = textscan.Words([text], _TABLE)
            pieces, at = [], 0
            for r in sorted(pairs, key=lambda r: (r["pos"], r["end"])):
                begin, end = int(words.start[r["pos"]]) - 1, int(words.end[r["end"] - 1]) - 1
                if begin > at:
                    pieces.append(text[at:begin])
                at = max(at, end)
            out.append(b"".join([*pieces, text[at:]]).decode("utf-8"))
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Words, hit words and items of every document."""
    found = Decontaminator(docs, benchmark, **options).report()
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
