"""Importance resampling of documents towards a target distribution.

Features are all runs of ``low`` to ``high`` consecutive words, joined by one space,
in hashed buckets. A bucket's gain is the rounded logarithm of how much more often it
occurs in the target texts than in the documents; a document's weight is the sum
of the gains of its features. Gumbel noise, taken from a hash of the seed and the id, is
added, and the documents with the highest sums are drawn: a sample without
replacement in proportion to the weights' exponentials.

A task works on columns: Arrow lower-cases the texts, splits them at a pattern,
flattens the words and numbers them by a dictionary. Shifted word numbers side by side
form n-grams; a CRC is taken once per distinct n-gram; gains are taken by
number and summed by document. The first pass adds up feature counts per bucket, a
vector of ``buckets`` numbers per task; the second sums gains, of which ``buckets``
numbers are broadcast. Ranks come from ranges of the order, whose sizes are added up.

Defined cases: null and empty texts, and those without a word, have no features and
weight 0; texts with fewer than n words have no n-gram. A null id is hashed as an
empty one. Equal rows have equal weights and scores; rows with one id get ranks that
follow each other. Ties go to the smaller id, nulls first. Without a drawn row all ranks are null. Empty tables
give no rows, an empty target gives gains below zero everywhere. Texts of any
length are taken whole. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm import textscan
from batchloom.llm.common import map_batches, stored
from batchloom.operators.ordering import row_index_by

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PIECE = 8 << 20  # bytes of text that are worked on at once
# What separates words: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Features:
    """The features of a column of texts: a bucket each, and the text it belongs to."""

    def __init__(self, texts: pa.Array, low: int, high: int, buckets: int):
        # Lower-cased before the cast: a slice without nulls that was cast first comes out with wrong bytes (Arrow 23).
        lowered = pc.fill_null(pc.ascii_lower(texts), "").cast(pa.large_string())
        split = pc.split_pattern_regex(lowered, pattern=GAP)
        owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        encoded = pc.list_flatten(split).dictionary_encode()
        numbers = encoded.indices.to_numpy(zero_copy_only=False)
        words = encoded.dictionary.cast(pa.large_binary()).to_pylist()
        if b"" in words:  # a gap at either end of a text leaves an empty word
            kept = numbers != words.index(b"")
            owner, numbers = owner[kept], numbers[kept]
        self.n_texts = len(texts)
        self.n_words = np.bincount(owner, minlength=self.n_texts)
        found = [self._of_size(size, owner, numbers.astype(np.int64), words, buckets) for size in range(low, high + 1)]
        self.bucket = np.concatenate([bucket for bucket, _ in found])
        self.owner = np.concatenate([owners for _, owners in found])

    @staticmethod
    def _of_size(size: int, owner: np.ndarray, numbers: np.ndarray, words: list[bytes], buckets: int):
        """Buckets and owners of all n-grams of one size; a CRC per distinct n-gram."""
        n = max(len(numbers) - size + 1, 0)
        grams, parts = numbers[:n], [(i,) for i in range(len(words))]
        for k in range(1, size):  # the gram so far and the next word make a number of their own
            pairs = grams * len(words) + numbers[k : k + n]
            distinct, grams = np.unique(pairs, return_inverse=True)
            parts = [(*parts[p // len(words)], int(p % len(words))) for p in distinct.tolist()]
        crc = np.fromiter((zlib.crc32(b" ".join([words[i] for i in p])) % buckets for p in parts), np.int64, len(parts))
        inside = owner[:n] == owner[size - 1 :][:n]
        return crc[grams[inside]], owner[:n][inside]

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's features."""
        order = np.argsort(self.owner, kind="stable")
        owner, taken = self.owner[order], gains[self.bucket[order]]
        out = np.zeros(self.n_texts, dtype=np.int64)
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[first]] = np.add.reduceat(taken, first)
        return out


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Features of all texts per bucket: bucket, n. Buckets without a feature are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in textscan.slices(batch, PIECE):
                total += np.bincount(Features(part.column("text"), low, high, buckets).bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return map_batches(texts.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, in thousandths of a natural logarithm.

    The driver reads as many rows as there are buckets with a feature.
    """
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, low, high, buckets).collect():
            counts[row.bucket] = row.n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]


def weighed(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """A row per document: doc_id, n_words, n_features, weight, score."""
    gains = np.array(bucket_gains(docs, target, low, high, buckets), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, PIECE):
                found = Features(part.column("text"), low, high, buckets)
                n_features = np.bincount(found.owner, minlength=found.n_texts)
                numbers = [pa.array(x, pa.int64()) for x in (found.n_words, n_features, found.sums(shared.value))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint"
    weights = map_batches(docs.select("doc_id", "text"), run, schema)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(F.ln(-F.ln(uniform)) * -1000)
    return weights.withColumn("score", F.col("weight") + noise)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    low: int = 1,
    high: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """A row per document, and the rank of those drawn: ``percent`` % of those with ``least_words`` words."""
    short = (F.col("n_words") < least_words).cast("int")
    rows = weighed(docs, target, low, high, buckets, seed).withColumns({"__short": short, "__down": -F.col("score")})
    rows = stored(rows, "weighed")
    n_drawn = rows.where(F.col("__short") == 0).count() * percent // 100
    placed = row_index_by(rows, ["__short", "__down", "doc_id"], name="__place")
    rank = F.when((F.col("__short") == 0) & (F.col("__place") < n_drawn), F.col("__place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns. Rows that share an id are drawn together."""
    drawn = resampled(docs, target, **options).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    ids = drawn.withColumnRenamed("doc_id", "__drawn")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__drawn"]), "left_semi")
