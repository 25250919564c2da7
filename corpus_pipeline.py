"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
``run`` writes what a stage returns as Parquet in the shared folder and gives the
written table to the next one; what a stage wrote for itself goes when it is done, and its
result when the next one is. A stage begins by letting go of what the driver still
holds of those before, so its memory doesn't grow with their number. The last of ``STAGES`` is a plan: it keeps every
document, those with ``taken`` = 0 included, and whoever reads the rows repeats,
cuts or leaves out documents by ``taken``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from batchloom.llm import decontaminate, language_id, mixing, ngram_join, pii
from batchloom.session import release, remove, run_folder, scratch

# Language ID and the near-copy classes are not expressible in SQL.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def begun_afresh(stage: Stage) -> Stage:
    """The stage, begun when the driver has let go of all that nothing uses any more."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return begin


@begun_afresh
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    return language_id.recognised(docs)


@begun_afresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles."""
    return ngram_join.deduplicated(docs, n=5, percent=80)


@begun_afresh
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.Decontaminator(docs, items).without_documents()


@begun_afresh
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, replaced."""
    return pii.sanitised(docs, **pii.WHOLE)


@begun_afresh
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of words that the mix takes of each."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = run_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
