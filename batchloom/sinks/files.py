"""Control files: chunk manifests, batch configs, job lists and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunk_manifests(manifests: DataFrame, path: str) -> None:
    """One folder per job with one text file in it."""
    manifests.select("job_no", F.regexp_replace("text", "\n$", "").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("job_no").text(path)


def write_batch_configs(configs: DataFrame, path: str) -> None:
    """One folder per job with one JSON text in it."""
    configs.select("job_no", F.col("body").alias("value")).write.mode("overwrite").partitionBy(
        "job_no"
    ).text(path)


def write_job_list(job_list: DataFrame, path: str, parts: int | None = None) -> None:
    """Job list lines, sorted: part files in name order hold the lines in order."""
    by_range = job_list.repartitionByRange(parts, "pos") if parts else job_list.repartitionByRange("pos")
    (
        by_range
        .sortWithinPartitions("pos")
        .select(F.col("line").alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_texts(texts: DataFrame, path: str, bucket: str | None = None) -> None:
    """Texts as a table keyed by the uri that configs and lists name: (uri, text).

    Give ``manifests`` or ``configs`` of ``prepare_jobs`` with their bucket, or rows
    that have a uri. ``read_texts_table`` gives what ``split_lines``, ``parse_json``
    and ``gather_inputs`` read.
    """
    body = "text" if "text" in texts.columns else "body"
    uri = F.col("uri") if bucket is None else F.concat(F.lit(f"gs://{bucket}/"), F.col("path"))
    texts.select(uri.alias("uri"), F.col(body).alias("text")).write.mode("overwrite").parquet(path)


def read_texts_table(spark: SparkSession, path: str) -> DataFrame:
    """Texts of ``write_texts``: (uri, text)."""
    return spark.read.schema("uri string, text string").parquet(path)


def append_triggers(triggers: DataFrame, path: str) -> None:
    """Append trigger rows (target_uri, body)."""
    triggers.select("target_uri", "body").write.mode("append").parquet(path)
