"""Split big manifests into ordered jobs of a fixed number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.paths import stem
from batchloom.operators.joins import unpaired
from batchloom.operators.ordering import BUCKET_BITS, chunks, sum_before
from batchloom.session import materialized
from batchloom.sources.manifests import manifest_text


def pair_inputs(lists: DataFrame, configs: DataFrame) -> DataFrame:
    """The i-th sample list with the i-th config: (pos, uri, config_uri).

    Both lists must be equally long; the first place that only one of them has is told.
    """
    alone = unpaired(lists, configs).limit(1).collect()
    if alone:
        raise ValueError(f"sample lists and configs differ in length: place {alone[0].pos} has no partner")
    return lists.join(configs, "pos", "inner")


def chunk_rows(inputs: DataFrame, rows: DataFrame, batch_size: int) -> DataFrame:
    """Every manifest row with its job number, chunk and chunk offset.

    ``inputs`` has pos, uri, config_uri; ``rows`` has uri, line_no, tokens. Job
    numbers run on over the inputs: the jobs of all earlier inputs come first.

    Rows are counted once per bucket of 65,536 lines. From these counts follow the
    sizes of the manifests, the first job of each and the rows before each bucket: one
    small table, written once, that the rows are joined with.
    """
    bucketed = rows.withColumn("__block", F.shiftright(F.col("line_no").cast("bigint"), BUCKET_BITS))
    sizes = materialized(bucketed.groupBy("uri", "__block").agg(F.count(F.lit(1)).alias("__size")), "bucket-sizes")
    places = materialized(_bucket_places(inputs, sizes, batch_size), "bucket-places")
    inside = Window.partitionBy("uri", "__block").orderBy("line_no")
    numbered = bucketed.withColumn("__in_bucket", F.row_number().over(inside) - 1)
    placed = numbered.join(places, ["uri", "__block"]).withColumn("row_index", F.col("__before") + F.col("__in_bucket"))
    return (
        chunks(placed, batch_size)
        .withColumn("job_no", F.col("first_job") + F.col("chunk"))
        .select(
            "input_pos",
            "uri",
            "config_uri",
            "job_no",
            "chunk",
            "chunk_offset",
            "row_index",
            F.array_join("tokens", " ").alias("line"),
        )
    )


def _bucket_places(inputs: DataFrame, sizes: DataFrame, batch_size: int) -> DataFrame:
    """Per input and bucket of its manifest: the rows before it, and the input's first job."""
    before = sum_before(sizes, F.col("__size"), "__block", ["uri"], "__before")
    totals = sizes.groupBy("uri").agg(F.sum("__size").alias("__rows"))
    jobs = F.expr(f"(__rows + {int(batch_size) - 1}) div {int(batch_size)}")
    counted = inputs.join(totals, "uri", "inner").withColumn("__jobs", jobs)
    starts = sum_before(counted, F.col("__jobs"), "pos", name="first_job").select(
        F.col("pos").alias("input_pos"), "uri", "config_uri", "first_job"
    )
    return before.join(starts, "uri").select("uri", "__block", "__before", "input_pos", "config_uri", "first_job")


def _folder(prefix: str) -> str:
    return prefix + "/" if prefix else ""


def list_path(prefix: str):
    """Object name of a chunk's manifest."""
    return F.concat(
        F.lit(_folder(prefix) + "input_list/"),
        stem(F.col("uri")),
        F.lit("_"),
        F.col("job_no").cast("string"),
        F.lit("_"),
        F.col("chunk_offset").cast("string"),
        F.lit(".txt"),
    )


def config_path(prefix: str):
    """Object name of a job's batch config."""
    return F.concat(
        F.lit(_folder(prefix) + "jobs/batch_config"), F.col("job_no").cast("string"), F.lit(".json")
    )


def chunk_manifests(rows: DataFrame, prefix: str) -> DataFrame:
    """One manifest text per job; a group never exceeds the batch size."""
    body = F.expr("listagg(line || '\n', '') within group (order by row_index)")
    grouped = rows.groupBy("job_no", "uri", "chunk_offset").agg(body.alias("body"))
    return grouped.select(
        "job_no", list_path(prefix).alias("path"), manifest_text(F.col("body")).alias("text")
    )


def job_keys(rows: DataFrame) -> DataFrame:
    """One row per job of the chunked rows."""
    return rows.select("job_no", "uri", "config_uri", "chunk_offset").distinct()


def batch_configs(
    jobs: DataFrame, bucket: str, prefix: str, parallelism: str, input_type: str = K.CRAM
) -> DataFrame:
    """One batch config JSON per job."""
    options = [F.lit(str(parallelism)).alias("parallelism")]
    options += [F.lit(v).alias(k) for k, v in K.CHUNK_RUN_OPTIONS.items()]
    inputs = F.struct(
        F.lit(input_type).alias("input_type"),
        F.concat(F.lit(f"gs://{bucket}/"), list_path(prefix)).alias("input_list"),
        F.col("config_uri").alias("config"),
    )
    body = F.to_json(
        F.struct(F.struct(*options).alias("run_options"), inputs.alias("input_options"))
    )
    return jobs.select("job_no", config_path(prefix).alias("path"), body.alias("body"))


def job_list(jobs: DataFrame, bucket: str, prefix: str) -> DataFrame:
    """The ordered job list: (pos, label, config_uri, line)."""
    label = F.concat(F.lit("job"), F.col("job_no").cast("string"))
    uri = F.concat(F.lit(f"gs://{bucket}/"), config_path(prefix))
    return jobs.select(
        F.col("job_no").alias("pos"),
        label.alias("label"),
        uri.alias("config_uri"),
        F.concat(label, F.lit(", "), uri).alias("line"),
    )


def prepare_jobs(
    inputs: DataFrame,
    rows: DataFrame,
    batch_size: int,
    bucket: str,
    prefix: str,
    parallelism: str,
    input_type: str = K.CRAM,
) -> dict[str, DataFrame]:
    """Manifests, batch configs and the ordered job list of all inputs.

    The manifests are read twice, to count and to number their rows; the chunked rows are
    written once, and the three results come from them.
    """
    placed = materialized(chunk_rows(inputs, rows, batch_size), "chunked-rows")
    jobs = job_keys(placed)
    return {
        "manifests": chunk_manifests(placed, prefix),
        "configs": batch_configs(jobs, bucket, prefix, parallelism, input_type),
        "job_list": job_list(jobs, bucket, prefix),
    }
