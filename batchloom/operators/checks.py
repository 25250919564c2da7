"""Row checks: each splits its input in good rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.text import once


def split_on(df: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with a ``reason`` column. A null check is a reject."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed).withColumn("reason", F.lit(reason))


def with_attributes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that carry attributes, and the rest."""
    return split_on(messages, F.col("attributes").isNotNull(), "missing attributes")


def two_fields(rows: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with at least (or exactly) two tokens, and the rest."""
    kept = [c for c in rows.columns if c != "tokens"]
    split = rows.select(*kept, once(F.col("tokens"), "tokens"))
    size = F.size("tokens")
    return split_on(split, (size == 2) if exact else (size >= 2), "expected two fields")


def normal_input_type(c: Column) -> Column:
    """Lower-cased input type where it is supported, else null."""
    lowered = F.lower(c)
    return F.when(lowered.isin(list(K.EXTENSIONS)), lowered)


def input_extensions(c: Column) -> Column:
    """File endings that an input type accepts; null for other types."""
    kind = normal_input_type(c)
    out = F.when(F.lit(False), F.array(F.lit("")))
    for name, endings in K.EXTENSIONS.items():
        out = out.when(kind == name, F.array(*[F.lit(e) for e in endings]))
    return out


def supported_inputs(configs: DataFrame, column: str = "input_type") -> tuple[DataFrame, DataFrame]:
    """Configurations of a supported type (lower-cased once), and the rest."""
    good, bad = split_on(
        configs, normal_input_type(F.col(column)).isNotNull(), "unsupported input type"
    )
    return good.withColumn(column, F.lower(column)), bad


def variable_counts(tasks: DataFrame) -> DataFrame:
    """Per job: tasks, values per variable, and whether all counts are equal."""
    counted = tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count("sample_id").alias("sample_count"),
        F.count("input_path").alias("input_count"),
        F.count("output_path").alias("output_count"),
    )
    return counted.withColumn(
        "consistent",
        (F.col("task_count") == F.col("sample_count"))
        & (F.col("task_count") == F.col("input_count"))
        & (F.col("task_count") == F.col("output_count")),
    )


def optional_equal(column: str, wanted: str) -> Column:
    """``column = wanted``, or true for an empty wanted text."""
    return F.lit(True) if wanted == "" else F.col(column) == F.lit(wanted)


def created_between(column: str, after: str, before: str) -> Column:
    """Inclusive range on a creation time."""
    return F.col(column).between(
        F.lit(after).cast("timestamp_ntz"), F.lit(before).cast("timestamp_ntz")
    )


def route(state: Column) -> Column:
    """What happens after a task event was stored."""
    return (
        F.when(state == K.SUCCEEDED, "verify").when(state == K.FAILED, "notify").otherwise("store")
    )


def job_ended(state: Column) -> Column:
    return state.isin(K.JOB_END_STATES)
