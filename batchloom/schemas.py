"""Explicit schemas of every table and file the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

from batchloom import constants as K

_S = T.StringType()
_TS = T.TimestampNTZType()


def _f(name: str, kind: T.DataType = _S, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


TASKS_STATUS = T.StructType(
    [
        _f("job_id", nullable=False),
        _f("task_id", nullable=False),
        _f("status", nullable=False),
        _f("timestamp", _TS, nullable=False),
    ]
)

JOB_ARRAY = T.StructType(
    [
        _f("job_id", nullable=False),
        _f("job_name", nullable=False),
        _f("job_label"),
        _f("batch_task_index", T.LongType(), nullable=False),
        _f("variables"),
        _f("sample_id"),
        _f("input_path"),
        _f("input_type"),
        _f("output_path"),
        _f("command"),
        _f("timestamp", _TS, nullable=False),
    ]
)

# One wide row per status change: status, sample and command together.
TASK_ROW = T.StructType(
    [
        _f("job_id", nullable=False),
        _f("job_label"),
        _f("task_id", nullable=False),
        _f("sample_id"),
        _f("status", nullable=False),
        _f("event_timestamp", _TS),
        _f("input_type"),
        _f("input_path"),
        _f("output_path"),
        _f("command"),
        _f("timestamp", _TS),
    ]
)

MESSAGE = T.StructType(
    [_f("attributes", T.MapType(_S, _S)), _f("data")]
)

OBJECT_EVENT = T.StructType([_f("bucket"), _f("name")])

TASK_LOG = T.StructType([_f("job_uid"), _f("task_id"), _f("text_payload")])

# A log line as it comes in, with its time.
TIMED_LOG = T.StructType([*TASK_LOG.fields, _f("timestamp", _TS)])

JOB_DIRECTORY = T.StructType(
    [_f("job_name"), _f("job_uid"), _f("labels", T.MapType(_S, _S))]
)

READ_GROUPS = T.StructType(
    [
        _f(c)
        for c in (
            "RGID RGSM RGPU RGPL RGLB RGCN RGPM Lane Read1File Read2File".split()
        )
    ]
)

# Numbers are read as text and cast afterwards: writers store them either way.
RUN_OPTIONS = T.StructType(
    [
        _f(c)
        for c in (
            "parallelism",
            "max_run_duration",
            "memory_mib",
            "cpu_milli",
            "machine",
            "max_retry_count",
        )
    ]
)
INPUT_OPTIONS = T.StructType(
    [_f(c) for c in ("input_type", "input_list", "input_path", "config")]
)
BATCH_CONFIG = T.StructType(
    [_f("run_options", RUN_OPTIONS), _f("input_options", INPUT_OPTIONS)]
)
LAUNCHER_OPTIONS = T.StructType(
    [
        _f(c)
        for c in (
            K.LAUNCHER_APP_KEY,
            "entrypoint",
            "stub",
            K.LAUNCHER_MACHINE_KEY,
            "api_host",
            "image_uri",
        )
    ]
)
RUN_CONFIG = T.StructType(
    [_f(K.OPTIONS_KEY, T.MapType(_S, _S)), _f(K.LAUNCHER_KEY, LAUNCHER_OPTIONS)]
)

TRIGGER_ROW = T.StructType([_f("target_uri"), _f("body")])
