"""Task ids, verdicts, message payloads and notification texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions.paths import without_scheme
from batchloom.functions.text import fill


def task_index_text(task_id: Column) -> Column:
    """Index text inside a task id; null where the id has another form."""
    return F.nullif(F.regexp_extract(task_id, K.TASK_INDEX_PATTERN, 1), F.lit(""))


def task_index(task_id: Column) -> Column:
    """Index inside a task id as a number; null where it is no 64-bit number."""
    return task_index_text(task_id).try_cast("bigint")


def is_success_line(payload: Column, patterns: list[str] | None = None) -> Column:
    """True where a log line matches any success pattern; one pass for all."""
    return payload.rlike("|".join(f"(?:{p})" for p in patterns or K.SUCCESS_PATTERNS))


def verdict(success: Column) -> Column:
    return F.when(success, K.VERIFIED_OK).otherwise(F.lit(K.VERIFIED_FAILED))


def payload_text(data: Column) -> Column:
    """Text of a base64 message body; null where it is no base64."""
    return F.try_to_binary(data, F.lit("base64")).cast("string")


def payload_field(text: Column, name: str) -> Column:
    """One ``name=value`` field of a decoded message; null where absent."""
    return F.nullif(F.regexp_extract(text, name + "=([^,]*)", 1), F.lit(""))


def payload_time(text: Column) -> Column:
    """Event time of a decoded message as UTC wall time, whatever the session zone."""
    stamp = payload_field(text, "timestamp")
    local = F.to_timestamp_ntz(F.substring(stamp, 1, 19), F.lit(K.LINK_TIME_FORMAT))
    sign = F.when(F.regexp_extract(stamp, "([+-])[0-9:]+$", 1) == "-", -1).otherwise(1)
    zone = r"[+-]([0-9]{2}):([0-9]{2})$"

    def part(group: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(stamp, zone, group), F.lit("")).cast("int"), F.lit(0)
        )

    offset = F.make_dt_interval(F.lit(0), sign * part(1), sign * part(2), F.lit(0))
    return local - offset


def path_time(ts: Column) -> Column:
    return F.date_format(ts, K.PATH_TIME_FORMAT)


def row_time(ts: Column) -> Column:
    return F.date_format(ts, K.ROW_TIME_FORMAT)


def link_time(ts: Column) -> Column:
    return F.date_format(ts, K.LINK_TIME_FORMAT)


def hours_before(ts: Column, hours: int) -> Column:
    return (ts - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))).cast(
        "timestamp_ntz"
    )


def short_id(key: Column) -> Column:
    """Ten hexadecimal characters, the same for the same key."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 10)


def job_link(job_name: Column, project: str, region: str) -> Column:
    return fill(K.JOB_LINK, job_name=job_name, project=project, region=region)


def log_link(job_uid: Column, clock: Column, project: str, task_id: Column | None = None) -> Column:
    """Link to the logs of the two hours before ``clock``."""
    task = F.lit("") if task_id is None else fill(K.LOG_LINK_TASK, task_id=task_id)
    return fill(
        K.LOG_LINK,
        project=project,
        job_uid=job_uid,
        task=task,
        start=link_time(hours_before(clock, 2)),
        end=link_time(clock),
    )


def output_link(output_path: Column, project: str) -> Column:
    """Link to the output folder; empty text where there is none."""
    link = fill(K.OUTPUT_LINK, path=without_scheme(output_path), project=project)
    return F.when(F.coalesce(output_path, F.lit("")) == "", "").otherwise(link)


def task_message(
    status: Column,
    sample_id: Column,
    job_name: Column,
    job_uid: Column,
    task_id: Column,
    output_path: Column,
    clock: Column,
    project: str,
    region: str,
) -> Column:
    return fill(
        K.TASK_MESSAGE,
        status=status,
        sample_id=F.coalesce(sample_id, F.lit("None")),
        job_link=job_link(job_name, project, region),
        log_link=log_link(job_uid, clock, project, task_id),
        output_link=output_link(output_path, project),
    )


def job_message(
    status: Column, job_name: Column, job_uid: Column, clock: Column, project: str, region: str
) -> Column:
    return fill(
        K.JOB_MESSAGE,
        status=status,
        job_link=job_link(job_name, project, region),
        log_link=log_link(job_uid, clock, project),
    )
