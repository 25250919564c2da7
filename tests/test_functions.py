"""Column functions on edge values, checked against plain Python."""

import base64
import os.path
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom.functions import commands, paths, status, text
from batchloom.plans.task_array import entry_value


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.orderBy("i").select(column(F.col("v")).alias("o")).collect()]


WORDS = [
    "a b", "  a\t b  ", "", "   ", " x y　", "\x1cq\x1f", "a\x85b", "one",
    "tab\tsep\tthree", "​z", "\x0bv\x0c",
]


def test_strip_and_tokens_match_python(spark):
    assert values(spark, text.strip, WORDS) == [w.strip() for w in WORDS]
    assert values(spark, text.tokens, WORDS) == [w.split() or [""] for w in WORDS]


PATHS = [
    "a/b/c.cram", "c.cram", "x.fastq.gz", "a/", "", "/c", "a//b", "a//", ".bashrc", "d/.x.y", "..a",
    "a.", "d.e/f", "//r", "a/b.c/d",
]


def test_path_parts_match_python(spark):
    assert values(spark, paths.basename, PATHS) == [os.path.basename(p) for p in PATHS]
    assert values(spark, paths.dirname, PATHS) == [os.path.dirname(p) for p in PATHS]
    assert values(spark, paths.stem, PATHS) == [
        os.path.splitext(os.path.basename(p))[0] for p in PATHS
    ]


def test_uri_split(spark):
    uris = ["gs://b/k/x", "gs://b/", "gs://b", "s3://q/a", "http://z", "", "xgs://b/k", "gs://"]
    assert values(spark, paths.bucket, uris) == ["b", "b", "b", "q", "", "", "", ""]
    assert values(spark, paths.prefix, uris) == ["k/x", "", "", "a", "", "", "", ""]
    assert values(spark, paths.to_s3, ["gs://a/gs://b"]) == ["s3://a/s3://b"]
    assert values(spark, paths.without_scheme, ["s3://a/gs://b", "c"]) == ["a/b", "c"]


def test_segments_and_ancestors(spark):
    name = "projects/1/locations/l/jobs/j/taskGroups/group0/tasks/5"
    assert values(spark, lambda v: paths.segment(v, 5), [name, "a/b"]) == ["j", None]
    assert values(spark, lambda v: paths.segment(v, -1), [name, "a"]) == ["5", "a"]
    assert values(spark, paths.ancestors, ["d/e/f", "f", "d//f"]) == [
        ["", "d", "d/e"], [""], ["", "d", "d/"]
    ]
    assert values(spark, paths.parent_path, ["a/b/c.json", "a/c.json", "c.json"]) == [
        "a/c.json", "c.json", None
    ]
    assert values(spark, lambda v: paths.has_extension(v, [".ora", ".GZ"]), ["A.gz", "b.cram", "gz"]) == [
        True, False, False
    ]


def test_task_index(spark):
    ids = ["j-group0-7", "j-group0-07", "j-x7", "j-group0-", "group0-1-group0-2", None]
    assert values(spark, status.task_index_text, ids) == ["7", "07", None, None, "1", None]
    assert values(spark, status.task_index, ids + ["group0-99999999999999999999"]) == [
        7, 7, None, None, 1, None, None
    ]


def python_option(command, name):
    if name in command:
        return command.split(name)[1].strip().split(" ")[0]
    return None


COMMANDS = [
    "x --cram-input s3://a --output-directory s3://o/1 -t",
    "x --fastq-list l.csv --fastq-list-sample-id S",
    "x --qc-coverage-region-1 r.bed -1 a.gz -2 b.gz",
    "-1 a -2 b",
    "x --output-directory",
    "x --output-directory \t\n v\tw z",
    "--output-directory a --output-directory b",
    "--output-directory--output-directory b",
    "x",
    "",
]


@pytest.mark.parametrize("name", ["--output-directory", "--fastq-list", "-1", "--cram-input"])
def test_option_value_matches_python(spark, name):
    got = values(spark, lambda v: commands.option_value(v, name), COMMANDS)
    assert got == [python_option(c, name) for c in COMMANDS]


def test_option_traps_and_word_mode(spark):
    trap = COMMANDS[2]
    both = [
        values(spark, lambda v: commands.option_value(v, "-1", exact), [trap])[0]
        for exact in (False, True)
    ]
    assert both == ["r.bed", "a.gz"]
    assert values(spark, lambda v: commands.command_input(v, True), [trap]) == ["a.gz,b.gz"]
    kinds = values(spark, commands.command_input_type, COMMANDS)
    assert kinds == ["cram", "fastq-list", "fastq", "fastq"] + [None] * 6
    assert values(spark, lambda v: commands.option_value(v, "--output-directory", True), COMMANDS[4:5]) == [""]


def python_substitute(command, index, variables):
    command = command.replace("${BATCH_TASK_INDEX}", str(index)).replace("$BATCH_TASK_INDEX", str(index))
    for k, v in variables:
        command = command.replace("${" + k + "}", v).replace(k, v)
    return command


def test_variables_are_substituted_in_order(spark):
    template = "${SAMPLE_ID} SAMPLE_ID ${INPUT_PATH} $INPUT_PATH $BATCH_TASK_INDEX ${OTHER}"
    variables = [("SAMPLE_ID", "x INPUT_PATH"), ("INPUT_PATH", "in OUTPUT_PATH"), ("OUTPUT_PATH", "o")]
    want = python_substitute(template, 3, variables)
    columns = [(k, F.lit(v)) for k, v in variables]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in columns])
    got = spark.range(1).select(
        commands.substitute_variables(F.lit(template), F.lit(3), columns).alias("a"),
        commands.substitute_entries(F.lit(template), F.lit(3), entries).alias("b"),
        commands.substitute_variables(
            F.lit(template), F.lit(3), [("SAMPLE_ID", F.lit(None).cast("string"))]
        ).alias("c"),
    ).first()
    assert got.a == got.b == want
    assert got.c == python_substitute(template, 3, [])


def test_options_keep_their_order(spark):
    body = '{"--z": "1", "--a": "", "--m": "<date>", "--z2": "${SAMPLE_ID}"}'
    got = values(
        spark,
        lambda v: commands.options_text(
            text.replace_in_entries(text.ordered_entries(v), [("<date>", "D")])
        ),
        [body],
    )
    assert got == [" --z 1 --a  --m D --z2 ${SAMPLE_ID}"]
    assert values(spark, lambda v: entry_value(text.ordered_entries(v), "--m"), [body]) == ["<date>"]
    assert values(spark, lambda v: entry_value(text.ordered_entries(v), "--none"), [body]) == [None]


def test_command_head(spark):
    line = spark.range(1).select(
        commands.command_line(*[F.lit(x) for x in ("H", "M", "A", "S", " IN", " -o 1")]).alias("c")
    ).first().c
    assert line == f"--api-host H --machine M {K.APP_FLAG} A --google-sa S --   IN  -o 1 "


def test_config_markers(spark):
    got = values(spark, lambda v: text.fill_tokens(v, {"A": "1", "B_C": "2"}), ["__A__/__B_C__/__A__ __D__"])
    assert got == ["1/2/1 __D__"]


def test_message_payload(spark):
    body = (
        "Task state was updated: taskUID=j-group0-4, previousState=PENDING, currentState=SUCCEEDED,"
        " timestamp=2023-08-17T19:32:46-07:00"
    )
    data = base64.b64encode(body.encode()).decode()
    assert values(spark, status.payload_text, [data, "%%%", None]) == [body, None, None]
    times = [body, body.replace("-07:00", "+05:30"), body.replace("-07:00", "Z"), "no time"]
    assert values(spark, status.payload_time, times) == [
        datetime(2023, 8, 18, 2, 32, 46), datetime(2023, 8, 17, 14, 2, 46),
        datetime(2023, 8, 17, 19, 32, 46), None,
    ]
    assert values(spark, lambda v: status.payload_field(v, "previousState"), [body, "x"]) == ["PENDING", None]


def test_payload_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = values(spark, status.payload_time, ["timestamp=2023-03-12T02:30:00-07:00"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2023, 3, 12, 9, 30)]


def test_success_lines(spark):
    lines = ["x " + p.replace("\\", "") + " y" for p in K.SUCCESS_PATTERNS] + ["finished", ""]
    assert values(spark, status.is_success_line, lines) == [True, True, False, False]


def test_messages(spark):
    clock = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        status.task_message(
            F.lit("FAILED"), F.lit(None).cast("string"), F.lit("job1"), F.lit("uid1"),
            F.lit("uid1-group0-0"), F.lit(None).cast("string"), clock, "p", "r",
        ).alias("failed"),
        status.output_link(F.lit("s3://o/x"), "p").alias("link"),
        status.job_message(F.lit("SUCCEEDED"), F.lit("job1"), F.lit("uid1"), clock, "p", "r").alias("job"),
    ).first()
    assert row.failed.startswith("_Task_ execution *FAILED* for sample_id=None within <https://")
    assert row.failed.endswith("|logs> for more info.")
    assert "%222023-12-31T23:00:00%22" in row.failed and "%222024-01-01T01:00:00%22" in row.failed
    assert row.link.startswith(" See the <") and "/browser/o/x?project=p|" in row.link
    assert row.job.startswith("_Job_ execution *SUCCEEDED* for <") and "task_id" not in row.job


def test_short_id_is_stable(spark):
    ids = values(spark, status.short_id, ["a", "a", "b"])
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 10
