"""Manifests, listings, ordering and configuration files."""

import random

import pytest
from pyspark.sql import functions as F

from batchloom import constants as K
from batchloom import schemas
from batchloom.operators import checks, joins, ordering
from batchloom.sinks import files
from batchloom.sources import configs, job_lists, listings, manifests


def python_rows(content):
    out = []
    for number, line in enumerate(content.replace("\r", "").replace("\t", " ").split("\n"), 1):
        if number > 1 and line.strip():
            out.append((number, line.split()))
    return out


CONTENTS = {
    "plain.txt": "id\tpath\nA gs://b/A.cram\nB\tgs://b/B.cram extra\n",
    "odd.txt": "\nA p\r\n\r\n   \n one \n B q \nlast r",
    "empty.txt": "",
    "header.txt": "id path",
}


@pytest.fixture
def folder(tmp_path):
    for name, content in CONTENTS.items():
        (tmp_path / name).write_bytes(content.encode())
    return str(tmp_path)


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r.uri.rsplit("/", 1)[-1], []).append((r.line_no, list(r.tokens)))
    return {k: sorted(v) for k, v in out.items()}


def test_manifest_rows_match_python(spark, folder):
    want = {k: python_rows(v) for k, v in CONTENTS.items() if python_rows(v)}
    assert by_file(manifests.read_manifests(spark, folder).collect()) == want
    whole = manifests.manifest_rows(manifests.split_lines(configs.read_texts(spark, folder)))
    assert by_file(whole.collect()) == want


def test_line_numbers_over_split_files(spark, tmp_path):
    """Files cut in many splits still give every line its number."""
    rng = random.Random(5)
    want = {}
    for f in range(3):
        lines = [f"f{f} line{i} " + "x" * rng.randrange(60) for i in range(3000 + 500 * f)]
        (tmp_path / f"m{f}.txt").write_text("\n".join(lines))
        want[f"m{f}.txt"] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = manifests.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in lines:
        got.setdefault(r.uri.rsplit("/", 1)[-1], []).append((r.line_no, r.line))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == want
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_short_and_long_rows(spark):
    rows = spark.createDataFrame(
        [("u", 2, ["a"]), ("u", 3, ["a", "b"]), ("u", 4, ["a", "b", "c"])],
        "uri string, line_no long, tokens array<string>",
    )
    good, bad = checks.two_fields(rows)
    assert (good.count(), bad.count()) == (2, 1)
    exact, rest = checks.two_fields(rows, exact=True)
    assert (exact.count(), rest.count()) == (1, 2)
    assert [r.path for r in manifests.samples_of(rows).collect()] == ["b", "b"]


def test_generated_samples(spark):
    rows = manifests.generate_range(spark, 3, 5, "bk").collect()
    assert [r.line for r in rows] == ["NA3 gs://bk/NA3/NA3.cram", "NA4 gs://bk/NA4/NA4.cram"]


@pytest.mark.parametrize("bits", [2, 16])
def test_row_index_with_a_hot_group(spark, bits, monkeypatch):
    """One group holds most rows and spans many buckets; one group is null."""
    monkeypatch.setattr(ordering, "BUCKET_BITS", bits)
    rng = random.Random(1)
    data = [("hot", p) for p in rng.sample(range(5000), 600)]
    data += [(rng.choice("abc"), p) for p in rng.sample(range(5000), 200)]
    data += [(None, p) for p in rng.sample(range(5000), 90)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, p long")
    got = sorted((r.g or "", r.p, r.row_index) for r in ordering.row_index(df, "p", ["g"]).collect())
    want, seen = [], {}
    for g, p in sorted((g or "", p) for g, p in data):
        want.append((g, p, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_sum_before_without_groups(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_BITS", 1)
    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "p long, v long")
    got = [r.s for r in ordering.sum_before(df, F.col("v"), "p", name="s").orderBy("p").collect()]
    assert got == [sum(j % 4 for j in range(i)) for i in range(40)]


def test_row_index_by_name(spark):
    names = [f"n{i % 97}/{i}" for i in range(2000)]
    df = spark.createDataFrame([("h" if i % 3 else "s", n) for i, n in enumerate(names)], "g string, n string")
    got = {(r.g, r.n): r.row_index for r in ordering.row_index_by(df, ["n"], ["g"]).collect()}
    for group in "hs":
        mine = sorted(n for i, n in enumerate(names) if ("h" if i % 3 else "s") == group)
        assert [got[group, n] for n in mine] == list(range(len(mine)))


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_successors_over_buckets(spark, bits, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    places = sorted(rng.sample(range(200), 60))
    labels = [f"l{rng.randrange(25)}" for _ in places]
    df = spark.createDataFrame(
        [(p, x, f"c{p}") for p, x in zip(places, labels)], "pos long, label string, config_uri string"
    )
    got = {r.label: (r.next_label, r.next_config_uri) for r in ordering.successors(df).collect()}
    want = {}
    for i, x in enumerate(labels):
        after = (labels[i + 1], f"c{places[i + 1]}") if i + 1 < len(labels) else (None, None)
        want.setdefault(x, after)
    assert got == want


def test_successors(spark):
    labels = ["job1", "job2", "job1", "", "job3"]
    df = spark.createDataFrame(
        [(10 * i, x, f"gs://c/{i}.json") for i, x in enumerate(labels)],
        "pos long, label string, config_uri string",
    )
    got = {r.label: (r.next_label, r.next_config_uri) for r in ordering.successors(df).collect()}
    assert got == {
        "job1": ("job2", "gs://c/1.json"),
        "job2": ("job1", "gs://c/2.json"),
        "": ("job3", "gs://c/4.json"),
        "job3": (None, None),
    }
    assert ordering.first_entry(df).first().label == "job1"


def test_job_list_lines(spark):
    import csv
    import io

    lines = [
        "job1, gs://c/1.json", "", "short", "job1,", ",x", '"a ""q"", b" t , "u" ,z', " job3 , v , w",
        'a"b,c"d', '""', '"",""',
    ]
    df = spark.createDataFrame([("u", i, x) for i, x in enumerate(lines)], "uri string, line_no long, line string")
    good, bad = job_lists.job_list_rows(df)
    want = {}
    for i, x in enumerate(lines):
        row = next(csv.reader(io.StringIO(x)), [])
        if len(row) >= 2:
            want[i] = (row[0].strip(), row[1].strip())
    assert {r.pos: (r.label, r.config_uri) for r in good.collect()} == want
    assert sorted(r.line_no for r in bad.collect()) == [i for i in range(len(lines)) if i not in want]


def test_read_job_list(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text("job1, gs://b/d/c1.json\nbad\njob2, gs://b/d/c2.json\n")
    good, bad = job_lists.read_job_list(spark, str(tmp_path / "jobs.csv"))
    assert [(r.pos, r.label) for r in good.orderBy("pos").collect()] == [(1, "job1"), (3, "job2")]
    assert [(r.line_no, r.line) for r in bad.collect()] == [(2, "bad")]


def test_written_lists_of_many_parts(spark, tmp_path):
    lists = spark.range(120).selectExpr(
        "cast(id % 3 as string) as name", "id as pos", "concat('j', id) as label", "concat('gs://c/', id) as config_uri"
    )
    for name in "012":
        rows = lists.where(f"name = '{name}'").selectExpr("*", "concat(label, ',', config_uri) as line")
        files.write_job_list(rows, str(tmp_path / name), parts=4)
        assert len(list((tmp_path / name).glob("part-*"))) == 4
    good, bad = job_lists.read_job_list(spark, str(tmp_path / "*"))
    assert bad.count() == 0 and good.select("uri").distinct().count() == 3
    steps = ordering.successors(good).collect()
    got = {r.label: (r.next_label, r.next_config_uri) for r in steps}
    assert got == {
        f"j{i}": (f"j{i + 3}", f"gs://c/{i + 3}") if i + 3 < 120 else (None, None) for i in range(120)
    }
    assert sorted(r.label for r in ordering.first_entry(good).collect()) == ["j0", "j1", "j2"]


def test_listed_inputs(spark):
    listing = spark.createDataFrame(
        [("b", n) for n in ["d/2.cram", "d/1.CRAM", "d/e/3.cram", "dx/4.cram", "d/5.txt", "6.cram", "d.cram"]]
        + [("c", "d/9.cram")],
        "bucket string, name string",
    )
    requests = spark.createDataFrame(
        [("j1", "gs://b/d", "cram"), ("j2", "gs://b", "CRAM"), ("j3", "gs://b/d", "fastq"), ("j4", None, "cram")],
        "job_id string, input_path string, input_type string",
    )
    got = {}
    for r in listings.inputs_below(requests, listing).orderBy("job_id", "pos").collect():
        got.setdefault(r.job_id, []).append((r.pos, *r.tokens))
    assert got["j1"] == [(0, "1", "s3://b/d/1.CRAM"), (1, "2", "s3://b/d/2.cram"), (2, "3", "s3://b/d/e/3.cram")]
    assert [x[1] for x in got["j2"]] == ["6", "d", "1", "2", "3", "4"]
    assert set(got) == {"j1", "j2"}


def test_scratch_leaves_nothing_behind(spark, tmp_path):
    import os

    from batchloom.session import scratch, shared_folder

    before = set(os.listdir(shared_folder(spark)))
    (tmp_path / "a.txt").write_text("h\nx y\n")
    with scratch(spark):
        assert manifests.read_lines(spark, str(tmp_path / "a.txt")).count() == 2
        assert len(set(os.listdir(shared_folder(spark))) - before) == 1
    assert set(os.listdir(shared_folder(spark))) == before


def test_list_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.cram").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listings.list_files(spark, str(tmp_path)).collect()) == [
        "a.cram", "b.txt"
    ]


def test_ranges_have_a_bound(spark):
    rows = [("a" if i % 3 else "b", "same" if i % 2 else f"n{i:04d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, name string, k int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        cut = ordering.ranges(df, ["g", "name"], most=10)
        sizes = [r["count"] for r in cut.groupBy("__bucket").count().collect()]
        assert sum(sizes) == 500 and max(sizes) <= 10
        got = ordering.row_index_by(df, ["name"], ["g"], most=10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in "ab":
        names = [r.name for r in sorted((r for r in got if r.g == g), key=lambda r: r.row_index)]
        assert names == sorted(name for x, name, _ in rows if x == g)
        assert sorted(r.row_index for r in got if r.g == g) == list(range(len(names)))
    assert ordering.row_index_by(df.limit(0), ["name"]).count() == 0
    assert got[0].asDict().keys() == {"g", "name", "k", "row_index"}


def test_existence_and_pairs(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "name string")
    listing = spark.createDataFrame([("a",), ("a",), ("c",)], "name string")
    assert [r.name for r in joins.existing(wanted, listing, ["name"]).collect()] == ["a"]
    assert [r.name for r in joins.missing(wanted, listing, ["name"]).collect()] == ["b"]
    left = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, l string")
    right = spark.createDataFrame([(0, "p")], "pos long, r string")
    assert joins.zip_by_position(left, right).count() == 1
    assert [r.pos for r in joins.unpaired(left, right).collect()] == [1]


def test_config_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(
        '{"run_options": {"parallelism": "10", "cpu_milli": 5},\n "input_options": {"input_type": "cram"}}'
    )
    (tmp_path / "bad.json").write_text('{"run_options": {"para')
    df = configs.read_json_files(spark, str(tmp_path), schemas.BATCH_CONFIG)
    got = {r.uri.rsplit("/", 1)[-1]: r for r in df.collect()}
    assert got["good.json"]._corrupt_record is None and got["bad.json"]._corrupt_record
    job = configs.batch_jobs(df.filter("_corrupt_record is null")).first()
    assert (job.parallelism, job.cpu_milli, job.memory_mib) == (10, 5, 512)
    assert (job.machine, job.max_retry_count, job.max_run_duration) == ("e2-micro", 2, "7200s")


def test_trigger_texts(spark):
    label, config = K.JOB_LABEL_KEY, K.TRIGGER_CONFIG_KEY
    cases = {
        f'{{"{label}": "L", "{config}": "c.json"}}': ("L", "c.json"),
        f'{{"{label}": "L"}}': ("L", K.DEFAULT_BATCH_CONFIG),
        f'{{"{config}": "c.json"}}': (None, K.DEFAULT_BATCH_CONFIG),
        "not json": (None, K.DEFAULT_BATCH_CONFIG),
        "": (None, K.DEFAULT_BATCH_CONFIG),
        "[1]": (None, K.DEFAULT_BATCH_CONFIG),
        f'{{"{label}": "L", "{config}"': (None, K.DEFAULT_BATCH_CONFIG),
    }
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r.content: (r.job_label, r.config_name) for r in configs.trigger_fields(df).collect()}
    assert got == cases


def test_input_types(spark):
    df = spark.createDataFrame([("CRAM",), ("fastq",), ("fastq-list",), (None,)], "input_type string")
    good, bad = checks.supported_inputs(df)
    assert sorted(r.input_type for r in good.collect()) == ["cram", "fastq"]
    assert bad.count() == 2


def test_read_groups(spark, tmp_path):
    names = ",".join(schemas.READ_GROUPS.fieldNames())
    (tmp_path / "g.csv").write_text(f"{names}\nr1,s1,u,p,l,c,m,8,a,b\nr2,s1,u,p,l,c,m,7,a,b\nr3,,u,p,l,c,m,7,a,b\n")
    rows = manifests.read_groups_per_sample(manifests.read_groups(spark, str(tmp_path))).collect()
    assert [(r.sample_id, r.read_groups, r.lanes, r.first_group, r.last_group) for r in rows] == [
        ("s1", 2, 2, "r1", "r2")
    ]
