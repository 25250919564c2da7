"""Operators on words and windows against plain versions."""

import pytest
from pyspark.sql import functions as F

from batchloom.llm import decontaminate, line_rules, ngram_join
from batchloom.session import scratch
from tests.conftest import SMALL
from tests.llm import brute

DOC = "doc_id long, text string, source string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "  \n\t ", "a"),
    (4, "One two", "a"),
    (5, "one TWO", "b"),
    (6, "x" * 3_000_000, "b"),
    (7, LONG, "c"),
    (8, LONG + " tail", None),
    (9, "a b c d e f g h i j k l\na b c d e f g h i j k l\n#$%&|<>*", "a"),
    (10, "ünï cödé wörds ünï cödé wörds über 𝒳 𝒴 and\x0bmore\x00nul\x1funit", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def docs_of(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")


def check_components(docs, n=4, percent=85):
    rows = docs.collect()
    want = brute.ngram_components([(r.doc_id, r.text) for r in rows], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(docs, n, percent).collect()}
    assert got == want


@pytest.mark.parametrize("given", ["odd", "small"])
def test_components(spark, odd, given):
    check_components(odd if given == "odd" else docs_of(spark))


def test_components_at_other_thresholds(spark):
    check_components(docs_of(spark), 5, 80)
    check_components(docs_of(spark).limit(100), 2, 50)


def test_chains_and_groups_of_near_copies(spark):
    import random

    rng = random.Random(5)
    rows, doc_id = [], 0
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(40):  # each copy changes some words of the last one, or of the first
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            if group % 2:
                base = words
            rows.append((doc_id, " ".join(words), "s"))
            doc_id += 1
    rng.shuffle(rows)
    check_components(spark.createDataFrame(rows, DOC))


def test_passage_shared_by_all(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"d{i}w{j}" for j in range(i % 7 * 10)), "s") for i in range(120)]
    check_components(spark.createDataFrame(rows, DOC))


def test_blocks_of_a_long_list(spark):
    """10,000 sets of one list: about one block per 64, whether each has a home of its own or all have one."""
    columns = [F.lit(1).alias("token"), F.col("id").alias("node"), F.lit(100).alias("size"), F.lit(0).alias("pos"), F.col("id").alias("label")]
    rest = [F.lit(90).alias("overlap"), F.lit(100).alias("lead_size")]
    nodes = spark.range(10_000)
    for home in (F.col("id"), F.lit(5).cast("long"), F.col("id") % 100, F.col("id") % 1000):
        blocks = ngram_join.list_blocks(nodes.select(*columns, home.alias("home"), *rest))
        sizes = [r.n for r in blocks.select(F.size("rows").alias("n")).collect()]
        assert sum(sizes) == 10_000 and len(sizes) <= 2 * 157 and max(sizes) <= 4 * ngram_join.BLOCK_ROWS


def test_a_set_meets_few_leaders(spark):
    """Near copies that all differ a little: comparisons follow the sets, not the leaders."""
    import random

    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for doc_id in range(400):
        words = list(base)
        for _ in range(8):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((doc_id, " ".join(words), "s"))
    docs = spark.createDataFrame(rows, DOC)
    seen = []
    real = ngram_join._answered
    ngram_join._answered = lambda pairs, whole: (seen.append(pairs.count()), real(pairs, whole))[1]
    try:
        check_components(docs, 4, 85)
    finally:
        ngram_join._answered = real
    assert sum(seen) <= 4 * len(rows)


def test_a_pair_is_compared_once(spark, monkeypatch):
    """Sets about as near each other as links need: no two are compared twice, whatever lists they share."""
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for doc_id in range(200):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        rows.append((doc_id, " ".join(words), "s"))
    seen = []
    real = ngram_join.overlaps

    def spy(pairs, whole):
        if "label_a" in pairs.columns:
            seen.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return real(pairs, whole)

    monkeypatch.setattr(ngram_join, "overlaps", spy)
    check_components(spark.createDataFrame(rows, DOC))
    assert seen and len(set(seen)) == len(seen)


def test_entries_carry_the_tokens_listed_before(spark):
    sets = [(n, 40, [t * 1000 for t in range(40) if (t * 7 + n) % 5]) for n in range(20)]
    nodes = spark.createDataFrame([(n, len(t), t) for n, _, t in sets], "node long, size long, tokens array<long>")
    lists: dict[int, list] = {}
    for r in ngram_join.index_lists(nodes, 20).collect():
        lists.setdefault(r.node, []).append((r.pos, r.token, r.before))
    assert len(lists) == 20 and max(map(len, lists.values())) > ngram_join.EARLIER
    for entries in lists.values():
        tokens = [t for _, t, _ in sorted(entries)]
        for i, (_, _, before) in enumerate(sorted(entries)):
            assert sorted(before) == sorted(tokens[max(0, i - ngram_join.EARLIER) : i])


def test_deduplicated_leaves_one_table(spark, odd):
    docs = odd.select("doc_id", "text")
    with scratch(spark) as folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        out = ngram_join.deduplicated(docs)
        left = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
        assert [name.rpartition("-")[0] for name in left] == ["first-keys"]
        assert 0 < out.count() < docs.count()


def test_deduplicated(spark, odd):
    docs = odd.unionByName(odd).withColumn("node", F.lit(1)).withColumn("key", F.lit(2))
    out = ngram_join.deduplicated(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect())
    assert ids == [1, 1, 2, 2, 3, 3, 4, 6, 7, 9, 10]


def test_decontamination(spark, odd):
    items = [(1, "a b c d e f g h i j k"), (2, "a b c"), (3, None), (4, ""), (5, LONG[5_000:5_400]), (6, "One"), (7, "ünï CÖDÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for docs, given in ((odd, items), (docs_of(spark), None)):
        table = bench if given else spark.read.parquet(f"{SMALL}/benchmark.parquet")
        want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in table.collect()])
        for limit in (decontaminate.MAX_HASHES, 50):
            rows = decontaminate.digest(docs, table, max_hashes=limit).collect()
            got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows}
            assert got == want and len(rows) == docs.count()


def test_removal_of_spans_and_documents(spark):
    rows = [(1, "keep this A b-c d e f g h i J! and this", "s"), (2, "clean text", "s"), (3, None, "s")]
    docs = spark.createDataFrame(rows, DOC).withColumn("n_chars", F.length("text").cast("long"))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    job = decontaminate.Decontaminator(docs, bench)
    out = {r.doc_id: (r.text, r.n_chars) for r in job.without_spans().collect()}
    assert out == {1: ("keep this ! and this", 20), 2: ("clean text", 10), 3: (None, None)}
    assert sorted(r.doc_id for r in job.without_documents().collect()) == [2, 3]


@pytest.mark.parametrize("given", ["odd", "small"])
def test_quality(spark, odd, given):
    docs = odd if given == "odd" else docs_of(spark)
    want = brute.line_verdicts([(r.doc_id, r.source, r.text) for r in docs.collect()], max_docs=3)
    rows = line_rules.judged(docs, max_docs=3).drop("n_common_words").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == want


def test_common_lines_go_and_depleted_documents_too(spark):
    line = "this is the same menu line of every page on this host here"
    rows = [(i, f"{line}\nown text number {i} with enough words to stay here for good I say", "h") for i in range(20)]
    rows += [(100 + i, f"{line}\nown {i}", "h") for i in range(3)] + [(200, f"{line}\nown", "other")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.kept for r in line_rules.judged(docs).collect()}
    assert not any(got[100 + i] for i in range(3)) and got[200]
    out = {r.doc_id: r.text for r in line_rules.cleaned(docs, max_docs=10).collect()}
    assert out[100] == "own 0" and out[200] == f"{line}\nown"


def test_limit_of_common_lines_does_not_grow_with_the_host(spark):
    line = "this is the same menu line of every page on this host here"
    rows = [(i, f"own text number {'x' * i} with enough words to stay here for good I say", "h") for i in range(1_000)]
    rows += [(2_000 + i, f"{line}\nown {'x' * i}", "h") for i in range(11)]
    rows += [(3_000 + i, f"another {line}\nown {'x' * i}", "h") for i in range(10)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: (r.n_common_words, r.kept) for r in line_rules.judged(docs).collect()}
    want = brute.line_verdicts([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert {i: kept for i, (_, kept) in got.items()} == {i: row[-1] for i, row in want.items()}
    assert all(got[2_000 + i] == (13, False) for i in range(11))
    assert all(got[3_000 + i] == (0, True) for i in range(10)) and got[0] == (0, True)
    assert {r.doc_id: r.text for r in line_rules.cleaned(docs).collect()}[2_003] == "own xxx"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.digest(docs).count() == line_rules.judged(docs).count() == decontaminate.digest(docs, bench).count() == 0
    assert decontaminate.digest(docs_of(spark), bench).where("contaminated").count() == 0
