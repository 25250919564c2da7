"""WARC, language identification, chat formatting and the pipeline."""

import base64
import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchloom.llm import chat, language_id, queries, warc
from batchloom.session import release, run_folder, trim
from tests.conftest import SMALL
from tests.llm import brute

PAGE = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/\r\nx", "same"), (7, None, "same"), (3, "http://b", "same"), (4, "http://c", None), (5, "http://d", ""),
    (6, "http://e", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (8, "http://f", "ünï 𝒳\r\n\r\n" * 20_000),
    (None, "http://g", "same"), (9, "http://h", "alone"), (9, "http://h", "alone"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def as_pages(rows):
    best = {}
    for page_id, _, html in rows:
        if page_id is not None:
            best[html or ""] = max(best.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        other = best[html or ""] if best[html or ""] != page_id else None
        out.append((page_id, len((html or "").encode()), sha1(html), "revisit" if other is not None else "response", other))
    return out


@pytest.mark.parametrize("given", ["odd", "small"])
def test_archive_round_trip(spark, given):
    pages = spark.createDataFrame(PAGES, PAGE) if given == "odd" else spark.read.parquet(f"{SMALL}/pages.parquet")
    got = [tuple(r) for r in warc.round_trip(pages.withColumn("payload", F.lit(1))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, as_pages([tuple(r) for r in pages.select("page_id", "url", "html").collect()])))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_reader_prunes(spark, compression):
    path = run_folder(spark, "archive")
    pages = spark.createDataFrame(PAGES, PAGE).repartition(3)
    warc.write_archive(pages, path, records_per_file=2, compression=compression, min_bytes=1)
    every = warc.read_archive(spark, path, partitionBytes=1)
    assert every.count() == len(PAGES)
    payloads = {r.record_id: bytes(r.payload) for r in every.where("warc_type = 'response'").collect()}
    assert payloads["<urn:x-page:8>"].decode() == PAGES[6][2] and payloads["<urn:x-page:6>"].decode() == PAGES[5][2]
    assert {r.target_uri for r in every.where("warc_type = 'revisit' and target_uri like 'http://a%'").collect()} == {"http://a/%0D%0Ax"}
    plan = every.where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan" in plan
    bare = warc.read_archive(spark, path, payload="false")
    assert bare.where("payload is null").count() == len(PAGES)


def test_a_broken_archive_is_reported(spark):
    path = run_folder(spark, "broken")
    spark.createDataFrame([("WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort",)], "value string").write.text(path)
    with pytest.raises(Exception, match="a block ends after"):
        warc.read_archive(spark, path).collect()


def test_empty_archive(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def lang_docs(spark, n=240):
    rng = random.Random(3)
    parts = {"aa": ["ba", "na", "ra", "lo"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["жи", "ша", "ро", "ка"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_documents(spark):
    docs = lang_docs(spark)
    odd = [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (1003, "ελληνικά κείμενα άγνωστα", None), (None, "banara lora", "bb")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id: r for r in language_id.digest(rows).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].lang_pred == truth[i] for i in truth)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    assert got[1003].rejected and not got[0].rejected and got[None].lang_pred == "aa"
    again = {r.doc_id: r for r in language_id.digest(rows.repartition(7)).collect()}
    assert all(again[i].lang_pred == got[i].lang_pred and abs(again[i].score - got[i].score) < 1e-9 for i in got)
    kept = language_id.recognised(rows.withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 241


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.digest(docs).collect()] == [(1, False, "und", 0.0, True)]
    assert language_id.digest(docs.limit(0)).count() == 0


def test_noisy_language_tags_do_not_stop_the_query(spark):
    docs = lang_docs(spark)
    noisy = docs.unionByName(spark.createDataFrame([(1000 + i, "ba", f"tag{i}") for i in range(9)], docs.schema))
    model = language_id.fitted(noisy, max_langs=3)
    assert sorted(model.langs) == ["aa", "bb", "cc"]
    got = {r.doc_id: r.lang_pred for r in language_id.digest(noisy, max_langs=3).where("doc_id < 1000").collect()}
    assert got == {r.doc_id: r.lang for r in docs.collect()}


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr", "all but two"])
def test_texts_in_an_unknown_language_are_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known = F.col("lang").isin("de", "fr") if left_out == "all but two" else F.col("lang") != left_out
    model = language_id.fitted(docs.where(known))
    rows = language_id.predicted(docs.where(F.length("text") > 20), model)
    held = rows.where(language_id.fold(F.col("doc_id")) == 2)
    share = F.avg(F.col("rejected").cast("double")).alias("share")
    assert rows.where(~known).agg(share).first().share >= 0.9
    assert held.where(known).agg(share).first().share <= 0.02
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("share")
    assert held.where(known & ~F.col("rejected")).agg(right).first().share >= 0.99


def test_columns_of_the_caller_keep_their_values(spark):
    docs = lang_docs(spark)
    own = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in (*language_id.RESULTS, "place", "source")}
    kept = language_id.recognised(docs.withColumns(own))
    assert kept.columns == [*docs.columns, *own]
    assert all(r[c] == f"{c}{r.doc_id}" for r in kept.collect() for c in own)
    with pytest.raises(ValueError):
        language_id.predicted(docs.withColumn("score", F.lit(1)), None)


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = [(i % 5, f"text {i}", "aa") for i in range(400)] + [(1000 + i, f"x {i}", "bb") for i in range(300)] + [(2, "z", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.sample(docs, 50, 10).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found}["bb"] == 50 and {r["lang"]: r["count"] for r in found}["aa"] <= 5


def test_long_text_scores_as_its_parts(spark):
    model = language_id.fitted(lang_docs(spark))
    text = "schung keitver " * 100
    one = model.scores([text, "", text * 20, "ba"])
    assert abs(one[0] - model.scores([text])[0]).max() < 1e-9
    assert one[2].argmax() == 1 and abs(one[1] - 1 / 3).max() < 0.05


TURNS = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "system", "&lt;<|text|>[INST]\\ &amp; <|end|>\n"), (1, 1, "user", None), (1, 2, "assistant", "ünï 𝒳 <|turn|>"),
    (1, 2, "assistant", "again"), (2, 5, None, "x"), (None, 0, "assistant", "nobody"), (3, None, "user", "first"), (3, 1, "assistant", ""),
    (4, 0, "a<b|\n", "t"),
] + [(5, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]


def conversation_rows(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), brute.sha256("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), brute.sha256(loss))
    return out


@pytest.mark.parametrize("given", ["odd", "small"])
def test_conversations_read_back(spark, given):
    table = spark.createDataFrame(TALK, TURNS) if given == "odd" else spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = conversation_rows([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(table.withColumn("tree", F.lit(0))).collect()}
    assert got == want


def test_best_branch_of_a_tree(spark):
    rows = [
        ("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "bad"), ("t", 3, 1, 3.0, "assistant", "good"),
        ("t", 4, 3, 2.0, "user", "more"), ("t", 5, 4, 9.0, "assistant", "end"), ("t", 6, 4, 1.0, "assistant", "poor"),
        ("orphan", 1, 77, None, "user", "alone"), ("circle", 1, 2, 1.0, "user", "a"), ("circle", 2, 1, 1.0, "user", "b"), ("circle", 3, 1, 1.0, "user", "c"),
    ]
    table = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string")
    got = {(r.tree, r.leaf): (r.conversation, [tuple(s) for s in r.loss]) for r in chat.formatted(table).collect()}
    assert set(got) == {("t", 5), ("orphan", 1)}
    text, loss = got["t", 5]
    assert chat.parsed(text) == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")]
    assert [text[a:b] for a, b in loss] == ["good", "end"]
    assert {r.leaf for r in chat.formatted(table, branches=5).where("tree = 't'").collect()} == {2, 5, 6}
    assert chat.formatted(table.limit(0)).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == out.count() > 100
    source = {r.doc_id: r for r in docs.collect()}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    leaks = brute.contamination([(r.doc_id, r.text) for r in source.values()], [(r.item_id, r.text) for r in bench])
    groups = brute.ngram_components([(r.doc_id, r.text) for r in source.values()], 5, 80)
    for i in source:
        first = groups[i][1] == i
        if any(c.isalpha() for c in source[i].text) and first and not leaks[i][1]:
            assert i in rows or len(source[i].text) < 20, i
        if leaks[i][1] or not first:
            assert i not in rows
    for r in rows.values():
        assert sum(map(len, brute.pii_spans(r.text).values())) == 0
        assert r.size == len(brute.BLANK_WORD.findall(r.text)) and r.taken <= 3 * r.size
    assert "pipeline" in queries.QUERIES and len(corpus_pipeline.STAGES) == 5


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_stages_begin_afresh(spark, monkeypatch):
    """Before a stage looks at anything, the driver lets go of what nothing uses any more."""
    begun = []
    monkeypatch.setattr(corpus_pipeline, "release", begun.append)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        with pytest.raises(Exception):
            stage(spark, None, "/nowhere")
        assert begun == [spark] * (i + 1)


def test_freed_memory_goes_back(spark):
    """192 MB in small pieces of the JVM's native memory, freed but for the last: the system gets them at once."""
    if not trim(spark):
        pytest.skip("this JVM cannot trim")
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"

    def resident() -> int:
        with open(status) as lines:
            return next(int(x.split()[1]) // 1024 for x in lines if x.startswith("VmRSS"))

    pieces = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3072)]
    full, last = resident(), pieces.pop()
    del pieces
    for _ in range(20):
        release(spark)
        if full - resident() > 100:
            break
        time.sleep(0.5)  # the JVM frees pieces by and by
    assert full - resident() > 100 and last.capacity() == 1 << 16
