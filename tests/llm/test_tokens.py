"""Operators on tokens and features against plain versions and public libraries."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from batchloom.llm import alignment, byte_bpe, resampling, textscan
from tests.conftest import SMALL
from tests.llm import brute

EVERY = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  \n\t "), (5, "One two"), (5, "One two"), (None, "one TWO  one"), (6, "x" * 200_000),
    (7, LONG), (8, "ünï cödé 𝒳 and\x0bmore\x00nul\x1funit 中文字 é かな कि"), (9, "<|endoftext|> </s><s><unk><0x41>"), (10, "a▁b ▁"),
    (11, "I'll we'd they're it's don't 'll 'l l"), (12, "A" * 30 + " " * 30), (13, "՘⃀\U0001e6c0 3"),
]


def random_texts(n, seed):
    rng = random.Random(seed)
    kinds = [" \n", "ab c\n'lre1.", "aeinrst ", " \t\n\xa0　xéñ中文字かなकि", EVERY]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(80))) for _ in range(n)]


def texts_of(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns with the names that the operators use inside, or return.
    clash = {c: F.lit(i) for i, c in enumerate(["n_a", "links", "pair", "key", "rank", "__short", "n_tokens", "bucket"])}
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(clash)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 13: byte-level BPE -----------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe(spark, ranks):
    return byte_bpe.ByteBpe(spark, ranks, public_tokenizers.PATTERN)


def test_ids_are_those_of_the_library(spark, codec, library):
    for text in [t for _, t in ODD if t != "x" * 200_000] + texts_of(spark) + random_texts(2_000, 1):
        assert codec.encode(text).tolist() == library.encode_ordinary(text or "")


def test_every_character_is_cut_as_the_library_does(codec, library):
    for begin in range(0, len(EVERY), 5_000):
        text = "".join(f"a{c}1{c}." for c in EVERY[begin : begin + 5_000])
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_a_match_of_any_length_takes_linear_time(codec):
    ids = codec.encode("x" * 1_000_000)
    assert codec.decode(ids.tolist()) == b"x" * 1_000_000
    assert ids.tolist() == codec.encode("x" * 2_000_000).tolist()[: len(ids)]


def test_small_vocabularies_against_plain_merging():
    rng = random.Random(7)
    for _ in range(60):  # ranks from merges of random texts, so every token is reachable
        ranks = {bytes([b]): b for b in range(256)}
        word = bytes(rng.choice(b"ab") for _ in range(200))
        parts = [word[i : i + 1] for i in range(len(word))]
        for rank in range(256, 256 + rng.randrange(1, 40)):
            pair = rng.choice([a + b for a, b in zip(parts, parts[1:])] or [b""])
            if not pair or pair in ranks:
                continue
            ranks[pair] = rank
            parts = byte_bpe._merged(word, ranks)
        codec = byte_bpe.Codec(byte_bpe.Vocabulary(ranks, r"(?s:.+)"))
        for _ in range(30):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            if data not in ranks:
                assert codec.piece_ids(data) == [ranks[p] for p in byte_bpe._merged(data, ranks)]


def test_prefix_tables_give_every_prefix(codec, library):
    word = "internationalisations"
    last = codec.table(word.encode())
    for n in range(1, len(word) + 1):
        assert codec.walked(last[:n], word[:n].encode()) == library.encode_ordinary(word[:n])


def test_edits_and_appends_equal_encoding_anew(codec, library):
    rng = random.Random(3)
    for text in random_texts(600, 4):
        made = byte_bpe.EncodedText(codec, text)
        for _ in range(4):
            begin = rng.randrange(len(made.text) + 1)
            end = min(len(made.text), begin + rng.randrange(6))
            made.edit(begin, end, rng.choice(["", "l", "'", " ", "\n", text[:5]]))
            anew = byte_bpe.EncodedText(codec, made.text)
            assert made.ids() == library.encode_ordinary(made.text)
            assert (made.pieces, made.tables) == (anew.pieces, anew.tables)
        made.append("ll  x")
        assert made.ids() == library.encode_ordinary(made.text)


def test_an_edit_fills_little_anew(ranks):
    codec = byte_bpe.Codec(byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN))
    filled = []
    plain = codec.fill
    codec.fill = lambda data, last, begin, end: (filled.append(end - begin), plain(data, last, begin, end))
    made = byte_bpe.EncodedText(codec, "ab" * 20_000 + LONG)
    filled.clear()
    made.edit(10_000, 10_001, "zq")
    made.edit(100_000, 100_003, "new words")
    made.append("!")
    assert sum(filled) < 300


def test_tables_of_texts(spark, bpe, odd, library):
    table = bpe.encoded(odd.where("doc_id <> 6 or doc_id is null"))
    assert {(r.doc_id, tuple(r.ids)) for r in table.collect()} == {
        (i, tuple(library.encode_ordinary(t or ""))) for i, t in ODD if i != 6
    }
    decoded = bpe.decoded(table)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.rank == 4 for r in decoded.collect())
    length = F.coalesce(F.length("text"), F.lit(0))
    edited = bpe.edited(table, F.least(F.lit(1), length), F.least(F.lit(3), length), F.lit("'ll "))
    again = bpe.edited(edited, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(" end"))
    assert again.columns == table.columns
    for r in again.collect():
        old = dict(ODD).get(r.doc_id) or ""
        assert r.text.endswith(" end") and r.ids == library.encode_ordinary(r.text)
        assert len(r.last) == len(r.text.encode()) and r.text.startswith(old[:1])


def test_digest_of_bpe(spark, bpe, odd, codec):
    def row(doc_id, text):
        ids = codec.encode(text)
        return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert rows_of(bpe.digest(odd)) == sorted((row(*r) for r in ODD), key=repr)
    assert bpe.digest(odd.limit(0)).count() == 0 == bpe.encoded(odd.limit(0)).count()


def test_ids_hash_like_the_library_in_blocks(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    for text in random_texts(200, 8):
        blocks = list(codec.blocks(text))
        assert np.frombuffer(b"".join(blocks), "<u4").tolist() == library.encode_ordinary(text)
        assert len(text) < 8 or len(blocks) > 0


def test_a_pattern_must_take_all_and_bytes_must_be_there(ranks):
    codec = byte_bpe.Codec(byte_bpe.Vocabulary(ranks, r"\p{L}+"))
    with pytest.raises(ValueError):
        byte_bpe.EncodedText(codec, "a b")
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, r".")


# -- 11: alignment ----------------------------------------------------------


@pytest.fixture(scope="module")
def aligner(spark):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    ranks = alignment.read_merges(public_tokenizers.path("byte_bpe_50k.json"))
    return alignment.Aligner(spark, ranks, public_tokenizers.PATTERN, model)


@pytest.fixture(scope="module")
def plain_groups(aligner):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes = {rank: token for token, rank in aligner.alphabet.a.ranks.items()}
    b_bytes = aligner.alphabet.pieces()

    def run(text):
        """Groups by walking both token lists side by side."""
        if not text:
            return []
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        if not b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
            return []
        groups, mine, theirs, i, j, a_end, b_end = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if a_end <= b_end:
                a_end += len(a_bytes[a[i]])
                mine.append(a[i])
                i += 1
            else:
                b_end += len(b_bytes[b[j]])
                theirs.append(b[j])
                j += 1
            if a_end == b_end:
                groups.append((mine, theirs))
                mine, theirs = [], []
        return groups

    return run


def printed(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_groups_of_odd_and_random_texts(aligner, plain_groups):
    made = alignment.Tokenizers(aligner.alphabet)
    texts = [t for _, t in ODD if t != "x" * 200_000] + random_texts(2_000, 2)
    found = alignment.Aligned(made, texts)
    assert list(found.printed(made)) == [printed(plain_groups(t)) for t in texts]


def test_texts_in_parts(aligner, plain_groups, spark, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 40)
    made = alignment.Tokenizers(aligner.alphabet)
    texts = texts_of(spark)[:60] + random_texts(300, 5)
    assert made.can_cut
    assert list(alignment.Aligned(made, texts).printed(made)) == [printed(plain_groups(t)) for t in texts]


def test_reading_of_the_vocabulary(aligner):
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(aligner.alphabet.a.reachable) == len(aligner.alphabet.a.ranks) == 50_256
    assert a_side.get_vocab()["Ġthe"] == aligner.alphabet.a.ranks[b" the"]


def test_shared_cuts_of_random_ends():
    rng = random.Random(6)
    for _ in range(300):
        a, b, low, high, base = [], [], [], [], 0
        for _ in range(rng.randrange(1, 5)):  # texts, one after the other
            n = rng.randrange(1, 60)
            mine = sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n})
            theirs = sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n})
            low.append(len(a))
            a += [base + x for x in mine]
            b += [base + x for x in theirs]
            high.append(len(a) - 1)
            base += n
        at_a, at_b = alignment.shared_cuts(*(np.array(x) for x in (a, b, low, high)))
        last = {a[h] for h in high}
        assert sorted(np.array(a)[at_a]) == sorted(set(a) & set(b) - last) == sorted(np.array(b)[at_b])


def test_digest_of_alignment(spark, aligner, odd, plain_groups):
    docs = odd.where("doc_id <> 6 or doc_id is null").select("doc_id", "text").unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    )
    rows = docs.collect()
    groups = [plain_groups(r.text) for r in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for r, found in zip(rows, groups):
        pairs = [(a[-1], b[-1]) for a, b in found]
        s = printed(found)
        want.append((
            r.doc_id, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(found),
            sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(s.encode()).hexdigest() if s else "",
        ))
    assert rows_of(aligner.digest(docs)) == sorted(want, key=repr)
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in aligner.pair_counts(docs).collect()} == {
        p: (n, n == most[p[1]]) for p, n in counts.items()
    }
    for r in aligner.groups(odd.where("doc_id in (5, 8, 11)")).collect():
        found = plain_groups(next(t for i, t in ODD if i == r.doc_id))
        assert r.a_sizes == [len(a) for a, _ in found] and r.b_sizes == [len(b) for _, b in found]
        assert r.b_ids == [b for _, part in found for b in part]


def test_alignment_of_one_long_run_and_of_nothing(aligner, odd):
    row = aligner.digest(odd.where("doc_id = 6")).first()
    assert row.n_a > 20_000 and row.n_b > 20_000 and row.n_groups > 20_000 and row.n_links == row.n_groups
    assert aligner.digest(odd.limit(0)).count() == 0 == aligner.pair_counts(odd.limit(0)).count()
    assert rows_of(aligner.digest(odd.where("doc_id < 3"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# -- 12: resampling ---------------------------------------------------------


def plain_resampling(docs, target, low, high, buckets, percent=10, least=20, seed=2024):
    def features(text):
        words = brute.ALNUM_WORD.findall(brute.lower(text))
        grams = [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text)
        key = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((n_words, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1]))
    drawn = percent * len(able) // 100
    out = [(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted([*out, *[(*r[1:], None) for r in rows if r[0] < least]], key=repr)


@pytest.mark.parametrize("low, high, buckets", [(1, 1, 10_000), (1, 2, 997), (2, 3, 10_000)])
def test_resampling(spark, odd, low, high, buckets):
    docs = odd.select("doc_id", "text", F.lit(1).alias("weight")).unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("weight"))
    )
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(
        spark.createDataFrame([(None, None), (None, "")], spark.read.parquet(f"{SMALL}/benchmark.parquet").schema)
    )
    got = resampling.resampled(docs, target, low, high, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], low, high, buckets)
    assert rows_of(got) == want


def test_resampling_of_more_text_than_a_task_takes_at_once(spark):
    rng = random.Random(12)
    words = ["ünï", "Cödé", "中文", "Plain", "two", "ÉTÉ", "x1"]
    texts = [" ".join(rng.choices(words[: 2 + i % 6], k=60_000)) for i in range(40)]
    assert sum(len(t.encode()) for t in texts) > resampling.PIECE
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)  # without a null
    target = spark.createDataFrame([("plain x1 ünï " * 9,)], "text string")
    want = plain_resampling([*enumerate(texts)], [r.text for r in target.collect()], 1, 1, 10_000)
    assert rows_of(resampling.resampled(docs, target)) == want


@pytest.mark.parametrize("texts", [["😀 a", "é B", "Z ü", "", "q"], ["😀 a", None, "é B", "Z ü"]])
def test_features_of_slices(texts):
    want = [[zlib.crc32(w.encode()) % 997 for w in brute.ALNUM_WORD.findall(brute.lower(t))] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for part in textscan.slices(batch, 1):
        found = resampling.Features(part.column("text"), 1, 1, 997)
        got += [found.bucket[found.owner == i].tolist() for i in range(found.n_texts)]
    assert got == want


def test_repeated_rows_and_ties(spark):
    text = " ".join(f"word{i}" for i in range(25))
    docs = spark.createDataFrame([(i % 7, text) for i in range(70)], "doc_id long, text string")
    rows = resampling.resampled(docs, docs.limit(1), percent=50).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 36))
    by_rank = [r for r in sorted(rows, key=lambda r: r.rank or 99) if r.rank]
    assert [(-r.score, r.doc_id) for r in by_rank] == sorted((-r.score, r.doc_id) for r in by_rank)
    assert resampling.sample(docs, docs.limit(1), percent=50).count() == 40  # the last id's rows are drawn together


def test_a_sample_leans_to_the_target(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["blue", "green"] if i % 4 else ["alpha", "beta", "gamma"]) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__drawn", F.lit(5))
    target = spark.createDataFrame([("alpha gamma beta alpha " * 20,)], "text string")
    drawn = resampling.sample(docs, target)
    assert drawn.columns == docs.columns
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 40 and all(i % 4 == 0 for i in ids)


def test_resampling_of_nothing(spark, odd):
    target = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.resampled(odd.limit(0), target).count() == 0
    rows = resampling.resampled(odd, target.limit(0)).collect()
    assert len(rows) == len(ODD) and all(r.weight <= 0 for r in rows)
