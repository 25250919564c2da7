"""The queries of this subpackage, by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchloom.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import pii

    return pii.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), **pii.WHOLE)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import secrets

    return secrets.digest(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import url_filter

    found = url_filter.judged(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import mixing

    return mixing.mixture(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import ngram_join

    return ngram_join.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import decontaminate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import line_rules

    return line_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import language_id

    return language_id.digest(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digest(rows.unionByName(probe))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from batchloom.llm import alignment

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    ranks = alignment.read_merges(public_tokenizers.path("byte_bpe_50k.json"))
    aligner = alignment.Aligner(spark, ranks, public_tokenizers.PATTERN, model)
    return aligner.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm import resampling

    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resampling.resampled(docs.select("doc_id", "text"), target.select("text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from batchloom.llm import byte_bpe

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = byte_bpe.ByteBpe(spark, ranks, public_tokenizers.PATTERN)
    return codec.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in [
        op1_ngram_join, op2_mixing, op3_warc, op4_url_filter, op5_decontamination, op6_line_rules, op7_language_id,
        op8_chat, op9_pii, op10_secrets, op11_alignment, op12_resampling, op13_byte_bpe,
        pipeline,
    ]
}
ORACLES: dict[str, str] = {
    "op3_warc": oracles.WARC,
    "op4_url_filter": oracles.URL_FILTER,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op6_line_rules": oracles.LINE_RULES,
    "op8_chat": oracles.CHAT,
    "op10_secrets": oracles.SECRETS,
    "op12_resampling": oracles.RESAMPLING,
}
