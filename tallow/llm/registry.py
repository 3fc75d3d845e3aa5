"""The subpackage's queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), special=True)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import topk

    vectors = topk.vectors_of(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import chat

    return chat.render(table(spark, sf_dir, "conversations"))


def op4_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import media

    return media.round_trip_digests(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import repeats

    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) {} 2"
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=fold.format("<>"))
    return toxicity.score(docs, model).selectExpr("doc_id", f"coalesce({fold.format('=')}, false) AS held_out", "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallow.llm import bpe

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import pii

    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.TEST_KEY)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallow.llm import lines

    return lines.drop_recurring(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_ngram_jaccard, op3_top_k, op4_media_webp, op5_chat, op6_repeats, op7_toxicity, op8_byte_bpe, op9_pii, op10_line_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    from tallow.llm import oracles

    return {"op2_ngram_jaccard": oracles.JACCARD, "op3_top_k": oracles.TOP_K, "op5_chat": oracles.CHAT, "op6_repeats": oracles.REPEATS, "op10_line_dedup": oracles.LINES}
