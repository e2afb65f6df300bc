"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerdesk.llm import (
    language_model,
    merkle,
    mixing,
    packing,
    pattern_packing,
    phrases,
    quality,
    sharding,
    simhash,
    substring,
    topk,
    toxicity,
    warc,
)
from sellerdesk.llm.common import table


def op1_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def byte_bpe() -> packing.Tokenizers:
    import public_tokenizers as public

    path = public.path
    return packing.Tokenizers(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), 2048).drop("ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(table(spark, sf_dir, "documents"), min_words=35)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("times")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return sharding.interleave_shards(rows).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), order=3)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_proofs(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pattern_packing.pack(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))


QUERIES = {
    "op1_line_cleaning": op1_line_cleaning,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_language_model": op9_language_model,
    "op10_topk": op10_topk,
    "op11_merkle": op11_merkle,
    "op12_phrases": op12_phrases,
    "op13_pattern_packing": op13_pattern_packing,
}
