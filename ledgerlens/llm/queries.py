"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import anchors, bpe, decontam, html_extract, minhash, nndescent, packing, passages, phrases, quality, secrets, sharding, urls
from ledgerlens.session import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, cover=80, top=2000)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER, size=2048, separator=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_passages": op2_passages,
    "op3_decontam": op3_decontam,
    "op4_near_dups": op4_near_dups,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_main_text": op7_main_text,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_vectors": op10_vectors,
    "op11_codes": op11_codes,
    "op12_phrases": op12_phrases,
    "op13_packing": op13_packing,
}
ORACLE: dict[str, str] = {"op11_codes": anchors.SQL, "op12_phrases": phrases.SQL}
