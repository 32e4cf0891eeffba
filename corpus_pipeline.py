"""Corpus pipeline: quality, near-dedup, decontamination, secret redaction, tokenization.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents, in
their order, and carry columns that documents don't have in the tables along unchanged. A table without rows gives one
without rows. Rows are never changed but by redaction, and texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, minhash, quality, secrets
from ledgerlens.llm.joins import by_ids
from ledgerlens.llm.queries import VOCABULARY
from ledgerlens.session import checkpoint, table

#: Near-duplicates of the pipeline: words of a shingle and similarity in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: The tokenizer's memo and blocks, smaller than its own: executors come to it from the stages before with less memory free.
MEMO_WORDS, WORD_BLOCK = 30_000, 5_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the score of a text without words, and go or stay as one; null ids are scored like others and
    are no training rows. Repeated rows go or stay together.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near-duplicates, once.

    Rows without an id, and texts without words, are near nothing and stay. Rows that repeat an id and its text are one;
    of rows with one id and different texts all stay if the id does.
    """
    found = minhash.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILARITY)
    kept = by_ids(docs, found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = checkpoint(kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    some = by_ids(kept, repeated, "doc_id").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return by_ids(kept, repeated, "doc_id", "left_anti").select(docs.columns).unionByName(some)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark.

    Null and empty texts have none, and rows without an id aren't looked at; both stay. Of a repeated id all rows go if one
    of them overlaps.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return by_ids(docs, found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew where that changed the text.

    Null texts stay null and empty ones empty; ids aren't read, and repeated rows stay repeated.
    """
    spans = "secret_spans"
    while spans in docs.columns:
        spans += "_"
    clean = secrets.redact(secrets.scan(docs, out=spans), spans=spans)
    count = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", count).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests and those of the decoded bytes; one row for each row.

    Null and empty texts have no tokens.
    """
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, with_ids=True, memo_words=MEMO_WORDS, word_block=WORD_BLOCK)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokenization", tokenize),
]

#: The classifier is trained and the tokenizer and components iterate: SQL can't state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
