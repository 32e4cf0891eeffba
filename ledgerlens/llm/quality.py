"""Document quality by supervised subword embeddings.

A document is the mean of the vectors of its hashed words and byte n-grams; a softmax over that mean gives the classes
(Joulin et al. 2017). Vectors and output weights are learnt together by plain numpy stochastic gradient descent in one
task, on a sample of at most about ``TRAIN_ROWS`` labelled rows drawn by a hash of the id. To score, each bucket's
vector is first multiplied by the difference of the two output rows, which leaves one number a bucket: the score of a
whole text is then the mean of these numbers, whatever its length.

Rows are in the held-out fold where crc32 of the id as text is 0 mod ``FOLDS``; the fold, a null quality and labels
without a document never reach the training. Null and empty texts have no features and get the score that the learnt
bias gives. Without any labelled rows, or with labels of one class only, scores are that class's prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import U, tidy

#: Bound of the training sample; buckets of the embedding table and their dimensions; steps of training, whatever the sample's size; learning rate at the start.
TRAIN_ROWS, BUCKETS, DIM, STEPS, RATE, SEED = 4000, 1 << 17, 8, 16_000, 0.6, 17
FOLDS, ACCEPT = 5, 0.3
#: Bytes of text whose n-grams are hashed at once.
BLOCK_BYTES = 1 << 20


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets, block by block: words, byte 3- and 4-grams over single spaces, repeats of the word before."""
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    for i in range(0, len(parts), BLOCK_BYTES // 8):
        block = parts[i : i + BLOCK_BYTES // 8]
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, block), dtype=U, count=len(block))
        again = np.flatnonzero(words[1:] == words[:-1])
        raw = np.frombuffer(b" " + b" ".join(block) + b" ", dtype=np.uint8).astype(np.uint32)
        three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        four = three[:-1] | raw[3:] << np.uint32(24)
        yield (words & U(BUCKETS - 1)).astype(np.int32)
        yield ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)).astype(np.int32)
        yield ((four * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) >> np.uint32(32 - 17)).astype(np.int32)
        yield np.zeros(len(again), dtype=np.int32)


def fit(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """One number a bucket and the bias, so that the logit of class 1 is their mean plus the bias."""
    rng = np.random.default_rng(SEED)
    if len(labels) == 0 or len(set(labels.tolist())) == 1:
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log(prior / (1 - prior)))
    docs = []
    for t in texts:
        at, count = np.unique(np.concatenate([np.empty(0, dtype=np.int32), *features(t)]), return_counts=True)
        docs.append((at, (count / max(1, count.sum())).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    done = 0
    while done < STEPS:
        for i in rng.permutation(len(docs))[: STEPS - done]:
            rate = RATE * (1 - done / STEPS)
            done += 1
            at, share = docs[i]
            mean = share @ table[at] if len(at) else np.zeros(DIM, dtype=np.float32)
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= np.float32(0.1 * rate) * p
            if len(at):
                table[at] -= np.float32(rate * min(len(at), 50)) * share[:, None] * back
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Fit on a sample of the labelled rows outside the held-out fold; the weights, of fixed size, come to the driver. Labels other than 0 and 1 are left out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where((fold(F.col("k")) != 0) & F.col("y").isin(0, 1))
    total = known.count()
    scale = 1_000_000
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < int(scale * min(1.0, TRAIN_ROWS / max(1, total))))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(picked), "k")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "y"], kind="stable")
        weights, bias = fit(pdf["text"].tolist(), pdf["y"].to_numpy())
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(one, "weights binary, bias double").collect()
    if not got:
        return fit([], np.empty(0, dtype=np.int64))
    return np.frombuffer(got[0].weights, dtype=np.float32), got[0].bias


def chance(text: str | None, model: tuple[np.ndarray, float]) -> float:
    """The learnt chance of class 1 of one text."""
    weights, bias = model
    total, n = 0.0, 0
    for f in features(text):
        total += float(weights[f].sum(dtype=np.float64))
        n += len(f)
    return 1 / (1 + np.exp(-(total / max(1, n) + bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row: the learnt chance of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [chance(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ACCEPT or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([chance(t.as_py(), shared.value) >= ACCEPT for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels, key), key)
    return scored.select(key, (fold(F.col(key)) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
