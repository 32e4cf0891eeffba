import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.llm import quality, queries


def brute_score(text, weights, bias):
    total = n = 0
    for f in quality.features(text):
        for x in f.tolist():
            total += float(weights[x])
            n += 1
    return 1 / (1 + np.exp(-(total / max(1, n) + bias)))


def test_held_out_accuracy_and_fold(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op5_quality(spark, d).toPandas()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    both = rows.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 500 and (held.predicted == held.quality).mean() >= 0.95
    assert (held[held.quality == 1].predicted == 1).mean() >= 0.97


def test_scores_by_brute_force_and_edges(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = quality.train(docs, labels)
    texts = [None, "", " \n", "a", "WORD!! " * 3000, "x" * 300_000, "é\x00 b b b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "a")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    for r in quality.score(df, (weights, bias)).collect():
        assert abs(r.score - brute_score(texts[r.doc_id], weights, bias)) < 1e-6
    assert quality.score(df.limit(0), (weights, bias)).count() == 0


def test_labels_missing_or_of_one_class(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in ([], [(i, None, 0) for i in range(50)], [(i, 1, 0) for i in range(50)], [(None, 0, 0), (10**9, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = quality.classify(docs, labels).select("score").distinct().collect()
        assert len(got) == 1 and 0 < got[0].score < 1


def test_training_is_repeatable_and_blind_to_the_held_out_fold(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]
