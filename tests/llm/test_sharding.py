import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries, sharding


def test_curve_visits_each_cell_once_by_single_steps(spark):
    for n in (2, 3):
        grid = spark.range(32**n).select(*[F.expr(f"CAST((id div {32**i}) % 32 AS INT)").alias(f"x{i}") for i in range(n)])
        rows = grid.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)])).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(32**n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def check(rows, texts, shards):
    assert sorted(r.doc_id is not None and r.doc_id for r in rows) == sorted(k is not None and k for k, _ in texts)
    counts = Counter(r.shard for r in rows)
    assert not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    body = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in texts)
    assert Counter((r["size"], r.text_crc32) for r in rows) == body
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_whole_table(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op8_sharding(spark, sf_dir).collect()
    check(rows, texts, 40)
    assert {r.law for r in rows} == {"rows"}


def test_edges_and_hot_source(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    rows = [(i, "same text" if i < 400 else f"é{i}", "en" if i % 3 else None, "hot" if i < 700 else f"s{i}", 1, 2) for i in range(1000)]
    rows += [(5, None, None, None, 0, 0), (5, "", "", "", 0, 0), (5, "", "", "", 0, 0), (None, "x" * 100_000, "fr", "hot", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank int, size int")
    got = sharding.hilbert_shards(df, 7).collect()
    check(got, [(r[0], r[1]) for r in rows], 7)
    assert sharding.hilbert_shards(df.limit(0), 7).count() == 0
    check(sharding.hilbert_shards(df.limit(3), 7).collect(), [(r[0], r[1]) for r in rows[:3]], 7)


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, sharding.hilbert_shards(docs, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} == set(range(5))


def test_levels_rank_whole_strings(spark):
    values = [f"https://long.example/common/prefix/{i:03d}" for i in range(64)]
    df = spark.createDataFrame([(v,) for v in values for _ in range(5)] + [(None,)] * 3, "source string")
    got = {r.value: r.level for r in sharding.string_levels(df, "source").collect()}
    assert got[None] == 0 and [got[v] for v in values] == [32 * (3 + 5 * i) // 323 for i in range(64)]
    hot = spark.createDataFrame([("a",)] * 900 + [("b",)] * 50 + [("c",)] * 50, "source string")
    assert {r.value: r.level for r in sharding.string_levels(hot, "source").collect()} == {"a": 0, "b": 28, "c": 30}


def test_repeated_ids_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "en", "x"), (1, "b", "en", "x")], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="unique"):
        sharding.write_shards(df, sharding.hilbert_shards(df, 2), str(tmp_path / "out"))


def test_plan_is_native(spark, sf_dir):
    plan = queries.op8_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
