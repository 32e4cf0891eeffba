import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import nndescent, queries


def brute(rows, threshold=0.9):
    ids = sorted({i for i, _ in rows if i is not None})
    best = {}
    for i, v in rows:
        if i is not None and v is not None and (i not in best or v < best[i]):
            best[i] = v
    fine = {i: np.array(v, dtype=np.float32).astype(float) for i, v in best.items() if len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    link = {i: set() for i in ids}
    for i, x in fine.items():
        for j, y in fine.items():
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                link[i].add(j)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += link[x]
    return sorted((i, len(link[i]), comp[i]) if i is not None else (-1, 0, -1) for i, _ in rows)


def got(df, **k):
    out = nndescent.near_duplicates(df, **k).collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id, r.n_links, r.component_id) if r.vec_id is not None else (-1, 0, -1) for r in out)


def test_table_has_full_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in queries.op10_vectors(spark, d).collect()}
    assert {i: n for (i, _), n in zip(rows, want)} == found


def test_groups_chains_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    center = rng.standard_normal(16)
    rows += [(1000 + i, (center + 0.12 * rng.standard_normal(16)).tolist()) for i in range(150)]  # a group with borderline pairs
    rows += [(2000 + i, rows[0][1]) for i in range(40)]
    for i in range(60):  # a chain along a circle
        v = np.zeros(16)
        v[0], v[1] = np.cos(i * 0.12), np.sin(i * 0.12)
        rows.append((3000 + i, v.tolist()))
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0, None]), (4005, [float("inf")] * 16), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, rows[0][1]), (5, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (4008, (np.array(rows[3][1]) * 1e30).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("m", F.lit("clash"))
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id = 7")) == [(7, 0, 7)]


def test_links_between_families_whose_lists_are_full(spark):
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((24, 3)))[0].T
    family = lambda turn: [(np.cos(turn) * axes[0] + np.sin(turn) * axes[1] + 0.012 * rng.standard_normal(24)).tolist() for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(family(0.0) + family(0.33))]
    rows += [(100 + i, rng.standard_normal(24).tolist()) for i in range(50)]
    x = np.array([v for _, v in rows[:80]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x[:40] @ x[40:].T).min() >= 0.9
    assert (x[:40] @ x[:40].T).min() > (x[:40] @ x[40:].T).max()
    out = got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out == brute(rows)
    assert out[0] == (0, 79, 0) and out[79] == (79, 79, 0)


def test_failed_audit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "audit", lambda *_: (1, 2))
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="1 of 2 links"):
        got(df)
