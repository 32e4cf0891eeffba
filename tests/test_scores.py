import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import golden
from ledgerlens.operators import traversal as R
from ledgerlens.plans import catalog, more  # noqa: F401


def pool_adjacent(x, y):
    """Isotonic means over the distinct values of ``x``."""
    values = np.unique(x)
    blocks = []
    for v in values:
        hit = y[x == v]
        blocks.append([hit.mean(), len(hit), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return values, np.concatenate([[m] * k for m, _, k in blocks])


def test_scores_are_calibrated_on_the_held_out_fold(spark, sf_dir):
    rows = catalog.QUERIES["m_score"](spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("address"), F.lit(4))).collect()
    assert len({r.address for r in rows}) == len(rows) == catalog.QUERIES["first_last_t"](spark, sf_dir).count()
    raw, y, fold, score = (np.array([float(r[c]) for r in rows]) for c in ("raw", "label", "fold", "score"))
    at, value = pool_adjacent(raw[fold == 0], y[fold == 0])
    assert np.abs(np.interp(raw, at, value) - score).max() < 1e-3
    assert ((0 <= raw) & (raw <= 1)).all() and raw[(y == 1) & (fold > 0)].mean() > raw[(y == 0) & (fold > 0)].mean()


def test_traces(spark):
    rows = [(1, "a", "in", 1), (1, "b", "out", 1), (2, "b", "in", 2), (2, "c", "out", 2), (2, "d", "out", 2), (3, "z", "in", 9), (3, "a", "out", 9)] + [(4, f"h{i}", "out", 3) for i in range(6)] + [(4, "d", "in", 3)]
    edge = spark.createDataFrame(rows, "txid long, address string, role string, step int")
    start = spark.createDataFrame([("a",), ("unknown",)], "address string")
    got = lambda *p, **k: {r.node: r.hop for r in R.trace(edge, start, *p, **k).collect()}
    assert got("downstream", 3, hub=5) == {"a": 0, "1": 1, "b": 1, "2": 2, "c": 2, "d": 2}
    assert got("upstream", 3) == {"a": 0, "3": 1, "z": 1}
    assert got("both", 2) == {"a": 0, "1": 1, "3": 1, "b": 1, "z": 1, "2": 2, "c": 2, "d": 2}
    assert got("both", 2, last=1) == {"a": 0, "1": 1, "b": 1}
    cut = R.trace(edge, start, "downstream", 3, max_nodes=3, hub=5).collect()
    assert sorted(r.node for r in cut) == ["1", "a", "b"] and all(r.truncated and r.nodes == 6 for r in cut)
    assert R.trace(edge, start.limit(0)).count() == 0


def test_walk_of_two_addresses(spark):
    edge = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), *[(3, f"h{i}") for i in range(4)], (3, "c")], "txid long, address string")
    seeds = spark.createDataFrame([("a",), ("absent",)], "vertex string")
    got = {r.address: r.score for r in R.personalised_rank(edge, seeds, rounds=60, hub=3).collect()}
    p = np.array([[0.5, 0.5, 0], [0.25, 0.5, 0.25], [0, 0.5, 0.5]])  # a, b, c over transactions 1 and 2
    r = np.linalg.solve(np.eye(3) - 0.7 * p.T, [0.3, 0, 0])
    assert got["a"] == 1 and np.allclose([got["b"], got["c"]], np.minimum(1, r[1:] / 0.3), atol=1e-6) and got["h0"] == 0


def test_walks_by_vectors_and_by_joins_are_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(t), f"v{a}" if a else None) for t, a in zip(rng.integers(0, 300, 900), rng.integers(0, 200, 900), strict=True)] + [(999, f"h{i}") for i in range(9)]
    edge = spark.createDataFrame(rows, "txid long, address string")
    seeds = spark.createDataFrame([("v1",), ("v7",), ("h2",)], "vertex string")
    found = {}
    for most in (0, 10**6):
        monkeypatch.setattr(R, "DENSE", most)
        got = R.personalised_rank(edge, seeds, rounds=6, hub=8)
        found[most] = {r.address: r.score for r in got.collect()}
    assert found[0] == found[10**6] and len(found[0]) == len({a for _, a in rows if a}) and found[0]["h2"] == 1 and found[0]["h1"] == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_digests_and_differences(spark):
    a = spark.createDataFrame([(i, float(i), "x" if i % 2 else None) for i in range(50)], "k long, v double, s string")
    same = {r["column"]: r.digest for r in golden.column_digests(a.repartition(7), ["v", "s"]).collect()}
    assert same == {r["column"]: r.digest for r in golden.column_digests(a, ["v", "s"]).collect()}
    moved = a.withColumn("v", F.when(F.col("k") == 3, 99.0).when(F.col("k") == 4, F.lit(None)).otherwise(F.col("v") + 1e-9)).where("k <> 7")
    r = golden.value_differences(a, moved, "k", {"v": 1e-6}).first()
    assert (r.compared, r.differing, r.only_one) == (49, 2, 1)
    assert golden.column_digests(a.limit(0), ["v"]).first().digest == 0
