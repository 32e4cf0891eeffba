from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from ledgerlens.operators import contributions as Q
from ledgerlens.plans import catalog, graphs, more  # noqa: F401


def value(tree, cover, x, known, node=0):
    """A tree's value with only some features known, both ways weighted at the others."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node] * tree.weight
    ways = [tree.left[node], tree.right[node]]
    if f in known:
        return value(tree, cover, x, known, ways[0] if x[f] <= tree.threshold[node] else ways[1])
    return sum(cover[w] / cover[node] * value(tree, cover, x, known, w) for w in ways)


def grown(rnd, depth, features, x):
    """A random tree with the covers of the rows x."""
    tree = Q.Tree([], [], [], [], [], float(rnd.uniform(0.2, 1)))
    cover = []

    def grow(rows, left):
        node = len(tree.feature)
        f = int(rnd.integers(features))
        split = left > 0 and len(np.unique(rows[:, f])) > 1
        t = float(np.median(rows[:, f])) if split else 0.0
        if split and (rows[:, f] <= t).all():
            t = float(np.unique(rows[:, f])[-2])
        tree.feature.append(f if split else -1)
        tree.threshold.append(t)
        tree.value.append(float(rnd.normal()))
        tree.left.append(-1)
        tree.right.append(-1)
        cover.append(float(len(rows)))
        if split:
            tree.left[node] = grow(rows[rows[:, f] <= t], left - 1)
            tree.right[node] = grow(rows[rows[:, f] > t], left - 1)
        return node

    grow(x, depth)
    return tree, cover


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_all_subsets(seed):
    rnd = np.random.default_rng(seed)
    n = 4
    x = rnd.integers(0, 9, (200, n)).astype(float)
    made = [grown(rnd, 4, n, x) for _ in range(3)]  # features come back on one path
    got, base = Q.shapley(x[:20], [p for t, c in made for p in t.paths(c)])
    total = lambda row, known: sum(value(t, c, row, known) for t, c in made)
    assert base == pytest.approx(total(x[0], ()))
    for row, own in zip(x, got):
        for i in range(n):
            others = [j for j in range(n) if j != i]
            want = sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (total(row, {*s, i}) - total(row, s)) for k in range(n) for s in combinations(others, k))
            assert own[i] == pytest.approx(want, abs=1e-9)
        assert base + own.sum() == pytest.approx(total(row, range(n)))
    for t, c in made:
        assert (np.bincount(t.leaves(x), minlength=len(c))[np.array(t.feature) < 0] == np.array(c)[np.array(t.feature) < 0]).all()


def test_contributions_add_up_to_the_models_score(spark, sf_dir):
    rows, model = more.risk_model(spark, sf_dir)
    got = Q.contributions(rows, model, rows.where("fold > 0"), more.RISK_FEATURES, ["address"])
    raw = {r.address: r.m for r in model.transform(rows).select("address", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    found = got.collect()
    assert len(found) == len(raw) > 100
    assert all(r.raw == pytest.approx(raw[r.address], abs=1e-9) for r in found)
    assert max(abs(r[f"c_{f}"]) for r in found for f in more.RISK_FEATURES) > 0.01
    assert len({round(r.base_value, 9) for r in found}) == 1


def test_no_rows_and_nulls(spark, sf_dir):
    rows, model = more.risk_model(spark, sf_dir)
    assert Q.contributions(rows.limit(0), model, rows, more.RISK_FEATURES, ["address"]).count() == 0
    odd = rows.limit(1).selectExpr("address", *[f"CAST(NULL AS DOUBLE) AS {f}" for f in more.RISK_FEATURES])
    assert Q.contributions(odd, model, rows, more.RISK_FEATURES, ["address"]).first().raw is not None
