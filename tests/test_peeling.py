import random
from collections import defaultdict
from statistics import median

import pytest

from ledgerlens.operators.peeling import chain_depths, chain_features

EDGE = "txid long, address string, role string, step int"


def snapshot(rows, limit):
    """``{txid: (depth, depth with single inputs)}`` of all transactions of a hop, by all hops that have landed at ``limit``."""
    outs, ins, step = defaultdict(set), defaultdict(set), {}
    for tx, a, role, s in rows:
        (outs if role == "out" else ins)[tx].add(a)
        step[tx] = s
    fit = [t for t in step if len(outs[t]) in (2, 3)]
    hops = sorted((step[b], a, b) for a in fit for b in fit if step[b] > step[a] and outs[a] & ins[b])
    depth = {t: [1, 1] for _, a, b in hops for t in (a, b)}
    for at, a, b in hops:
        if at <= limit:
            depth[b][0] = max(depth[b][0], depth[a][0] + 1)
            if len(ins[b]) == 1:
                depth[b][1] = max(depth[b][1], depth[a][1] + 1)
    return {t: tuple(d) for t, d in depth.items()}


def table(seed, n=120, addresses=25, steps=12):
    rnd = random.Random(seed)
    rows = []
    for tx in range(n):
        s = rnd.randint(1, steps)
        rows += [(tx, f"a{rnd.randrange(addresses)}", "in", s) for _ in range(rnd.choice([1, 1, 1, 2, 3]))]
        rows += [(tx, f"a{rnd.randrange(addresses)}", "out", s) for _ in range(rnd.choice([1, 2, 2, 3, 4]))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_depths_equal_brute_force(spark, seed):
    rows = table(seed, addresses=15 if seed else 60)
    got = {r.txid: (r.depth, r.depth_single) for r in chain_depths(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == snapshot(rows, 99)
    step = {r[0]: r[3] for r in rows}
    for limit in (1, 4, 8):  # a snapshot is the last depth of what has landed, and 1 for the rest
        assert snapshot(rows, limit) == {t: d if step[t] <= limit else (1, 1) for t, d in got.items()}


def test_a_busy_address_lists_no_pairs(spark):
    """400 transactions pay one address and 400 later ones spend from it: two rounds, and no row for each of 160,000 pairs."""
    rows = [r for t in range(400) for r in ((t, f"p{t}", "in", 1), (t, "hub", "out", 1), (t, f"c{t}", "out", 1))]
    rows += [r for t in range(400, 800) for r in ((t, "hub", "in", 2), (t, f"x{t}", "out", 2), (t, f"y{t}", "out", 2))]
    got = chain_depths(spark.createDataFrame(rows, EDGE)).collect()
    assert sorted((r.txid, r.depth) for r in got) == [(t, 1 + (t >= 400)) for t in range(800)]


def test_nothing_to_chain(spark):
    for rows in ([], [(1, "a", "out", 1), (1, "b", "out", 1)], [(1, None, "in", 1), (1, None, "out", None)]):
        assert chain_depths(spark.createDataFrame(rows, EDGE)).collect() == []


def test_features_as_of_each_addresss_own_step(spark):
    rows = table(7, n=200, addresses=12)
    e = spark.createDataFrame(rows, EDGE)
    rnd = random.Random(8)
    cut = {a: rnd.randint(1, 14) for a in sorted({r[1] for r in rows})} | {"unseen": 3}
    money = {t: (float(rnd.randint(0, 3)), float(rnd.randint(1, 9))) for t in {r[0] for r in rows}}
    totals = spark.createDataFrame([(t, i, o) for t, (i, o) in money.items()], "txid long, in_total double, out_total double")
    got = {r.address: r for r in chain_features(e, chain_depths(e), totals, spark.createDataFrame(list(cut.items()), "address string, cutoff int"), least=3).collect()}
    fan = {t: len({a for x, a, r, _ in rows if x == t and r == "out"}) for t in money}
    step = {r[0]: r[3] for r in rows}
    assert set(got) == set(cut)
    for a, c in cut.items():
        depth = snapshot(rows, c)
        seen = sorted({(t, role) for t, b, role, _ in rows if b == a and t in depth and depth[t][0] >= 3})
        r = got[a]
        assert r.in_chain == bool(seen) and r.chain_count == len(seen)
        if not seen:
            assert (r.chain_depth_max, r.position_in_chain, r.chain_fanout_mean, r.hop_gap_median, r.value_retention_ratio, r.value_retention_available) == (0, 0, None, None, None, False)
            continue
        assert (r.chain_depth_max, r.position_in_chain) == (max(depth[t][0] for t, _ in seen), min(depth[t][0] for t, _ in seen))
        assert r.chain_fanout_mean == pytest.approx(sum(fan[t] for t, _ in seen) / len(seen), abs=1e-6)
        at = sorted({step[t] for t, _ in seen})
        assert r.hop_gap_median == (median(b - x for x, b in zip(at, at[1:])) if len(at) > 1 else None)
        ratios = [money[t][1] / money[t][0] for t, _ in seen if depth[t][1] >= 3 and money[t][0]]
        assert r.value_retention_available == any(depth[t][1] >= 3 for t, _ in seen)
        assert r.value_retention_ratio == (pytest.approx(median(ratios), abs=1e-6) if ratios else None)
