import random
from collections import Counter

import pytest

from ledgerlens.operators.clusters import growing_clusters, size_counters, spending_links

NODE, LINK = "vertex string, at int", "src string, dst string, at int"


def standing(nodes, links, step):
    """Each vertex's cluster at the end of a step."""
    parent = {v: v for v, at in nodes if at <= step}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, at in links:
        if at <= step:
            parent[root(a)] = root(b)
    return {v: root(v) for v in parent}


@pytest.mark.parametrize("seed, steps", [(0, 1), (1, 2), (2, 13), (3, 30)])
def test_every_step_equals_brute_force(spark, seed, steps):
    rnd = random.Random(seed)
    at = {f"v{i}": rnd.randint(5, 4 + steps) for i in range(80)}
    at["v0"] = 5
    pairs = [(f"v{rnd.randrange(80)}", f"v{rnd.randrange(80)}") for _ in range(70)]
    links = [(a, b, min(4 + steps, max(at[a], at[b]) + rnd.choice([0, 0, 0, 3]))) for a, b in pairs if a != b]
    last = 4 + steps + 2  # steps after the last change
    g = growing_clusters(spark.createDataFrame(list(at.items()), NODE), spark.createDataFrame(links, LINK), last)
    got = {r.step: r for r in size_counters(g.sizes()).collect()}
    assert sorted(got) == list(range(5, last + 1))
    whole = {s: standing(at.items(), links, s) for s in got}
    for s, r in got.items():
        size = sorted(Counter(whole[s].values()).values(), reverse=True)
        assert (r.addresses, r.clusters, r.merges, r.largest, r.second) == (sum(size), len(size), sum(size) - len(size), size[0], size[1] if len(size) > 1 else None)
        assert r.coverage == pytest.approx(sum(x for x in size if x > 1) / sum(size), abs=1e-6)
    asked = [(v, rnd.randint(a, last)) for v, a in at.items()]
    found = {r.vertex: r.size for r in g.size_of(spark.createDataFrame(asked, NODE)).collect()}
    assert found == {v: Counter(whole[s].values())[whole[s][v]] for v, s in asked}


def test_links_of_both_kinds_and_none(spark):
    edge = spark.createDataFrame([(1, 1, "a", "in", 9.0, 2), (1, 2, "b", "in", 1.0, 2), (2, 1, "b", "in", 5.0, 4), (2, 2, "c", "in", 5.0, 4), (1, 3, "z", "out", 3.0, 2)], "txid long, pos int, address string, role string, amount double, step int")
    nodes, links = spending_links(edge)
    assert sorted(map(tuple, nodes.collect())) == [("a", 2), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, links.collect())) == [("a", "b", 2), ("b", "c", 4)]
    assert growing_clusters(nodes.limit(0), links.limit(0)) is None


def test_links_are_in_one_run_of_their_era(spark, monkeypatch):
    from ledgerlens.operators import clusters

    rows, found = [], clusters.connected_components

    def counted(edges, *ends):
        rows.append(edges.count())
        return found(edges, *ends)

    monkeypatch.setattr(clusters, "connected_components", counted)
    links = [(f"v{i}", f"v{i + 1}", 1) for i in range(0, 20, 2)]
    g = growing_clusters(spark.createDataFrame([(f"v{i}", 1) for i in range(20)], NODE), spark.createDataFrame(links, LINK), 16)
    assert {(r.step, r.size, r.n) for r in g.sizes().collect()} == {(s, 2, 10) for s in range(1, 17)}
    assert sum(rows) <= len(links) * (1 + g.width)  # not again for each later era
