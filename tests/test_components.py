import random

from ledgerlens.operators import components
from ledgerlens.operators.components import connected_components, joined_components, parted_components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in list(parent)}


def test_shapes(spark):
    rng = random.Random(1)
    star = [(0, i) for i in range(1, 3000)]
    path = [(10_000 + i, 10_001 + i) for i in range(250)]
    rand = [(20_000 + rng.randrange(600), 20_000 + rng.randrange(600)) for _ in range(400)]
    odd = [(None, 5), (7, None), (30_000, 30_000), (30_001, 30_002), (30_002, 30_001), (30_001, 30_002), (-5, 30_001)]
    edges = star + path + rand + odd
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.vertex: r.component_id for r in got.collect()} == brute(edges)
    assert got.count() == len(brute(edges))


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([("b", "b")], "src string, dst string")).collect()] == [("b", "b")]


def test_joining_components_after_more_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(200)]
    more = [(rng.randrange(700), rng.randrange(700)) for _ in range(150)] + [(None, 3), (3, None), (900, 900), (901, 902)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    got = joined_components(found, spark.createDataFrame(more, "src long, dst long"))
    want = brute(edges + more)
    assert {r.vertex: r.component_id for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "src long, dst long")
    assert {r.vertex: r.component_id for r in joined_components(found, none).collect()} == brute(edges)
    assert joined_components(connected_components(none), none).count() == 0


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 100)
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 800)] + [(1000 + i, 1001 + i) for i in range(900)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(900)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.vertex: r.component_id for r in got.collect()} == brute(edges)


def test_parts_settled_in_tasks_and_by_rounds_alike(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(p, f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for p in (1, 2, None) for _ in range(50)]
    edges += [(3, f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)] + [(4, "b", "b"), (4, None, "x"), (4, "a", "z"), (4, "a", "z")]
    df = spark.createDataFrame(edges, "part int, src string, dst string")
    want = {(p, v): c for p in (1, 2, 3, 4, None) for v, c in brute([(a, b) for q, a, b in edges if q == p]).items()}
    for most in (1000, 100, 30):
        monkeypatch.setattr(components, "PART_EDGES", most)
        rows = parted_components(df, "part").collect()
        assert {(r.part, r.vertex): r.component_id for r in rows} == want and len(rows) == len(want)
    assert parted_components(df.limit(0), "part").count() == 0
