import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import minhash, queries


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    """Components by an inverted index over all pairs that share a shingle."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for p, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(p)
    pairs = {(a, b) for ps in index.values() for a in ps for b in ps if a < b}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        both = len(x & y)
        if i is not None and j is not None and 100 * both >= percent * (len(x) + len(y) - both):
            i, j = sorted((root(i), root(j)))
            parent[j] = i
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None else -1) for i, s in sets)


def got(df, **k):
    rows = minhash.near_duplicates(df, **k).collect()
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in rows)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in rows)


def test_whole_tables_against_all_pairs(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        found = queries.op4_near_dups(spark, d).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 3, 85)


def test_families_and_edges(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(250):  # one family with few and many edits
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    rows += [(i, t) for i, t in enumerate([None, "", " \t\n", "one", "ONE", "one two", "One\x0bTWO ", "one two three", "one two three four", "é É", "x " * 50_000, "y", "y"])]
    rows += [(None, "one two three"), (3, "other words for this id"), (3, "one"), (77, " ".join(base)), (77, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("rep", F.lit("clash"))
    assert got(df) == brute(rows, 3, 85)
    assert got(df, width=5, percent=80) == brute(rows, 5, 80)
    assert got(df.limit(0)) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared, n in ((90, 100), (50, 100), (3, 4), (1, 1)):
        hits = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.int64).astype(np.uint64)
            a, b = minhash.superminhash([x[:n], x[n - shared :]], 88)
            hits.append((a == b).mean())
            assert len({v >> np.uint64(32) for v in a}) >= 1 and (a < np.uint64(88 << 32)).all()
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.05
