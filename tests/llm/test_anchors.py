import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import anchors, queries

FIELDS = "vec_id bigint, embedding array<float>, label int"


def nearest(x, book):
    return ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([r[1] for r in kept], dtype=np.float64)).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            e = nearest(x[:, p], books[p])
            for i in set(e.tolist()):
                books[p, i] = x[e == i, p].sum(axis=0) // (e == i).sum()
    e = np.stack([nearest(x[:, p], books[p]) for p in range(parts)], axis=1)
    error = sum(((x[:, p] - books[p][e[:, p]]) ** 2).sum(axis=1) for p in range(parts)).tolist()
    total = defaultdict(int)
    for r, d in zip(kept, error, strict=True):
        total[r[2]] += d
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((-1 if r[0] is None else r[0], "".join(f"{i:02x}" for i in c), d, total[r[2]], sha) for r, c, d in zip(kept, e.tolist(), error, strict=True))


def got(df, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in anchors.codes(df, **options).collect())


@pytest.mark.parametrize("seed", range(5))
def test_balls_hold_their_points_and_give_them_to_the_nearest(seed):
    rnd = np.random.default_rng(seed)
    points = (rnd.normal(size=(3000, 4)) * (3 if seed % 2 else 60)).astype(np.int32)  # with few values: many ties
    points[:800] = points[0]
    made = anchors.Balls.of(points)
    assert sorted(made.order.tolist()) == list(range(len(points)))
    for (a, b, left, right), centre, radius, sums in zip(made.spans.tolist(), made.centres, made.radii, made.sums, strict=True):
        own = points[made.order[a:b]].astype(np.int64)
        assert (own.sum(axis=0) == sums).all() and np.sqrt(((own - centre) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-9)
        assert (left < 0) == (right < 0) and (left < 0 or made.spans[left][1] == made.spans[right][0])
    book = points[rnd.integers(0, len(points), 64)].astype(np.int64)
    own, sums, counts = made.owned(points, book)
    want = nearest(points.astype(np.int64), book)
    assert (own == want).all() and (counts == np.bincount(want, minlength=64)).all()
    assert all((sums[i] == points[want == i].astype(np.int64).sum(axis=0)).all() for i in range(64))


def test_a_far_ball_is_owned_as_a_whole():
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.integers(-20, 20, (400, 4)) + 1000 * i for i in range(5)]).astype(np.int32)
    made, book = anchors.Balls.of(points), np.array([[1000 * i] * 4 for i in range(5)])
    assert (made.owned(points, book)[2] == 400).all()
    open_leaves = [s for s in made.spans.tolist() if s[2] < 0 and len(np.unique(nearest(points[made.order[s[0] : s[1]]].astype(np.int64), book))) > 1]
    assert open_leaves == []


def rows_of(seed, n, width=32):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), (rnd.normal(size=width) / 5).astype(np.float32).tolist(), int(i) % 7 if i % 5 else None) for i in rnd.permutation(n)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_ROWS", 100)
    rows = rows_of(3, 500)
    rows += [(900 + i, rows[0][1], 3) for i in range(200)]  # many copies
    rows += [(5, rows[1][1], 2), (5, rows[1][1], 2), (None, rows[2][1], 1)]  # repeats, no id
    bad = [(700, None, 1), (701, [], 1), (702, [None] + rows[0][1][1:], 1), (703, [float("nan")] + rows[0][1][1:], 1), (704, [float("-inf")] + rows[0][1][1:], 1)]
    df = spark.createDataFrame(rows + bad, FIELDS).withColumns({"code": F.lit("clash"), "points": F.lit(1), "error": F.lit(2)})
    assert got(df) == brute(rows)


def test_few_rows_and_ties(spark):
    flat = [(i, [float(i % 3) / 256] * 16, None) for i in range(20)]
    assert got(spark.createDataFrame(flat, FIELDS)) == brute(flat)
    one = [(3, [0.5] * 16, 1)]
    assert got(spark.createDataFrame(one, FIELDS), entries=4, rounds=1) == brute(one, entries=4, rounds=1)
    assert got(spark.createDataFrame([(9, [1.0] * 32, 1), (3, [0.5] * 16, 1)], FIELDS)) == brute([(9, [1.0] * 32, 1)])  # another length is left out


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 2)], [(1, [float("nan")], None)]):
        assert got(spark.createDataFrame(rows, FIELDS)) == []


def test_what_cannot_be_exact_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark.createDataFrame([(1, [1e9] * 16, 1)], FIELDS))
    with pytest.raises(ValueError, match="divide"):
        got(spark.createDataFrame([(1, [1.0] * 17, 1)], FIELDS))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_codes(spark, sf_dir).collect()) == brute(rows)
