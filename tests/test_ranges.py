import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import ranges


def test_running_sums_and_places(spark):
    rng = random.Random(1)
    rows = [(f"k{i:04d}" if i else None, rng.randrange(-5, 9)) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n long")
    got = {r.k: (r.upto, r.place) for r in ranges.places(ranges.running_sums(df, ["k"], {"upto": "n"}), ["k"]).collect()}
    want, total = {}, 0
    for p, (k, n) in enumerate(sorted(rows, key=lambda r: r[0] or ""), 1):
        total += n
        want[k] = (total, p)
    assert got == want
    assert ranges.running_sums(df.limit(0), ["k"], {"upto": "n"}).count() == 0
    plan = ranges.running_sums(df, ["k"], {"upto": "n"}, descending=True)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("Window")[1]


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, v) for g in "abc" for v in [rng.choice([1.5, 2.5, rng.random()]) for _ in range(rng.randrange(1, 400))]] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0, 0.1, 0.5, 0.9, 1]
    for r in ranges.exact_quantiles(df, "v", shares, ["g"]).collect():
        assert np.allclose(r.quantiles, np.quantile([v for g, v in rows if g == r.g and v is not None], shares))
    assert np.allclose(ranges.exact_quantiles(df, "v", shares).first().quantiles, np.quantile([v for _, v in rows if v is not None], shares))
    assert ranges.exact_quantiles(df.where(F.lit(False)), "v", [0.5]).first().quantiles == [None]


def test_places_shuffle_once(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in range(900)], "k string, n long")
    plan = ranges.places(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Join")[0] and "LogicalRDD [k#" in plan
    small = spark.createDataFrame([("b",), ("a",)], "k string")
    assert [(r.k, r.place) for r in ranges.places(small, ["k"]).orderBy("place").collect()] == [("a", 1), ("b", 2)] and ranges.places(small.limit(0), ["k"]).count() == 0
