"""Per-address aggregates and windows over transaction edges. Missing stays null: a sum over nothing is not zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.neighbourhoods import shut_pairs
from ledgerlens.operators.ranges import exact_quantiles
from ledgerlens.session import checkpoint


def _of(role: str, column: str = "amount"):
    return F.when(F.col("role") == role, F.col(column))


def address_profile(edge: DataFrame, tx: DataFrame) -> DataFrame:
    """Counts, flows, fee ratios and rate of each address; rates count one second at least."""
    ratio = tx.select("txid", (F.col("fee") / F.when(F.col("in_total") > 0, F.col("in_total"))).alias("fee_ratio"))
    seconds = F.greatest(F.max("ts").cast("long") - F.min("ts").cast("long"), F.lit(1))
    out = edge.join(ratio, "txid").groupBy("address").agg(
        F.count_distinct("txid").alias("n_txs"), F.count(_of("in")).alias("n_in"), F.count(_of("out")).alias("n_out"), F.round(F.sum(_of("in")), 2).alias("sent"), F.round(F.sum(_of("out")), 2).alias("received"),
        F.round(F.coalesce(F.sum(_of("out")), F.lit(0.0)) - F.coalesce(F.sum(_of("in")), F.lit(0.0)), 2).alias("net"), F.round(F.avg("fee_ratio"), 6).alias("mean_fee_ratio"), F.round(F.max("fee_ratio"), 6).alias("max_fee_ratio"), seconds.alias("seconds"),
    )
    return out.withColumn("tx_per_hour", F.round(F.col("n_txs") * 3600.0 / F.col("seconds"), 8)).drop("seconds")


def behaviour(edge: DataFrame) -> DataFrame:
    """Two-role behaviour as of each address's last step."""
    steps = edge.groupBy("address").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count_distinct("step").alias("active_steps"))
    roles = edge.groupBy("address").agg(*[f(_of(r)).alias(f"{r}_{n}") for r in ("in", "out") for n, f in (("count", F.count), ("min", F.min), ("max", F.max))], *[F.round(F.avg(_of(r)), 6).alias(f"{r}_mean") for r in ("in", "out")])
    return steps.join(roles, "address").join(step_gaps(edge), "address", "left").withColumn("span", F.col("last_step") - F.col("first_step") + 1)


def step_gaps(edge: DataFrame) -> DataFrame:
    """Mean, largest and median gap between the steps in which an address is active; none for a single step."""
    steps = edge.select("address", "step").distinct()
    gap = F.col("step") - F.lag("step").over(W.partitionBy("address").orderBy("step"))
    return steps.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("address").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"))


def first_last(edge: DataFrame) -> DataFrame:
    return edge.groupBy("address").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def tx_degree(edge: DataFrame) -> DataFrame:
    return edge.select("address", "txid").distinct().groupBy("address").agg(F.count("*").alias("degree"))


def flows(edge: DataFrame, most_pairs: int = 10_000) -> DataFrame:
    """Payer and payee of each transaction, distinct; transactions of more pairs than ``most_pairs`` say nothing and are left out."""
    size = edge.groupBy("txid").agg(F.count(_of("in")).alias("i"), F.count(_of("out")).alias("o")).where((F.col("i") > 0) & (F.col("o") > 0) & (F.col("i") * F.col("o") <= most_pairs)).select("txid")
    kept = edge.join(size, "txid")
    ins = kept.where("role = 'in'").select("txid", "step", F.col("address").alias("payer")).distinct()
    outs = kept.where("role = 'out'").groupBy("txid", F.col("address").alias("payee")).agg(F.sum("amount").alias("amount"))
    return ins.join(outs, "txid").where("payer <> payee")


def counterparties(edge: DataFrame) -> DataFrame:
    """Degrees by counterparty and value of each address."""
    f = flows(edge)
    paid = f.groupBy(F.col("payer").alias("address")).agg(F.count_distinct("payee").alias("out_degree"), F.round(F.sum("amount"), 2).alias("out_value"))
    got = f.groupBy(F.col("payee").alias("address")).agg(F.count_distinct("payer").alias("in_degree"), F.round(F.sum("amount"), 2).alias("in_value"))
    return paid.join(got, "address", "full_outer")


def top_counterparties(edge: DataFrame, k: int = 3) -> DataFrame:
    best = W.partitionBy("payer").orderBy(F.desc("amount"), "payee")
    pairs = flows(edge).groupBy("payer", "payee").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n_txs"))
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def local_clustering(edge: DataFrame) -> DataFrame:
    """Share of an address's neighbour pairs that deal with each other, by edges known at its last step; null under two neighbours.

    Triangles are found in blocks of addresses (``neighbourhoods``), without a row for each pair of neighbours. An address's own
    edges are all known at its last step.
    """
    f = flows(edge)
    und = checkpoint(f.select(F.least("payer", "payee").alias("u"), F.greatest("payer", "payee").alias("v"), "step").groupBy("u", "v").agg(F.min("step").alias("since")))
    k = F.col("k")
    value = F.when(k >= 2, F.round(2.0 * F.col("links") / (k * (k - 1)), 6))
    return shut_pairs(und, first_last(edge).select(F.col("address").alias("u"), "last_step")).select(F.col("u").alias("address"), "k", value.alias("clustering"))


def last_snapshot(edge: DataFrame) -> DataFrame:
    """The whole last row of each address, by time, transaction and place."""
    row = F.max_by(F.struct("txid", "pos", "role", "amount", "step"), F.struct("ts", "txid", "pos", "amount", "role"))
    return edge.groupBy("address").agg(row.alias("r")).select("address", "r.txid", "r.pos", "r.role", "r.amount", "r.step")


def _medians(df: DataFrame, features: tuple[str, ...], name: str) -> DataFrame:
    """One row of the features' exact medians, found by ranges of their values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    found = exact_quantiles(long, "value", [0.5], ["feature"])
    return found.agg(*[F.max(F.when(F.col("feature") == f, F.get("quantiles", F.lit(0)))).alias(f"{name}_{f}") for f in features])


def robust_anomalies(profile: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """One-sided modified z-scores against the median (Iglewicz and Hoaglin 1993), joined into ``1 - exp(-z / 2)``.

    A median deviation of zero gives way to 1.2533 mean deviations, and that to 1. Two small aggregates are joined back.
    """
    profile = checkpoint(profile)
    mid = _medians(profile, features, "m")
    away = profile.join(F.broadcast(mid)).select(*[F.abs(F.col(f) - F.col(f"m_{f}")).alias(f) for f in features])
    scale = away.agg(*[F.avg(f).alias(f"a_{f}") for f in features]).join(F.broadcast(_medians(away, features, "d")))
    out = profile.join(F.broadcast(mid)).join(F.broadcast(scale))
    z = lambda f: F.greatest(F.lit(0.0), F.when(F.col(f"d_{f}") > 0, 0.6745 * (F.col(f) - F.col(f"m_{f}")) / F.col(f"d_{f}")).otherwise((F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"a_{f}") > 0, 1.2533 * F.col(f"a_{f}")).otherwise(1.0)))
    total = F.sqrt(sum((F.coalesce(z(f), F.lit(0.0)) ** 2 for f in features), F.lit(0.0)))
    return out.select("address", F.round(1 - F.exp(-total / 2), 6).alias("anomaly"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index by the reference's quantile bins; shares under ``floor`` count as it."""
    cuts = exact_quantiles(reference, column, [i / bins for i in range(1, bins)]).withColumnRenamed("quantiles", "cuts")
    place = lambda df: df.where(F.col(column).isNotNull()).join(F.broadcast(cuts)).select(F.size(F.filter("cuts", lambda c: c < F.col(column))).alias("bin"))
    count = lambda df, n: place(df).groupBy("bin").agg(F.count("*").alias(n))
    both = count(reference, "e").join(count(current, "o"), "bin", "full_outer")
    share = lambda n: F.greatest(F.lit(floor), F.coalesce(F.col(n), F.lit(0)) / F.sum(n).over(W.partitionBy()))
    return both.select("bin", share("e").alias("expected"), share("o").alias("observed")).select("bin", F.round("expected", 6).alias("expected"), F.round("observed", 6).alias("observed"), F.round((F.col("observed") - F.col("expected")) * F.log(F.col("observed") / F.col("expected")), 6).alias("psi"))
