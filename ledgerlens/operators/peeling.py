"""Chains of small-fan-out transactions: how many hops lead to each, and what an address sees of that.

A hop leads from a transaction to one of a later step that spends from an address which the first one pays. Only
transactions that pay two or three addresses take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import exact_quantiles
from ledgerlens.session import checkpoint

#: Fixed value: how many addresses a transaction of a chain pays.
FAN_OUT = (2, 3)
#: Fixed value: the depth from which on an address counts as part of a chain.
LEAST_DEPTH = 5


def chain_depths(edge: DataFrame, fan_out: tuple[int, ...] = FAN_OUT) -> DataFrame:
    """``txid, step, fan_out, depth, depth_single``: the longest chain that ends with each transaction of at least one hop.

    ``depth`` counts the transactions of a chain; for ``depth_single`` all but the first must spend from one address only.
    Seen from a step before its own a transaction has depth 1, as all hops to it land at its own step; so these depths are
    the snapshots of all steps.

    Round k keeps the transactions of depth k + 1 and more: those that spend from an address some time after a transaction of
    depth k first paid it. So a round is one minimum per address and no pairs of transactions are listed, however busy an
    address is; there are as many rounds as the longest chain has hops, over ever fewer rows.
    """
    sides = edge.select("txid", "address", "role", "step").distinct()
    count = lambda r: F.count(F.when(F.col("role") == r, 1))
    shape = sides.groupBy("txid").agg(F.min("step").alias("step"), count("out").alias("fan_out"), (count("in") == 1).alias("single")).where(F.col("fan_out").isin(*fan_out))
    shape = checkpoint(shape)
    own = sides.drop("step").join(shape, "txid")
    both = own.withColumn("single_only", F.explode(F.array(F.lit(False), F.lit(True))))
    # an address that no transaction of the other side has before or after can't be part of a hop
    span = own.groupBy("address").agg(F.min(F.when(F.col("role") == "out", F.col("step"))).alias("paid"), F.max(F.when(F.col("role") == "in", F.col("step"))).alias("spent"))
    linked = both.join(span, "address").where("paid < spent AND IF(role = 'out', step < spent, step > paid)").select("single_only", "txid", "address", "role", "step", "single")
    rows = checkpoint(linked)
    nodes = rows.where("NOT single_only").select("txid").distinct()
    key, reached, depth = ["single_only", "txid"], [], 1
    while not rows.isEmpty():
        reached.append(rows.select(*key).distinct().withColumn("depth", F.lit(depth)))
        since = rows.where("role = 'out'").groupBy("single_only", "address").agg(F.min("step").alias("since"))
        spends = rows.where("role = 'in' AND (NOT single_only OR single)")
        further = spends.join(since, ["single_only", "address"]).where("step > since").select(*key).distinct()
        rows, depth = checkpoint(rows.join(further, key, "left_semi")), depth + 1
    if not reached:
        return shape.limit(0).select("txid", "step", "fan_out", F.lit(1).alias("depth"), F.lit(1).alias("depth_single"))
    at = lambda single: F.max(F.when(F.col("single_only") == F.lit(single), F.col("depth")))
    found = reduce(DataFrame.unionByName, reached).groupBy("txid").agg(at(False).alias("depth"), at(True).alias("depth_single"))
    return nodes.join(shape, "txid").join(found, "txid", "left").select("txid", "step", "fan_out", F.coalesce("depth", F.lit(1)).alias("depth"), F.coalesce("depth_single", F.lit(1)).alias("depth_single"))


def chain_features(edge: DataFrame, depths: DataFrame, totals: DataFrame, cutoff: DataFrame, least: int = LEAST_DEPTH) -> DataFrame:
    """What each address (``cutoff``: address, cutoff) sees of chains as of its own step.

    ``totals``: txid, in_total, out_total. An address is in a chain if it is an input or output of a transaction of depth
    ``least`` or more. The retained share of value is given only where chains of single inputs make it attributable.
    """
    member = edge.select("address", "txid", "role").distinct().join(cutoff, "address").join(depths, "txid").where(F.col("cutoff").isNotNull())
    seen = checkpoint(member.where(F.col("step") <= F.col("cutoff")).where(F.col("depth") >= least))
    steps = seen.select("address", "step").distinct()
    gap = (F.col("step") - F.lag("step").over(W.partitionBy("address").orderBy("step"))).alias("gap")
    gaps = steps.select("address", gap).groupBy("address").agg(F.median("gap").cast("double").alias("hop_gap_median"))
    grouped = seen.groupBy("address").agg(
        F.max("depth").alias("chain_depth_max"), F.min("depth").alias("position_in_chain"), F.count("*").alias("chain_count"), F.avg("fan_out").alias("chain_fanout_mean"), (F.max("depth_single") >= least).alias("value_retention_available")
    )
    ratio = seen.where(F.col("depth_single") >= least).join(totals, "txid").select("address", (F.col("out_total") / F.when(F.col("in_total") != 0, F.col("in_total"))).alias("ratio"))
    kept = exact_quantiles(ratio, "ratio", [0.5], by=["address"]).select("address", F.col("quantiles")[0].alias("value_retention_ratio"))
    out = cutoff.select("address").distinct().join(grouped, "address", "left").join(gaps, "address", "left").join(kept, "address", "left")
    none = lambda c, value: F.coalesce(c, F.lit(value)).alias(c)
    return out.select(
        "address", F.col("chain_depth_max").isNotNull().alias("in_chain"), none("chain_depth_max", 0), none("position_in_chain", 0), none("chain_count", 0),
        F.round("chain_fanout_mean", 6).alias("chain_fanout_mean"), "hop_gap_median", F.round("value_retention_ratio", 6).alias("value_retention_ratio"), none("value_retention_available", False),
    )
