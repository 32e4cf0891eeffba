"""Arrivals of announcements at observers, and how far transactions and announcements correlate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import exact_quantiles, running_sums


def arrivals(obs: DataFrame) -> DataFrame:
    """First arrival of each transaction at each observer, its offset from the first, rank (ties by observer) and spread."""
    first = obs.where("ms IS NOT NULL").groupBy("txid", "observer").agg(F.min("ms").alias("ms"))
    tx = W.partitionBy("txid")
    return first.withColumn("offset_ms", F.col("ms") - F.min("ms").over(tx)).withColumn("rank", F.row_number().over(tx.orderBy("ms", "observer"))).withColumn("spread_ms", F.max("ms").over(tx) - F.min("ms").over(tx))


def broadcasters(obs: DataFrame, share: float = 0.5) -> DataFrame:
    """Peers that announce at least this share of all transactions."""
    total = obs.agg(F.count_distinct("txid").alias("total"))
    return obs.groupBy("peer").agg(F.count_distinct("txid").alias("n")).join(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("peer")


def evidence_class(obs: DataFrame, least_observers: int = 3, flat_ms: int = 250, share: float = 0.5) -> DataFrame:
    """USABLE or why not: announced by a known broadcaster, then too few observers, then a flat arrival."""
    facts = arrivals(obs).groupBy("txid").agg(F.count("*").alias("observers"), F.max("spread_ms").alias("spread_ms"))
    loud = obs.join(F.broadcast(broadcasters(obs, share)), "peer", "left_semi").select("txid").distinct().withColumn("loud", F.lit(True))
    kind = F.when(F.col("loud"), "broadcaster").when(F.col("observers") < least_observers, "too_few").when(F.col("spread_ms") <= flat_ms, "flat").otherwise("USABLE")
    return facts.join(loud, "txid", "left").select("txid", "observers", "spread_ms", kind.alias("evidence"))


def propagation(obs: DataFrame) -> DataFrame:
    """Facts of each transaction's spread: first and last time, first peer, peers, observers, share of the most frequent peer."""
    per_peer = obs.groupBy("txid", "peer").agg(F.count("*").alias("n"), F.min("ms").alias("first"), F.max("ms").alias("last"))
    facts = per_peer.groupBy("txid").agg(F.sum("n").alias("announcements"), F.count("*").alias("peers"), F.min("first").alias("first_ms"), F.max("last").alias("last_ms"), F.min(F.struct("first", "peer")).alias("f"), F.max(F.struct("n", (-F.col("peer")).alias("p"))).alias("d"))
    seen = obs.groupBy("txid").agg(F.count_distinct("observer").alias("observers"))
    return facts.join(seen, "txid").select("txid", "announcements", "peers", "observers", "first_ms", "last_ms", F.when(F.col("announcements") >= 2, F.col("last_ms") - F.col("first_ms")).alias("spread_ms"), F.col("f.peer").alias("first_peer"), (-F.col("d.p")).alias("dominant_peer"), F.round(F.col("d.n") / F.col("announcements"), 6).alias("dominant_share"))


def pooled(obs: DataFrame, by: str = "observer") -> DataFrame:
    """Per group: transactions, peers, and the upper median of the transactions' spreads there."""
    each = obs.groupBy(by, "txid").agg((F.max("ms") - F.min("ms")).alias("spread"), F.count("*").alias("n"))
    counted = running_sums(each.groupBy(by, "spread").agg(F.count("*").alias("c"), F.sum("n").alias("n")), [by, "spread"], {"upto": "c"})
    before = F.col("upto") - F.col("c")
    sums = counted.groupBy(by).agg(F.sum("c").alias("n_txs"), F.sum("n").alias("announcements"), F.min(before).alias("start"))
    at = F.floor(F.col("n_txs") / 2) + F.col("start")
    middle = counted.drop("n").join(F.broadcast(sums), by).groupBy(by, "n_txs", "announcements").agg(F.max(F.when((before <= at) & (at < F.col("upto")), F.col("spread"))).alias("median_spread_ms"))
    return middle.join(obs.groupBy(by).agg(F.count_distinct("peer").alias("peers")), by)


def arrival_summary(obs: DataFrame) -> DataFrame:
    """How often each observer is first, over all transactions, and percentiles of its offsets."""
    a = arrivals(obs)
    out = a.groupBy("observer").agg(F.count("*").alias("n_txs"), F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("n_first"), F.round(F.avg(F.when(F.col("spread_ms") <= 250, 1.0).otherwise(0.0)), 6).alias("flat_share"))
    q = exact_quantiles(a, "offset_ms", [0.5, 0.9], ["observer"])
    return out.join(q, "observer").select("observer", "n_txs", "n_first", F.round(F.get("quantiles", F.lit(0)), 3).alias("p50"), F.round(F.get("quantiles", F.lit(1)), 3).alias("p90"), "flat_share")


def correlate(tx: DataFrame, obs: DataFrame) -> DataFrame:
    """Each transaction id of either layer: CORRELATED, NO_NETWORK or UNMATCHED."""
    seen = obs.groupBy("txid").agg(F.count("*").alias("announcements")).withColumnRenamed("txid", "seen")
    both = tx.select("txid").join(seen, F.col("txid") == F.col("seen"), "full_outer")
    kind = F.when(F.col("txid").isNull(), "UNMATCHED").when(F.col("seen").isNull(), "NO_NETWORK").otherwise("CORRELATED")
    return both.select(F.coalesce("txid", "seen").alias("txid"), kind.alias("status"), F.coalesce("announcements", F.lit(0)).alias("announcements"))


def overlap(tx: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed ids, how many of them the chain has, and their share; the guard is a filter on the share."""
    ids = obs.where("txid IS NOT NULL").select("txid").distinct()
    hit = tx.select("txid").distinct().withColumn("hit", F.lit(1))
    return ids.join(hit, "txid", "left").agg(F.count("*").alias("observed"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


def range_lookup(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The owner of the range ``[lo, hi]`` that holds each ``ip``, or null; ranges don't overlap.

    Ranges and points meet in blocks of addresses, an equi-join that AQE can split, instead of a join on inequalities.
    """
    block = lambda c: F.floor(F.col(c) / 4096)
    spread = ranges.select("lo", "hi", "owner", F.explode(F.sequence(block("lo"), block("hi"))).alias("block"))
    both = points.select(F.col("ip"), block("ip").alias("block")).distinct().join(spread, "block", "left")
    best = both.groupBy("ip").agg(F.max(F.when(F.col("lo") <= F.col("ip"), F.struct("lo", "hi", "owner"))).alias("r"))
    return best.select("ip", F.when(F.col("r.hi") >= F.col("ip"), F.col("r.owner")).alias("owner"))
