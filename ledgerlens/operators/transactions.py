"""Shapes, hops and mixing patterns of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(high: Column, low: Column, mean: Column) -> Column:
    return F.when(mean > 0, (high - low) / mean)


def shapes(tx: DataFrame) -> DataFrame:
    """Counts, totals and relative spreads of both sides."""
    return tx.select("txid", "step", "n_in", "n_out", F.round("in_total", 2).alias("in_total"), F.round("out_total", 2).alias("out_total"), F.round("fee", 2).alias("fee"), F.round(spread(F.col("in_max"), F.col("in_min"), F.col("in_mean")), 6).alias("in_spread"), F.round(spread(F.col("out_max"), F.col("out_min"), F.col("out_mean")), 6).alias("out_spread"))


def output_entropy(edge: DataFrame) -> DataFrame:
    """Shannon bits of the shares of a transaction's outputs."""
    outs = edge.where("role = 'out' AND amount > 0").withColumn("share", F.col("amount") / F.sum("amount").over(W.partitionBy("txid")))
    return outs.groupBy("txid").agg(F.round(F.abs(-F.sum(F.col("share") * F.log2("share"))), 6).alias("bits"))


def star_edges(edge: DataFrame) -> DataFrame:
    """The first input address of each transaction to each other one: k - 1 edges instead of all pairs."""
    ins = edge.where("role = 'in'").groupBy("txid", "step", "address").agg(F.min("pos").alias("pos"))
    first = F.first("address").over(W.partitionBy("txid").orderBy("pos", "address"))
    return ins.withColumn("center", first).where("center <> address").select("txid", "step", "center", "address")


def hop_pairs(edge: DataFrame) -> DataFrame:
    """Each later transaction that spends from an address that a transaction paid; distinct pairs."""
    outs = edge.where("role = 'out'").select("address", F.col("txid").alias("src"), F.col("step").alias("src_step")).distinct()
    ins = edge.where("role = 'in'").select("address", F.col("txid").alias("dst"), F.col("step").alias("dst_step")).distinct()
    return outs.join(ins, "address").where("dst_step > src_step AND src <> dst").groupBy("src", "dst").agg(F.min(F.col("dst_step") - F.col("src_step")).alias("gap"), F.min("address").alias("via"))


def hop_summary(edge: DataFrame) -> DataFrame:
    return hop_pairs(edge).groupBy("src").agg(F.count("*").alias("n_next"), F.min("gap").alias("nearest_gap"), F.max("gap").alias("farthest_gap"))


def modal_output(edge: DataFrame) -> DataFrame:
    """The most frequent output amount of each transaction, and on ties the one that comes first."""
    counts = edge.where("role = 'out'").groupBy("txid", "amount").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return counts.groupBy("txid").agg(F.max_by("amount", F.struct("n", -F.col("pos"), -F.col("amount"))).alias("amount"), F.max("n").alias("n_equal"))


def mixing_shapes(tx: DataFrame, edge: DataFrame) -> DataFrame:
    """Equal-output shape: PATTERN from 3 inputs and 3 equal outputs, LIKELIHOOD from 2 and 2."""
    whole = tx.join(modal_output(edge), "txid")
    kind = F.when((F.col("n_in") >= 3) & (F.col("n_equal") >= 3), "PATTERN").when((F.col("n_in") >= 2) & (F.col("n_equal") >= 2), "LIKELIHOOD").otherwise("NONE")
    return whole.select("txid", "n_in", "n_out", "n_equal", kind.alias("mixing"))


#: Fixed values of the change rule: an input's own address, a fresh address against a used one, the later first use, a reused peer, and the least score of a choice.
OWN, FRESH, LATER, REUSED_PEER, LEAST_SCORE = 0.98, 0.5, 0.2, 0.15, 0.7


def change_candidates(edge: DataFrame) -> DataFrame:
    """Two-output transactions: evidence that an output is the sender's change, and the unique best output of each.

    The signals (own address, one-time change, reuse) are those of Meiklejohn et al. 2013; the weights are fixed values, chosen to agree with the engine that this one replaces.
    """
    outs = edge.where("role = 'out'").select("txid", "pos", "address", "ts").withColumn("n", F.count("*").over(W.partitionBy("txid"))).where("n = 2")
    seen = edge.groupBy("address").agg(F.min("ts").alias("first_ts"), F.count_distinct("txid").alias("uses"))
    ins = edge.where("role = 'in'").select("txid", "address").distinct().withColumn("own", F.lit(True))
    o = outs.join(seen, "address").join(ins, ["txid", "address"], "left").withColumn("fresh", F.col("first_ts") >= F.col("ts"))
    pair = W.partitionBy("txid").orderBy("pos", "address")
    peer = lambda c: F.coalesce(F.lead(c).over(pair), F.lag(c).over(pair))
    o = o.withColumn("peer_fresh", peer("fresh")).withColumn("peer_first", peer("first_ts")).withColumn("peer_uses", peer("uses"))
    soft = F.when(F.col("fresh") & ~F.col("peer_fresh"), FRESH).otherwise(0.0) + F.when(F.col("first_ts") > F.col("peer_first"), LATER).otherwise(0.0) + F.when(F.col("peer_uses") > 1, REUSED_PEER).otherwise(0.0)
    scored = o.withColumn("score", F.round(F.when(F.col("own"), OWN).otherwise(soft), 4))
    top = F.max("score").over(W.partitionBy("txid"))
    ties = F.count(F.when(F.col("score") == F.col("top"), 1)).over(W.partitionBy("txid"))
    picked = scored.withColumn("top", top).withColumn("ties", ties)
    chosen = (F.col("score") == F.col("top")) & (F.col("ties") == 1) & (F.col("score") >= LEAST_SCORE)
    return picked.select("txid", "pos", "address", "score", chosen.alias("chosen"))


#: Fixed values of the mixing score: weights of uniform outputs, varied inputs, symmetry and participants; spreads that count as uniform and as varied; participants, many and few; bars of the two classes.
MIX_WEIGHTS = (0.40, 0.25, 0.20, 0.15)
UNIFORM, VARIED, PARTICIPANTS, MANY, FEW = 0.02, 0.25, 3, 5, 2
PATTERN_BAR, LIKELIHOOD_BAR = 0.75, 0.45


def mixing_scores(tx: DataFrame) -> DataFrame:
    """``txid, suppressor, mixing_score, mixing``: how much a transaction's counts and amounts look like a joint spend of strangers.

    Outputs alike, inputs unlike, sides of equal size and enough participants speak for it. Shapes of everyday payments
    (batch payouts, consolidations, plain spends, uniform payouts by a few, in this order) rule it out. Where a side has
    no amounts there is no score and the class is INSUFFICIENT.
    """
    ramp = lambda x, lo, hi: F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    n_in, n_out = F.col("n_in"), F.col("n_out")
    small, large = F.least(n_in, n_out), F.greatest(n_in, n_out)
    rows = tx.withColumn("so", spread(F.col("out_max"), F.col("out_min"), F.col("out_mean"))).withColumn("si", spread(F.col("in_max"), F.col("in_min"), F.col("in_mean")))
    signals = (1 - ramp(F.col("so"), UNIFORM, VARIED), ramp(F.col("si"), UNIFORM, VARIED), small / large, ramp(small, PARTICIPANTS, 3 * PARTICIPANTS))
    told = F.col("so").isNotNull() & F.col("si").isNotNull() & (small > 0)
    rows = rows.withColumn("score", F.when(told, sum((w * s for w, s in zip(MIX_WEIGHTS, signals, strict=True)), F.lit(0.0)))).withColumn("even", signals[0])
    suppressor = (
        F.when((n_in <= FEW) & (n_out >= MANY), "batch").when((n_in >= MANY) & (n_out <= FEW), "consolidation").when((n_in <= FEW) & (n_out <= FEW + 1), "ordinary")
        .when((F.col("even") > 0.5) & (n_in < PARTICIPANTS), "uniform_payout").otherwise("none")
    )
    rows = rows.withColumn("suppressor", suppressor)
    free = F.col("suppressor") == "none"
    kind = F.when(F.col("score").isNull(), "INSUFFICIENT").when(free & (small >= PARTICIPANTS) & (F.col("score") >= PATTERN_BAR), "PATTERN").when(free & (F.col("score") >= LIKELIHOOD_BAR), "LIKELIHOOD").otherwise("NONE")
    return rows.select("txid", "suppressor", F.round("score", 6).alias("mixing_score"), kind.alias("mixing"))
