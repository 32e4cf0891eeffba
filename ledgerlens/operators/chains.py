"""Peeling chains: what is left of a payment moves on, transaction by transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint


def next_hops(edge: DataFrame) -> DataFrame:
    """For transactions of two or three outputs: the first later one that spends from the largest output's address."""
    outs = edge.where("role = 'out'").groupBy("txid").agg(F.count("*").alias("n"), F.min("ts").alias("ts"), F.max_by("address", F.struct("amount", -F.col("pos"), "address")).alias("address"), F.sum("amount").alias("total"), F.max("amount").alias("kept")).where("n IN (2, 3)")
    spends = edge.where("role = 'in'").groupBy("address", F.col("txid").alias("spender")).agg(F.min("ts").alias("at"))
    first = outs.join(spends, "address").where("at > ts").groupBy("txid").agg(F.min(F.struct("at", "spender")).alias("s"))
    return outs.join(first, "txid", "left").select("txid", F.col("s.spender").alias("next"), (F.col("total") - F.col("kept")).alias("peeled"), F.lit(1).alias("hops"))


def peel_chains(edge: DataFrame, least: int = 2) -> DataFrame:
    """Length, end and peeled sum of the chain from each transaction, by pointer jumping: rounds grow with the logarithm of the longest."""
    state = checkpoint(next_hops(edge))
    while not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("txid").alias("next"), F.col("next").alias("next2"), F.col("peeled").alias("peeled2"), F.col("hops").alias("hops2"), F.lit(True).alias("known"))
        jumped = state.join(ahead, "next", "left")
        state = checkpoint(jumped.select("txid", F.col("next2").alias("next"), (F.col("peeled") + F.coalesce("peeled2", F.lit(0.0))).alias("peeled"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops")))
    return state.where(F.col("hops") >= least).select("txid", "hops", F.round("peeled", 2).alias("peeled"))
