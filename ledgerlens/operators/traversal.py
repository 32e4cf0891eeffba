"""Bounded walks and random walks with restart over payer-payee flows.

Every hop is one join on the frontier's edges and one minimum per vertex; the frontier is cut by a checkpoint, so that
the plan of hop n does not hold the hops before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.neighbourhoods import BLOCK, numbered
from ledgerlens.operators.ranges import places
from ledgerlens.session import checkpoint, dealt, lots

#: Addresses of a walk whose numbers go to all tasks as one vector: 128 MB.
DENSE = 16_000_000


def nearest_seed(links: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Vertices within ``hops`` of a seed: distance, and the least vertex one hop nearer. ``links``: src, dst."""
    seen = checkpoint(seeds.select("vertex").distinct().select("vertex", F.lit(0).alias("hop"), F.lit(None).cast(seeds.schema["vertex"].dataType).alias("via")))
    for hop in range(1, hops + 1):
        edge = seen.where(F.col("hop") == hop - 1).select(F.col("vertex").alias("src")).join(links, "src")
        fresh = edge.groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("via")).join(seen.select("vertex"), "vertex", "left_anti")
        seen = checkpoint(seen.unionByName(fresh.select("vertex", F.lit(hop).alias("hop"), "via")))
    return seen


def money_trace(edge: DataFrame, start: DataFrame, hops: int = 4, hub: int = 200) -> DataFrame:
    """Transactions that money from the start addresses can reach forwards in time, with the hop at which each is first reached.

    Addresses in more than ``hub`` transactions are not passed through.
    """
    busy = edge.groupBy("address").agg(F.count_distinct("txid").alias("n")).where(F.col("n") > hub).select("address")
    calm = edge.join(busy, "address", "left_anti")
    ins, outs = (calm.where(F.col("role") == r).select("txid", "address", "step").distinct() for r in ("in", "out"))
    first = ins.join(start, "address", "left_semi").groupBy("txid").agg(F.min("step").alias("step"))
    seen = checkpoint(first.select("txid", "step", F.lit(1).alias("hop")))
    for hop in range(2, hops + 1):
        paid = seen.where(F.col("hop") == hop - 1).select("txid").join(outs, "txid").groupBy("address").agg(F.min("step").alias("since"))
        fresh = ins.join(paid, "address").where("step > since").groupBy("txid").agg(F.min("step").alias("step")).join(seen.select("txid"), "txid", "left_anti")
        seen = checkpoint(seen.unionByName(fresh.select("txid", "step", F.lit(hop).alias("hop"))))
    return seen


def personalised_rank(edge: DataFrame, seeds: DataFrame, restart: float = 0.3, rounds: int = 40, hub: int = 500) -> DataFrame:
    """``address, score``: random walk with restart at the seeds (Haveliwala 2002), from address to transaction to address.

    Addresses are numbered, and up to DENSE of them what they hold is one vector that goes to all tasks each round. Tasks hold whole transactions,
    so that both halves of a step are done in them, and give back sums by blocks of addresses; beyond DENSE, steps are joins by a shuffle.
    Transactions of more than ``hub`` addresses are left out. What a walk carries to an address that has no other
    transaction is lost and not dealt anew. Scores are shares of what a seed keeps for itself, at most 1; seeds have 1, and
    without a seed among the addresses all have 0. ``seeds``: vertex.
    """
    rows = checkpoint(edge.select("address", "txid").distinct())
    marked = rows.select("address").distinct().join(seeds.select(F.col("vertex").alias("address")).distinct().withColumn("seed", F.lit(1)), "address", "left")
    base = checkpoint(marked.select("address", F.coalesce("seed", F.lit(0)).alias("seed")))
    facts = base.agg(F.sum("seed").alias("seeds"), F.count("*").alias("n")).first()
    walked = _dense_walk if facts["n"] <= DENSE else _joined_walk
    rank = walked(rows, base, float(max(facts["seeds"] or 0, 1)), restart, rounds, hub)
    score = F.when(F.col("seed") == 1, 1.0).otherwise(F.least(F.col("r") * (facts["seeds"] or 0) / restart, F.lit(1.0)))
    return rank.select("address", F.round(score, 6).alias("score"))


def _dense_walk(rows: DataFrame, base: DataFrame, seeds: float, restart: float, rounds: int, hub: int) -> DataFrame:
    """``address, seed, r`` after some rounds, from ``address, txid`` and ``address, seed``."""
    sc = rows.sparkSession.sparkContext
    known = checkpoint(numbered(base.select("address").where("address IS NOT NULL"), "address").join(base, "address"))
    coded = rows.join(known.select("address", "id"), "address", "left").select("txid", "id")
    whole = coded.repartitionByRange(lots(rows.sparkSession, rows.count()), "txid").groupBy("txid").agg(F.count("*").alias("size"), F.collect_list("id").alias("ids")).where((F.col("size") <= hub) & (F.size("ids") > 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(1), batch.column(0).to_numpy().astype(np.int32)
            cells = [ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy().astype(np.int32), sizes]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["ids", "counts", "sizes"])

    walk = checkpoint(whole.select("size", "ids").mapInArrow(packed, "ids binary, counts binary, sizes binary")).coalesce(sc.defaultParallelism)  # a vector of sums for each task
    n = known.count()

    def summed(parts: DataFrame) -> np.ndarray:
        """The sum of the tasks' vectors, each given by blocks (``block, v``)."""

        def add(group: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(v.as_buffer()) for v in group.column("v")], axis=0)
            return pa.table({"block": group.column("block")[:1], "v": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros(n)
        for r in parts.groupBy("block").applyInArrow(add, "block int, v binary").toLocalIterator():
            v = np.frombuffer(r["v"])
            out[r["block"] * BLOCK : r["block"] * BLOCK + len(v)] = v
        return out

    def over(step) -> DataFrame:
        """What ``step(ids, counts, sizes)`` gives to each of the ids, summed in each task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                for cells in zip(*batch.columns, strict=True):
                    ids, counts, sizes = (np.frombuffer(c.as_buffer(), np.int32) for c in cells)
                    np.add.at(total, ids, step(ids, counts, sizes))
            for i, at in enumerate(range(0, n, BLOCK)):
                if total[at : at + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], names=["block", "v"])

        return walk.mapInArrow(run, "block int, v binary")

    degree = np.maximum(summed(over(lambda ids, counts, sizes: np.ones(len(ids)))), 1)
    own = np.zeros(n)
    for r in known.where("seed = 1").select("id").toLocalIterator():
        own[r["id"]] = 1 / seeds
    rank = own
    for _ in range(rounds):
        sent = sc.broadcast(rank / degree)

        def step(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, sent=sent) -> np.ndarray:
            held = np.add.reduceat(sent.value[ids], np.cumsum(counts) - counts)
            return np.repeat(held / sizes, counts)

        rank = restart * own + (1 - restart) * summed(over(step))
        sent.unpersist()
    last = sc.broadcast(rank)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last.value[batch.column(2).to_numpy()])], names=["address", "seed", "r"])

    return known.select("address", "seed", "id").mapInArrow(given, "address string, seed int, r double")


def _joined_walk(rows: DataFrame, base: DataFrame, seeds: float, restart: float, rounds: int, hub: int) -> DataFrame:
    """The same with all steps as joins, for any number of addresses."""
    size = rows.groupBy("txid").agg(F.count("*").alias("size")).where(F.col("size") <= hub)
    walk = rows.join(size, "txid")
    degree = walk.groupBy("address").agg(F.count("*").alias("degree"))
    walk = checkpoint(walk.join(degree, "address").select("address", "txid", (1.0 / F.col("degree")).alias("leave"), (1.0 / F.col("size")).alias("arrive"))).persist()
    own = F.col("seed") / seeds
    rank = base.select("address", own.alias("r"))
    for i in range(rounds):
        tx = walk.join(rank, "address").groupBy("txid").agg(F.sum(F.col("r") * F.col("leave")).alias("held"))
        flow = walk.join(tx, "txid").groupBy("address").agg(F.sum(F.col("held") * F.col("arrive")).alias("flow"))
        rank = base.join(flow, "address", "left").select("address", (restart * own + (1 - restart) * F.coalesce("flow", F.lit(0.0))).alias("r"))
        if i % 4 == 3 or i == rounds - 1:
            rank = checkpoint(rank)
    walk.unpersist()
    return base.join(rank, "address").select("address", "seed", "r")


def money_moves(edge: DataFrame, direction: str = "both", hub: int = 200, first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(address, txid, way)`` that leave an address and ``(txid, way, address)`` that arrive, downstream (1), upstream (-1) or both.

    Transactions with more than ``hub`` rows are left out; moves lie in steps ``first`` to ``last``. Both are dealt by what they are
    joined on into as many partitions as the edges had.
    """
    ways = {"downstream": (1,), "upstream": (-1,), "both": (1, -1)}[direction]
    size = edge.groupBy("txid").agg(F.count("*").alias("rows")).where(F.col("rows") <= hub).select("txid")
    rows = checkpoint(edge.select("txid", "address", "role", "step").distinct().join(size, "txid"))
    timely = F.lit(True)
    if first is not None:
        timely = timely & (F.col("step") >= first)
    if last is not None:
        timely = timely & (F.col("step") <= last)
    way = F.when(F.col("role") == "in", 1).otherwise(-1)
    n = rows.rdd.getNumPartitions()
    leaving = dealt(rows.where(timely).select("address", "txid", way.alias("way")).where(F.col("way").isin(*ways)), n, "address").distinct()
    arriving = dealt(rows.select("txid", (-way).alias("way"), "address").where(F.col("way").isin(*ways)), n, "txid", "way").distinct()
    return leaving, arriving


def trace(edge: DataFrame, start: DataFrame, direction: str = "both", hops: int = 3, max_nodes: int = 300, hub: int = 200, first: int | None = None, last: int | None = None) -> DataFrame:
    """``kind, node, hop, nodes, truncated``: addresses and transactions around the start addresses by the hop that first reaches them.

    The first ``max_nodes`` by hop, kind and id are returned; ``nodes`` counts all, and ``truncated`` says whether some are left out.
    """
    leaving, arriving = money_moves(edge, direction, hub, first, last)
    known = edge.select("address").distinct()
    seen = checkpoint(start.select("address").distinct().join(known, "address", "left_semi").select("address", F.lit(0).alias("hop")))
    txs = None
    for hop in range(1, hops + 1):
        moved = checkpoint(seen.where(F.col("hop") == hop - 1).select("address").join(leaving, "address").select("txid", "way").distinct())
        met = moved.select("txid", F.lit(hop).alias("hop"))
        txs = met if txs is None else txs.unionByName(met)
        fresh = moved.join(arriving, ["txid", "way"]).select("address").distinct().join(seen.select("address"), "address", "left_anti")
        seen = checkpoint(seen.unionByName(fresh.select("address", F.lit(hop).alias("hop"))))
    nodes = seen.select(F.lit("address").alias("kind"), F.col("address").cast("string").alias("node"), "hop")
    if txs is not None:
        nodes = nodes.unionByName(txs.groupBy("txid").agg(F.min("hop").alias("hop")).select(F.lit("transaction").alias("kind"), F.col("txid").cast("string").alias("node"), "hop"))
    nodes = checkpoint(nodes)
    n = nodes.count()
    kept = places(nodes, ["hop", "kind", "node"]).where(F.col("place") <= max_nodes) if n > max_nodes else nodes
    return kept.select("kind", "node", "hop", F.lit(n).cast("long").alias("nodes"), F.lit(n > max_nodes).alias("truncated"))
