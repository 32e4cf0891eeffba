"""The money flow and the announcements around many alerts at once.

A trace's frontier is keyed by alert and address, so that all alerts take their hops in the same joins. Each alert has its
own limits: it stops once it has met as many vertices as it may show, and shows the first of them by hop, kind and id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.tops import first_rows
from ledgerlens.session import checkpoint, dealt

#: Members that a trace starts from, peers shown, peers kept of a transaction, transactions kept of an alert, rows
#: from which on a transaction isn't passed through.
SEEDS, PEERS, TX_PEERS, ALERT_TXS, HUB = 40, 60, 6, 40, 200


def alert_network(edge: DataFrame, members: DataFrame, observed: DataFrame, tx_peers: int = TX_PEERS, alert_txs: int = ALERT_TXS) -> DataFrame:
    """``alert_id, txid, peer, first_ms, last_ms, observers, announcing_peers, address, role``: who announced the transactions of
    alerts' members.

    ``members``: alert_id, address. ``observed``: txid, observer, peer, ms. Of a transaction's peers the first ``tx_peers`` by time
    are kept (``announcing_peers`` counts all), of an alert's transactions the ``alert_txs`` that were announced last. Ties go to
    the lesser peer and transaction.
    """
    touching = checkpoint(edge.select("txid", "address", "role").distinct().join(members.select("alert_id", "address").distinct(), "address").where("alert_id IS NOT NULL"))
    wanted = observed.where("peer IS NOT NULL").join(touching.select("txid").distinct(), "txid")
    peers = wanted.groupBy("txid", "peer").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count_distinct("observer").alias("observers"))
    peers = checkpoint(peers)
    count = peers.groupBy("txid").agg(F.count("*").alias("announcing_peers"), F.min("first_ms").alias("tx_ms"))
    first = first_rows(peers, ["txid"], [F.asc("first_ms"), F.asc("peer")], tx_peers, lot_by=["peer"]).drop("place")
    txs = touching.select("alert_id", "txid").distinct().join(count, "txid")
    newest = first_rows(txs, ["alert_id"], [F.desc("tx_ms"), F.asc("txid")], alert_txs, lot_by=["txid"]).select("alert_id", "txid", "announcing_peers")
    return touching.join(newest, ["alert_id", "txid"]).join(first, "txid").select("alert_id", "txid", "peer", "first_ms", "last_ms", "observers", "announcing_peers", "address", "role")


def trace_alerts(edge: DataFrame, members: DataFrame, hops: int = 2, max_nodes: int = 400, seeds: int = SEEDS, hub: int = HUB, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` around each alert's members of highest risk (``members``: alert_id, address, risk).

    Nodes are ``alert_id, kind, node, hop, seed, nodes, skipped, truncated``: ``nodes`` counts all that were met, ``skipped`` the
    transactions of more than ``hub`` rows that the trace came upon and didn't pass. Edges are ``alert_id, kind, source, target,
    step`` and run as value moves: SPENDS from an address to a transaction, PAYS from a transaction to an address. Both ends of
    an edge are among the nodes. Members without transactions start nothing.
    """
    ways = {"downstream": (1,), "upstream": (-1,), "both": (1, -1)}[direction]
    rows = edge.select("txid", "address", "step", F.when(F.col("role") == "in", 1).otherwise(-1).alias("way"))
    size = edge.groupBy("txid").agg((F.count("*") > hub).alias("big"))
    moves = checkpoint(rows.distinct().join(size, "txid"))
    n = moves.rdd.getNumPartitions()
    by_address, by_tx = dealt(moves, n, "address"), dealt(moves.select("txid", "address", "step", (-F.col("way")).alias("way")), n, "txid", "way")
    known = members.join(moves.select("address").distinct(), "address", "left_semi").groupBy("alert_id", "address").agg(F.max("risk").alias("risk"))
    start = first_rows(known.where("alert_id IS NOT NULL"), ["alert_id"], [F.desc("risk"), F.asc("address")], seeds, lot_by=["address"])
    seen = checkpoint(start.select("alert_id", "address", F.lit(0).alias("hop")))
    open_alerts, txs, flows, skipped = seen.select("alert_id").distinct(), [], [], []
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).join(open_alerts, "alert_id", "left_semi")
        met = checkpoint(front.select("alert_id", "address").join(by_address.where(F.col("way").isin(*ways)), "address"))
        skipped.append(met.where("big").select("alert_id", "txid").distinct())
        passed = met.where("NOT big").select("alert_id", "txid", "way").distinct()
        there = checkpoint(passed.join(by_tx, ["txid", "way"]))
        txs.append(passed.select("alert_id", "txid", F.lit(hop).alias("hop")).distinct())
        flows += [met.where("NOT big").select("alert_id", "txid", "address", "step", "way"), there.select("alert_id", "txid", "address", "step", (-F.col("way")).alias("way"))]
        fresh = there.select("alert_id", "address").distinct().join(seen.select("alert_id", "address"), ["alert_id", "address"], "left_anti")
        seen = checkpoint(seen.unionByName(fresh.select("alert_id", "address", F.lit(hop).alias("hop"))))
        if hop < hops:  # an alert that has met enough goes no further
            every = seen.select("alert_id").unionByName(reduce(DataFrame.unionByName, txs).select("alert_id", "txid").distinct().select("alert_id"))
            open_alerts = checkpoint(every.groupBy("alert_id").agg(F.count("*").alias("n")).where(F.col("n") < max_nodes).select("alert_id"))
    address, tx = F.concat(F.lit("addr:"), "address"), F.concat(F.lit("tx:"), F.col("txid").cast("string"))
    found = seen.select("alert_id", F.lit("address").alias("kind"), address.alias("node"), "hop")
    if txs:
        met = reduce(DataFrame.unionByName, txs).groupBy("alert_id", "txid").agg(F.min("hop").alias("hop"))
        found = found.unionByName(met.select("alert_id", F.lit("transaction").alias("kind"), tx.alias("node"), "hop"))
    found = checkpoint(found)
    total = found.groupBy("alert_id").agg(F.count("*").alias("nodes"))
    if skipped:
        hubs = reduce(DataFrame.unionByName, skipped).distinct().groupBy("alert_id").agg(F.count("*").alias("skipped"))
        total = total.join(hubs, "alert_id", "left")
    else:
        total = total.withColumn("skipped", F.lit(None).cast("long"))
    kept = first_rows(found, ["alert_id"], [F.asc("hop"), F.asc("kind"), F.asc("node")], max_nodes, lot_by=["node"]).drop("place")
    nodes = kept.join(total, "alert_id").withColumn("seed", (F.col("kind") == "address") & (F.col("hop") == 0))
    nodes = checkpoint(nodes.select("alert_id", "kind", "node", "hop", "seed", "nodes", F.coalesce("skipped", F.lit(0)).alias("skipped"), (F.col("nodes") > max_nodes).alias("truncated")))
    ends = nodes.select("alert_id", "node")
    if not flows:
        return nodes, ends.limit(0).select("alert_id", F.lit("").alias("kind"), F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).alias("step"))
    moved = reduce(DataFrame.unionByName, flows).distinct()
    spends = F.col("way") == 1
    lines = moved.select("alert_id", F.when(spends, "SPENDS").otherwise("PAYS").alias("kind"), F.when(spends, address).otherwise(tx).alias("source"), F.when(spends, tx).otherwise(address).alias("target"), "step")
    lines = lines.join(ends.withColumnRenamed("node", "source"), ["alert_id", "source"], "left_semi").join(ends.withColumnRenamed("node", "target"), ["alert_id", "target"], "left_semi")
    return nodes, lines.select("alert_id", "kind", "source", "target", "step")


def alert_graph(edge: DataFrame, members: DataFrame, observed: DataFrame, hops: int = 2, max_nodes: int = 400, peers: int = PEERS, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of ``trace_alerts`` with two more layers.

    Each alert's cluster is a node (``cluster:`` and the alert's id) that its members among the nodes are MEMBER_OF. Peers that
    announced a transaction of the graph, by ``alert_network``, are nodes that the transaction is ANNOUNCED_BY; of an alert's
    peers the first ``peers`` by their latest first announcement are shown. ``hop`` is null for both. Edges of these layers have
    no step but the time of announcement in ``first_ms``.
    """
    nodes, lines = trace_alerts(edge, members, hops, max_nodes, direction=direction)
    own = members.select("alert_id", F.concat(F.lit("addr:"), "address").alias("source")).distinct()
    cluster = F.concat(F.lit("cluster:"), F.col("alert_id").cast("string"))
    belongs = nodes.select("alert_id", F.col("node").alias("source")).join(own, ["alert_id", "source"]).select("alert_id", F.lit("MEMBER_OF").alias("kind"), "source", cluster.alias("target"))
    net = alert_network(edge, members, observed).select("alert_id", F.concat(F.lit("tx:"), F.col("txid").cast("string")).alias("source"), F.concat(F.lit("ip:"), F.col("peer").cast("string")).alias("target"), "first_ms").distinct()
    heard = checkpoint(net.join(nodes.select("alert_id", F.col("node").alias("source")), ["alert_id", "source"], "left_semi"))
    latest = heard.groupBy("alert_id", "target").agg(F.max("first_ms").alias("ms"))
    shown = checkpoint(first_rows(latest, ["alert_id"], [F.desc("ms"), F.asc("target")], peers, lot_by=["target"]).select("alert_id", "target"))
    said = heard.join(shown, ["alert_id", "target"], "left_semi").select("alert_id", F.lit("ANNOUNCED_BY").alias("kind"), "source", "target", "first_ms")
    none = lambda kind: F.lit(None).cast(kind)
    more = [
        nodes.select("alert_id").distinct().select("alert_id", F.lit("cluster").alias("kind"), cluster.alias("node")),
        shown.select("alert_id", F.lit("ip").alias("kind"), F.col("target").alias("node")),
    ]
    points = nodes.select("alert_id", "kind", "node", "hop", "seed")
    for layer in more:
        points = points.unionByName(layer.select("*", none("int").alias("hop"), F.lit(False).alias("seed")))
    edges = lines.withColumn("first_ms", none("long")).unionByName(belongs.select("*", none("int").alias("step"), none("long").alias("first_ms"))).unionByName(said.withColumn("step", none("int")))
    return points, edges
