import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import alert_graphs
from ledgerlens.operators.alert_graphs import alert_graph, alert_network, trace_alerts
from ledgerlens.operators.tops import first_rows

EDGE, MEMBER, SEEN = "txid long, address string, role string, step int", "alert_id string, address string, risk double", "txid long, observer string, peer string, ms long"


def brute(rows, members, hops, most, seeds, hub, ways):
    by_address, by_tx = defaultdict(set), defaultdict(list)
    for tx, a, role, step in rows:
        by_address[a].add((tx, role, step))
        by_tx[tx].append((a, role, step))
    nodes, edges = [], []
    for alert in sorted({m[0] for m in members}):
        start = sorted((-r, a) for x, a, r in members if x == alert and a in by_address)[:seeds]
        hop_of, drawn, skipped = {("address", f"addr:{a}"): 0 for _, a in start}, set(), set()
        front = [a for _, a in start]
        for hop in range(1, hops + 1):
            if hop > 1 and len(hop_of) >= most:
                break
            fresh = []
            for a in front:
                for tx, role, step in by_address[a]:
                    if role not in ways:
                        continue
                    if len(by_tx[tx]) > hub:
                        skipped.add(tx)
                        continue
                    hop_of.setdefault(("transaction", f"tx:{tx}"), hop)
                    drawn.add(("SPENDS", f"addr:{a}", f"tx:{tx}", step) if role == "in" else ("PAYS", f"tx:{tx}", f"addr:{a}", step))
                    for b, other, at in by_tx[tx]:
                        if other != role:
                            drawn.add(("PAYS", f"tx:{tx}", f"addr:{b}", at) if other == "out" else ("SPENDS", f"addr:{b}", f"tx:{tx}", at))
                            if ("address", f"addr:{b}") not in hop_of:
                                hop_of["address", f"addr:{b}"] = hop
                                fresh.append(b)
            front = fresh
        kept = sorted((h, k, n) for (k, n), h in hop_of.items())[:most]
        there = {n for _, _, n in kept}
        nodes += [(alert, k, n, h, k == "address" and h == 0, len(hop_of), len(skipped), len(hop_of) > most) for h, k, n in kept]
        edges += [(alert, *e) for e in drawn if e[1] in there and e[2] in there]
    return sorted(nodes), sorted(edges)


def table(seed, n=60, addresses=80):
    rnd = random.Random(seed)
    rows = [(tx, f"a{rnd.randrange(addresses)}", rnd.choice(["in", "out"]), rnd.randint(1, 9)) for tx in range(n) for _ in range(rnd.randint(1, 5))]
    return sorted({(t, a, r): (t, a, r, s) for t, a, r, s in rows}.values())


@pytest.mark.parametrize("most, hub, seeds, direction", [(1000, 100, 40, "both"), (25, 4, 3, "both"), (12, 100, 2, "downstream"), (1000, 3, 40, "upstream")])
def test_traces_of_all_alerts_at_once(spark, most, hub, seeds, direction):
    rows = table(most)
    members = [(f"x{i % 4}", f"a{i}", (i % 5) / 5) for i in range(14)] + [("x9", "unseen", 1.0), ("x1", "a1", 0.9)]
    nodes, edges = trace_alerts(spark.createDataFrame(rows, EDGE), spark.createDataFrame(members, MEMBER), hops=2, max_nodes=most, hub=hub, seeds=seeds, direction=direction)
    ways = {"both": ("in", "out"), "downstream": ("in",), "upstream": ("out",)}[direction]
    unique = [(x, a, max(r for y, b, r in members if (y, b) == (x, a))) for x, a in sorted({m[:2] for m in members})]
    want = brute(rows, unique, 2, most, seeds, hub, ways)
    assert sorted(tuple(r) for r in nodes.collect()) == want[0]
    assert sorted(tuple(r) for r in edges.collect()) == want[1]


def test_network_keeps_the_first_peers_and_the_newest_transactions(spark):
    rnd = random.Random(4)
    rows, members = table(3), [("x0", f"a{i}", 0.5) for i in range(30)] + [("x1", "a3", 0.1), (None, "a4", 0.2)]
    seen = [(rnd.randrange(60), f"o{rnd.randrange(3)}", rnd.choice([None, "p1", "p2", "p3", "p4"]), rnd.randrange(50)) for _ in range(900)]
    got = alert_network(spark.createDataFrame(rows, EDGE), spark.createDataFrame(members, MEMBER), spark.createDataFrame(seen, SEEN), tx_peers=2, alert_txs=7).collect()
    peers = defaultdict(lambda: defaultdict(list))
    for tx, o, p, ms in seen:
        if p is not None:
            peers[tx][p].append((ms, o))
    want = []
    for alert in ("x0", "x1"):
        touch = [r for r in rows if (alert, r[1]) in {m[:2] for m in members}]
        newest = sorted((-min(ms for v in peers[t].values() for ms, _ in v), t) for t in {r[0] for r in touch} if peers[t])[:7]
        for _, tx in newest:
            for first, p in sorted((min(v)[0], p) for p, v in peers[tx].items())[:2]:
                v = peers[tx][p]
                want += [(alert, tx, p, first, max(v)[0], len({o for _, o in v}), len(peers[tx]), a, role) for t, a, role, _ in touch if t == tx]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_graph_has_both_ends_of_every_edge(spark):
    rows, members = table(5), [("x0", "a1", 0.9), ("x0", "a2", 0.8), ("x1", "a7", 0.3)]
    seen = [(tx, "o", f"p{tx % 9}", tx) for tx in range(60)]
    nodes, edges = alert_graph(spark.createDataFrame(rows, EDGE), spark.createDataFrame(members, MEMBER), spark.createDataFrame(seen, SEEN), hops=1, max_nodes=20, peers=2)
    points = {(r.alert_id, r.node) for r in nodes.collect()}
    lines = edges.collect()
    assert {r.kind for r in lines} == {"SPENDS", "PAYS", "MEMBER_OF", "ANNOUNCED_BY"}
    assert all((r.alert_id, r.source) in points and (r.alert_id, r.target) in points for r in lines)
    assert all(n <= 2 for n in (sum(k == alert and p.startswith("ip:") for k, p in points) for alert in ("x0", "x1")))


def test_nothing_to_trace(spark):
    edge, none = spark.createDataFrame(table(1), EDGE), spark.createDataFrame([], MEMBER)
    for e, m in ((edge, none), (spark.createDataFrame([], EDGE), spark.createDataFrame([("x", "a1", 1.0)], MEMBER))):
        nodes, edges = alert_graph(e, m, spark.createDataFrame([], SEEN))
        assert nodes.collect() == [] and edges.collect() == []


def test_first_rows_of_a_hot_group(spark, monkeypatch):
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(-1).alias("g"), ((F.col("id") * 37) % 101).alias("v"), "id")
    got = first_rows(df, ["g"], [F.desc("v"), F.asc("id")], 3).collect()
    rows = defaultdict(list)
    for r in df.collect():
        rows[r.g].append((-r.v, r.id))
    assert sorted((r.g, r.place, r.id) for r in got) == sorted((g, i, x[1]) for g, v in rows.items() for i, x in enumerate(sorted(v)[:3], 1))
    assert alert_graphs.SEEDS == 40
