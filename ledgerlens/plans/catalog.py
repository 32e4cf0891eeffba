"""Registered queries of the analytics engine and the SQL that states the same results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import addresses as A
from ledgerlens.operators import clusters as C
from ledgerlens.operators import metrics as M
from ledgerlens.operators import network as N
from ledgerlens.operators import transactions as X
from ledgerlens.operators import traversal as R
from ledgerlens.plans import views as V
from ledgerlens.sources import capture as S
from ledgerlens.session import checkpoint, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "cluster_cospend"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL for its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- addresses ------------------------------------------------------------------------------------------------------


@query(
    "agg_addr",
    V.TX
    + """SELECT address, count(DISTINCT e.txid) AS n_txs, count(CASE WHEN role = 'in' THEN 1 END) AS n_in, count(CASE WHEN role = 'out' THEN 1 END) AS n_out,
 round(sum(CASE WHEN role = 'in' THEN amount END), 2) AS sent, round(sum(CASE WHEN role = 'out' THEN amount END), 2) AS received,
 round(coalesce(sum(CASE WHEN role = 'out' THEN amount END), 0) - coalesce(sum(CASE WHEN role = 'in' THEN amount END), 0), 2) AS net,
 round(avg(CASE WHEN in_total > 0 THEN tx.fee / in_total END), 6) AS mean_fee_ratio, round(max(CASE WHEN in_total > 0 THEN tx.fee / in_total END), 6) AS max_fee_ratio,
 round(count(DISTINCT e.txid) * 3600.0::DOUBLE / greatest(epoch(max(e.ts))::BIGINT - epoch(min(e.ts))::BIGINT, 1), 8) AS tx_per_hour
 FROM edge e JOIN tx ON e.txid = tx.txid GROUP BY address""",
)
def agg_addr(spark, d):
    e = V.edges(spark, d)
    return A.address_profile(e, V.transactions(e))


GAPS = "gaps AS (SELECT address, step - lag(step) OVER (PARTITION BY address ORDER BY step) AS gap FROM (SELECT DISTINCT address, step FROM edge))"


@query("w_gap", V.EDGE + f", {GAPS} SELECT address, round(avg(gap), 6) AS mean_gap, max(gap) AS max_gap, median(gap)::DOUBLE AS median_gap FROM gaps WHERE gap IS NOT NULL GROUP BY address")
def w_gap(spark, d):
    return A.step_gaps(V.edges(spark, d))


@query(
    "agg_m0",
    V.EDGE
    + f""", {GAPS}, g AS (SELECT address, round(avg(gap), 6) AS mean_gap, max(gap) AS max_gap, median(gap)::DOUBLE AS median_gap FROM gaps WHERE gap IS NOT NULL GROUP BY address),
 s AS (SELECT address, min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS active_steps, max(step) - min(step) + 1 AS span,
 count(*) FILTER (role = 'in') AS in_count, min(amount) FILTER (role = 'in') AS in_min, max(amount) FILTER (role = 'in') AS in_max, round(avg(amount) FILTER (role = 'in'), 6) AS in_mean,
 count(*) FILTER (role = 'out') AS out_count, min(amount) FILTER (role = 'out') AS out_min, max(amount) FILTER (role = 'out') AS out_max, round(avg(amount) FILTER (role = 'out'), 6) AS out_mean FROM edge GROUP BY address)
 SELECT s.*, mean_gap, max_gap, median_gap FROM s LEFT JOIN g USING (address)""",
)
def agg_m0(spark, d):
    return A.behaviour(V.edges(spark, d))


@query("first_last_t", V.EDGE + "SELECT address, min(step) AS first_step, max(step) AS last_step FROM edge GROUP BY address")
def first_last_t(spark, d):
    return A.first_last(V.edges(spark, d))


@query("agg_degree", V.EDGE + "SELECT address, count(DISTINCT txid) AS degree FROM edge GROUP BY address")
def agg_degree(spark, d):
    return A.tx_degree(V.edges(spark, d))


FLOWS = """size AS (SELECT txid FROM edge GROUP BY txid HAVING count(*) FILTER (role = 'in') > 0 AND count(*) FILTER (role = 'out') > 0 AND count(*) FILTER (role = 'in') * count(*) FILTER (role = 'out') <= 10000),
 payers AS (SELECT DISTINCT txid, step, address AS payer FROM edge WHERE role = 'in' AND txid IN (SELECT txid FROM size)),
 payees AS (SELECT txid, address AS payee, sum(amount) AS amount FROM edge WHERE role = 'out' AND txid IN (SELECT txid FROM size) GROUP BY ALL),
 flow AS (SELECT txid, step, payer, payee, amount FROM payers JOIN payees USING (txid) WHERE payer <> payee)"""


@query("j_in_out", V.EDGE + f", {FLOWS} SELECT payer, payee, count(*) AS n_txs, round(sum(amount), 2) AS amount FROM flow GROUP BY ALL")
def j_in_out(spark, d):
    return A.flows(V.edges(spark, d)).groupBy("payer", "payee").agg(F.count("*").alias("n_txs"), F.round(F.sum("amount"), 2).alias("amount"))


@query(
    "agg_m1",
    V.EDGE
    + f""", {FLOWS}, p AS (SELECT payer AS address, count(DISTINCT payee) AS out_degree, round(sum(amount), 2) AS out_value FROM flow GROUP BY 1),
 q AS (SELECT payee AS address, count(DISTINCT payer) AS in_degree, round(sum(amount), 2) AS in_value FROM flow GROUP BY 1) SELECT address, out_degree, out_value, in_degree, in_value FROM p FULL JOIN q USING (address)""",
)
def agg_m1(spark, d):
    return A.counterparties(V.edges(spark, d))


@query(
    "w_topk_group",
    V.EDGE
    + f""", {FLOWS}, p AS (SELECT payer, payee, round(sum(amount), 2) AS amount, count(*) AS n_txs FROM flow GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY amount DESC, payee) AS place FROM p) WHERE place <= 3""",
)
def w_topk_group(spark, d):
    return A.top_counterparties(V.edges(spark, d))


@query(
    "agg_lcc",
    V.EDGE
    + f""", {FLOWS}, und AS (SELECT least(payer, payee) AS u, greatest(payer, payee) AS v, min(step) AS since FROM flow GROUP BY ALL), both_ways AS (SELECT * FROM und UNION ALL SELECT v, u, since FROM und),
 last_seen AS (SELECT address AS u, max(step) AS last_step FROM edge GROUP BY 1), near AS (SELECT b.*, last_step FROM both_ways b JOIN last_seen USING (u) WHERE since <= last_step),
 k AS (SELECT u, count(*) AS k FROM near GROUP BY u), shut AS (SELECT a.u, count(*) AS links FROM near a JOIN near b ON a.u = b.u AND a.v < b.v JOIN und ON und.u = a.v AND und.v = b.v AND und.since <= a.last_step GROUP BY 1)
 SELECT k.u AS address, k, CASE WHEN k >= 2 THEN round(2.0::DOUBLE * coalesce(links, 0) / (k * (k - 1)), 6) END AS clustering FROM k LEFT JOIN shut ON k.u = shut.u""",
)
def agg_lcc(spark, d):
    return A.local_clustering(V.edges(spark, d))


@query("w_last_snap", V.EDGE + "SELECT address, txid, pos, role, amount, step FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts DESC, txid DESC, pos DESC, amount DESC, role DESC) AS rn FROM edge) WHERE rn = 1")
def w_last_snap(spark, d):
    return A.last_snapshot(V.edges(spark, d))


def _z(f):
    return f"greatest(0, CASE WHEN d_{f} > 0 THEN 0.6745::DOUBLE * ({f} - m_{f}) / d_{f} ELSE ({f} - m_{f}) / CASE WHEN a_{f} > 0 THEN 1.2533::DOUBLE * a_{f} ELSE 1 END END)"


MAD = ("n_in", "n_out", "total")


@query(
    "m_mad",
    V.EDGE
    + ", p AS (SELECT address, count(*) FILTER (role = 'in')::DOUBLE AS n_in, count(*) FILTER (role = 'out')::DOUBLE AS n_out, round(sum(amount), 2) AS total FROM edge GROUP BY address), m AS (SELECT "
    + ", ".join(f"median({f}) AS m_{f}" for f in MAD)
    + " FROM p), s AS (SELECT "
    + ", ".join(f"median(abs({f} - m_{f})) AS d_{f}, avg(abs({f} - m_{f})) AS a_{f}" for f in MAD)
    + " FROM p, m) SELECT address, round(1 - exp(-sqrt("
    + " + ".join(f"power({_z(f)}, 2)" for f in MAD)
    + ") / 2), 6) AS anomaly FROM p, m, s",
)
def m_mad(spark, d):
    e = V.edges(spark, d)
    profile = e.groupBy("address").agg(F.count(F.when(F.col("role") == "in", 1)).cast("double").alias("n_in"), F.count(F.when(F.col("role") == "out", 1)).cast("double").alias("n_out"), F.round(F.sum("amount"), 2).alias("total"))
    return A.robust_anomalies(profile, MAD)


@query(
    "agg_psi_profile",
    V.EDGE
    + """, r AS (SELECT amount FROM edge WHERE step <= 42), c AS (SELECT amount FROM edge WHERE step > 42), cuts AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM r),
 e AS (SELECT CAST(len(list_filter(cuts, lambda x: x < amount)) AS INT) AS bin, count(*) AS n FROM r, cuts GROUP BY 1), o AS (SELECT CAST(len(list_filter(cuts, lambda x: x < amount)) AS INT) AS bin, count(*) AS n FROM c, cuts GROUP BY 1),
 b AS (SELECT bin, greatest(0.0001::DOUBLE, coalesce(e.n, 0) / sum(e.n) OVER ()) AS p, greatest(0.0001::DOUBLE, coalesce(o.n, 0) / sum(o.n) OVER ()) AS q FROM e FULL JOIN o USING (bin))
 SELECT bin, round(p, 6) AS expected, round(q, 6) AS observed, round((q - p) * ln(q / p), 6) AS psi FROM b""",
)
def agg_psi_profile(spark, d):
    e = V.edges(spark, d)
    return A.psi(e.where("step <= 42"), e.where("step > 42"), "amount")


@query("agg_timeline", V.EDGE + "SELECT p_brand AS entity, step, count(DISTINCT txid) AS n_txs, count(DISTINCT address) AS n_addresses, round(sum(amount) FILTER (role = 'in'), 2) AS amount_in, round(sum(amount) FILTER (role = 'out'), 2) AS amount_out FROM edge JOIN part ON p_partkey = entity_key GROUP BY ALL")
def agg_timeline(spark, d):
    e = V.edges(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("entity_key"), F.col("p_brand").alias("entity")), "entity_key")
    part = lambda r: F.round(F.sum(F.when(F.col("role") == r, F.col("amount"))), 2)
    return e.groupBy("entity", "step").agg(F.count_distinct("txid").alias("n_txs"), F.count_distinct("address").alias("n_addresses"), part("in").alias("amount_in"), part("out").alias("amount_out"))


# --- transactions ---------------------------------------------------------------------------------------------------


@query("f_spread", V.TX + "SELECT txid, step, n_in, n_out, round(in_total, 2) AS in_total, round(out_total, 2) AS out_total, round(fee, 2) AS fee, CASE WHEN in_mean > 0 THEN round((in_max - in_min) / in_mean, 6) END AS in_spread, CASE WHEN out_mean > 0 THEN round((out_max - out_min) / out_mean, 6) END AS out_spread FROM tx")
def f_spread(spark, d):
    return X.shapes(V.transactions(V.edges(spark, d)))


@query("f_entropy", V.EDGE + ", s AS (SELECT txid, amount / sum(amount) OVER (PARTITION BY txid) AS p FROM edge WHERE role = 'out' AND amount > 0) SELECT txid, round(abs(-sum(p * log2(p))), 6) AS bits FROM s GROUP BY txid")
def f_entropy(spark, d):
    return X.output_entropy(V.edges(spark, d))


STAR = "firsts AS (SELECT txid, step, address, min(pos) AS pos FROM edge WHERE role = 'in' GROUP BY ALL), star AS (SELECT * FROM (SELECT txid, step, first(address) OVER (PARTITION BY txid ORDER BY pos, address) AS center, address FROM firsts) WHERE center <> address)"


@query("star_edges", V.EDGE + f", {STAR} SELECT * FROM star")
def star_edges(spark, d):
    return X.star_edges(V.edges(spark, d))


HOPS = """o AS (SELECT DISTINCT address, txid AS src, step AS src_step FROM edge WHERE role = 'out'), i AS (SELECT DISTINCT address, txid AS dst, step AS dst_step FROM edge WHERE role = 'in'),
 hops AS (SELECT src, dst, min(dst_step - src_step) AS gap, min(address) AS via FROM o JOIN i USING (address) WHERE dst_step > src_step AND src <> dst GROUP BY src, dst)"""


@query("j_bipartite", V.EDGE + f", {HOPS} SELECT src, count(*) AS n_next, min(gap) AS nearest_gap, max(gap) AS farthest_gap FROM hops GROUP BY src")
def j_bipartite(spark, d):
    return X.hop_summary(V.edges(spark, d))


@query("j_hop_pairs", V.EDGE + f", {HOPS}, t AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS txid FROM events) SELECT src, dst, gap, via FROM hops WHERE src IN (SELECT txid FROM t) AND dst IN (SELECT txid FROM t)")
def j_hop_pairs(spark, d):
    """Hops between transactions that the network layer has seen both."""
    seen = V.observations(spark, d).select("txid").distinct()
    return X.hop_pairs(V.edges(spark, d).join(seen, "txid", "left_semi"))


MODE = "counts AS (SELECT txid, amount, count(*) AS n, min(pos) AS pos FROM edge WHERE role = 'out' GROUP BY ALL), mode AS (SELECT txid, amount, n AS n_equal FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY n DESC, pos, amount) AS rn FROM counts) WHERE rn = 1)"


@query("w_mode", V.EDGE + f", {MODE} SELECT txid, amount, n_equal FROM mode")
def w_mode(spark, d):
    return X.modal_output(V.edges(spark, d))


@query("m_mix_tx", V.TX + f", {MODE} SELECT txid, n_in, n_out, n_equal, CASE WHEN n_in >= 3 AND n_equal >= 3 THEN 'PATTERN' WHEN n_in >= 2 AND n_equal >= 2 THEN 'LIKELIHOOD' ELSE 'NONE' END AS mixing FROM tx JOIN mode USING (txid)")
def m_mix_tx(spark, d):
    e = V.edges(spark, d)
    return X.mixing_shapes(V.transactions(e), e)


CHANGE = """outs AS (SELECT txid, pos, address, ts FROM (SELECT *, count(*) OVER (PARTITION BY txid) AS n FROM edge WHERE role = 'out') WHERE n = 2), seen AS (SELECT address, min(ts) AS first_ts, count(DISTINCT txid) AS uses FROM edge GROUP BY 1),
 own AS (SELECT DISTINCT txid, address FROM edge WHERE role = 'in'), o AS (SELECT outs.*, first_ts, uses, first_ts >= ts AS fresh, own.txid IS NOT NULL AS own FROM outs JOIN seen USING (address) LEFT JOIN own ON own.txid = outs.txid AND own.address = outs.address),
 p AS (SELECT *, coalesce(lead(fresh) OVER w, lag(fresh) OVER w) AS pf, coalesce(lead(first_ts) OVER w, lag(first_ts) OVER w) AS pt, coalesce(lead(uses) OVER w, lag(uses) OVER w) AS pu FROM o WINDOW w AS (PARTITION BY txid ORDER BY pos, address)),
 q AS (SELECT txid, pos, address, round(CASE WHEN own THEN 0.98::DOUBLE ELSE CASE WHEN fresh AND NOT pf THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN first_ts > pt THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN pu > 1 THEN 0.15::DOUBLE ELSE 0 END END, 4) AS score FROM p),
 t AS (SELECT *, max(score) OVER (PARTITION BY txid) AS top FROM q)"""
CHOSEN = "SELECT txid, pos, address, score, score = top AND score >= 0.7 AND count(*) FILTER (score = top) OVER (PARTITION BY txid) = 1 AS chosen FROM t"


@query("g_change", V.EDGE + f", {CHANGE} {CHOSEN}")
def g_change(spark, d):
    return X.change_candidates(V.edges(spark, d))


# --- network layer --------------------------------------------------------------------------------------------------

ARRIVE = """first_seen AS (SELECT txid, observer, min(ms) AS ms FROM obs WHERE ms IS NOT NULL GROUP BY ALL), arrive AS (SELECT txid, observer, ms, ms - min(ms) OVER (PARTITION BY txid) AS offset_ms,
 row_number() OVER (PARTITION BY txid ORDER BY ms, observer) AS rank, max(ms) OVER (PARTITION BY txid) - min(ms) OVER (PARTITION BY txid) AS spread_ms FROM first_seen)"""


@query("agg_arrival", V.OBS + f", {ARRIVE} SELECT * FROM arrive")
def agg_arrival(spark, d):
    return N.arrivals(V.observations(spark, d))


@query(
    "agg_evidence",
    V.OBS
    + f""", {ARRIVE}, loud AS (SELECT DISTINCT txid FROM obs WHERE peer IN (SELECT peer FROM obs GROUP BY peer HAVING count(DISTINCT txid) >= 0.6 * (SELECT count(DISTINCT txid) FROM obs))),
 f AS (SELECT txid, count(*) AS observers, max(spread_ms) AS spread_ms FROM arrive GROUP BY txid) SELECT txid, observers, spread_ms, CASE WHEN txid IN (SELECT txid FROM loud) THEN 'broadcaster' WHEN observers < 3 THEN 'too_few' WHEN spread_ms <= 250 THEN 'flat' ELSE 'USABLE' END AS evidence FROM f""",
)
def agg_evidence(spark, d):
    return N.evidence_class(V.observations(spark, d), share=0.6)


@query("x_bcast", V.OBS + "SELECT peer FROM obs GROUP BY peer HAVING count(DISTINCT txid) >= 0.2 * (SELECT count(DISTINCT txid) FROM obs)")
def x_bcast(spark, d):
    return N.broadcasters(V.observations(spark, d), 0.2)


@query(
    "agg_prop_tx",
    V.OBS
    + """, p AS (SELECT txid, peer, count(*) AS n, min(ms) AS a, max(ms) AS b FROM obs GROUP BY ALL), f AS (SELECT txid, sum(n)::BIGINT AS announcements, count(*) AS peers, min(a) AS first_ms, max(b) AS last_ms, max(n) AS top FROM p GROUP BY txid),
 fp AS (SELECT txid, peer AS first_peer FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY a, peer) AS rn FROM p) WHERE rn = 1), dp AS (SELECT txid, peer AS dominant_peer FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY n DESC, peer) AS rn FROM p) WHERE rn = 1),
 ob AS (SELECT txid, count(DISTINCT observer) AS observers FROM obs GROUP BY txid) SELECT txid, announcements, peers, observers, first_ms, last_ms, CASE WHEN announcements >= 2 THEN last_ms - first_ms END AS spread_ms, first_peer, dominant_peer, round(top / announcements, 6) AS dominant_share FROM f JOIN fp USING (txid) JOIN dp USING (txid) JOIN ob USING (txid)""",
)
def agg_prop_tx(spark, d):
    return N.propagation(V.observations(spark, d))


@query(
    "agg_prop_pool",
    V.OBS
    + """, e AS (SELECT observer, txid, max(ms) - min(ms) AS spread, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY spread, txid) AS place, count(*) OVER (PARTITION BY observer) AS size FROM e)
 SELECT observer, max(size) AS n_txs, sum(n)::BIGINT AS announcements, max(CASE WHEN place = size // 2 + 1 THEN spread END) AS median_spread_ms, (SELECT count(DISTINCT peer) FROM obs o WHERE o.observer = r.observer) AS peers FROM r GROUP BY observer""",
)
def agg_prop_pool(spark, d):
    return N.pooled(V.observations(spark, d))


@query("x_arr_sum", V.OBS + f", {ARRIVE} SELECT observer, count(*) AS n_txs, count(*) FILTER (rank = 1) AS n_first, round(quantile_cont(offset_ms, 0.5), 3) AS p50, round(quantile_cont(offset_ms, 0.9), 3) AS p90, round(avg(CASE WHEN spread_ms <= 250 THEN 1.0::DOUBLE ELSE 0 END), 6) AS flat_share FROM arrive GROUP BY observer")
def x_arr_sum(spark, d):
    return N.arrival_summary(V.observations(spark, d))


@query("j_correlate", V.EDGE + f", {V.OBS_SQL}, t AS (SELECT DISTINCT txid FROM edge), s AS (SELECT txid AS seen, count(*) AS announcements FROM obs GROUP BY 1) SELECT coalesce(txid, seen) AS txid, CASE WHEN txid IS NULL THEN 'UNMATCHED' WHEN seen IS NULL THEN 'NO_NETWORK' ELSE 'CORRELATED' END AS status, coalesce(announcements, 0) AS announcements FROM t FULL JOIN s ON txid = seen")
def j_correlate(spark, d):
    return N.correlate(V.edges(spark, d).select("txid").distinct(), V.observations(spark, d))


@query("j_overlap_guard", V.OBS + ", i AS (SELECT DISTINCT txid FROM obs WHERE txid IS NOT NULL) SELECT count(*) AS observed, count(o_orderkey) AS matched, round(count(o_orderkey) / count(*), 6) AS share FROM i LEFT JOIN orders ON o_orderkey = txid")
def j_overlap_guard(spark, d):
    return N.overlap(table(spark, d, "orders").select(F.col("o_orderkey").alias("txid")), V.observations(spark, d))


@query(
    "j_geoip",
    "SELECT ip, s_name AS owner FROM (SELECT DISTINCT l_partkey AS ip FROM lineitem) LEFT JOIN supplier ON ip BETWEEN s_suppkey * 20 AND s_suppkey * 20 + 12",
)
def j_geoip(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ip")).distinct()
    ranges = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("lo"), (F.col("s_suppkey") * 20 + 12).alias("hi"), F.col("s_name").alias("owner"))
    return N.range_lookup(points, ranges)


# --- clusters -------------------------------------------------------------------------------------------------------

CLUSTERS = (
    f"WITH RECURSIVE {V.EDGE_SQL}, {STAR}"
    + """, nodes AS (SELECT DISTINCT step, address, lpad(step::VARCHAR, 3, '0') || ':' || address AS node FROM edge WHERE role = 'in'), links AS (SELECT lpad(step::VARCHAR, 3, '0') || ':' || center AS src, lpad(step::VARCHAR, 3, '0') || ':' || address AS dst FROM star),
 und AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT dst, root FROM reach JOIN und ON node = src),
 clusters AS (SELECT step, address, min(root) AS cluster_id FROM reach JOIN nodes USING (node) GROUP BY step, address) """
)


def _clusters(spark, d):
    e = V.edges(spark, d)
    return e, checkpoint(C.monthly_clusters(e))


def _classes(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"), (F.col("p_size") % 3).alias("class"))


@query("cluster_cospend", CLUSTERS + "SELECT cluster_id, count(DISTINCT e.address) AS n_addresses, count(DISTINCT txid) AS n_txs, round(sum(amount), 2) AS total_amount FROM edge e JOIN clusters c ON e.step = c.step AND e.address = c.address WHERE role = 'in' GROUP BY cluster_id")
def cluster_cospend(spark, d):
    e, c = _clusters(spark, d)
    return C.cluster_summary(e, c)


@query("cluster_index", CLUSTERS + ", s AS (SELECT cluster_id, count(*) AS size, min(address) AS representative FROM clusters GROUP BY 1 HAVING count(*) > 1) SELECT c.*, size, representative FROM clusters c JOIN s USING (cluster_id)")
def cluster_index(spark, d):
    return C.cluster_index(_clusters(spark, d)[1])


@query("g_cluster_run", CLUSTERS + ", s AS (SELECT step, cluster_id, count(*) AS size FROM clusters GROUP BY ALL) SELECT step, sum(size)::BIGINT AS addresses, count(*) AS clusters, (sum(size) - count(*))::BIGINT AS merges, max(size) AS largest, list_sort(list(size), 'DESC')[2] AS second, round(coalesce(sum(size) FILTER (size > 1), 0) / sum(size), 6) AS coverage FROM s GROUP BY step")
def g_cluster_run(spark, d):
    return C.merge_counters(_clusters(spark, d)[1])


@query(
    "agg_purity",
    CLUSTERS
    + """, k AS (SELECT cluster_id, count(*) AS size, count(*) FILTER (p_size % 3 = 1) AS bad, count(*) FILTER (p_size % 3 = 2) AS good FROM clusters LEFT JOIN part ON address = 'A' || p_partkey GROUP BY 1), h AS (SELECT *, bad + good AS known, bad / CASE WHEN bad + good > 0 THEN bad + good END AS p FROM k)
 SELECT cluster_id, size, bad, good, round(known / size, 6) AS coverage, CASE WHEN known > 0 THEN round(greatest(bad, good) / known, 6) END AS purity, CASE WHEN known > 0 THEN round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END, 6) END AS entropy,
 CASE WHEN known = 0 THEN 'NONE' WHEN bad = good THEN 'TIE' WHEN bad > good THEN 'BAD' ELSE 'GOOD' END AS majority, bad > 0 AND good > 0 AS contaminated FROM h""",
)
def agg_purity(spark, d):
    return C.purity(_clusters(spark, d)[1], _classes(spark, d))


CELLS = CLUSTERS + ", cells AS (SELECT p_brand AS entity, cluster_id, count(*) AS n FROM clusters JOIN part ON address = 'A' || p_partkey GROUP BY ALL) "


def _cells(spark, d):
    entities = table(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"), F.col("p_brand").alias("entity"))
    return C.contingency(_clusters(spark, d)[1], entities)


@query("agg_conting", CELLS + "SELECT * FROM cells")
def agg_conting(spark, d):
    return _cells(spark, d)


@query(
    "agg_micro",
    CELLS
    + """, s AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS n FROM cells), c AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster_id)), e AS (SELECT sum(n * (n - 1) / 2) AS e FROM (SELECT sum(n) AS n FROM cells GROUP BY entity)),
 r AS (SELECT *, tp / c AS p, tp / e AS r FROM s, c, e) SELECT tp::BIGINT AS tp, (c - tp)::BIGINT AS fp, (e - tp)::BIGINT AS fn, (n * (n - 1) / 2 - c - e + tp)::BIGINT AS tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
)
def agg_micro(spark, d):
    return C.micro(checkpoint(_cells(spark, d)))


@query(
    "agg_macro",
    CELLS
    + """, s AS (SELECT cluster_id, sum(n) AS size FROM cells GROUP BY 1), g AS (SELECT entity, sum(n)::BIGINT AS members, count(*) AS clusters, sum(n * (n - 1) / 2) AS tp, sum(n * (size - n)) AS other FROM cells JOIN s USING (cluster_id) GROUP BY entity)
 SELECT entity, members, clusters, round(CASE WHEN tp + other > 0 THEN tp / (tp + other) END, 6) AS precision, round(CASE WHEN members > 1 THEN tp / (members * (members - 1) / 2) END, 6) AS recall,
 CASE WHEN clusters > 1 AND other > 0 THEN 'SPLIT+MERGED' WHEN clusters > 1 THEN 'SPLIT' WHEN other > 0 THEN 'MERGED' ELSE 'PERFECT' END AS verdict FROM g""",
)
def agg_macro(spark, d):
    return C.macro(_cells(spark, d))


# --- walks ----------------------------------------------------------------------------------------------------------

LINKS = f"{V.EDGE_SQL}, {FLOWS}, links AS (SELECT DISTINCT payer AS src, payee AS dst FROM flow), seeds AS (SELECT 'A' || p_partkey AS vertex FROM part WHERE p_size = 1)"


def _links(spark, d):
    seeds = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("vertex"))
    return checkpoint(A.flows(V.edges(spark, d)).select(F.col("payer").alias("src"), F.col("payee").alias("dst")).distinct()), seeds


def _hop(i):
    return f"h{i} AS MATERIALIZED (SELECT dst AS vertex, {i} AS hop, min(src) AS via FROM h{i - 1} JOIN links ON vertex = src WHERE hop = {i - 1} AND dst NOT IN (SELECT vertex FROM h{i - 1}) GROUP BY dst UNION ALL SELECT * FROM h{i - 1})"


@query("g_paths", f"WITH {LINKS}, h0 AS MATERIALIZED (SELECT vertex, 0 AS hop, NULL::VARCHAR AS via FROM seeds), " + ", ".join(map(_hop, (1, 2, 3))) + " SELECT * FROM h3")
def g_paths(spark, d):
    return R.nearest_seed(*_links(spark, d))


def _rank(i):
    held = f"h{i} AS MATERIALIZED (SELECT txid, sum(r * leave) AS held FROM r{i - 1} JOIN walk USING (address) GROUP BY txid)"
    return held + f", r{i} AS MATERIALIZED (SELECT b.address, 0.3::DOUBLE * b.own + 0.7::DOUBLE * coalesce(f.flow, 0) AS r FROM base b LEFT JOIN (SELECT address, sum(held * arrive) AS flow FROM h{i} JOIN walk USING (txid) GROUP BY address) f USING (address))"


@query(
    "g_ppr",
    V.EDGE
    + """, pairs AS MATERIALIZED (SELECT DISTINCT address, txid FROM edge), calm AS (SELECT address, txid, count(*) OVER (PARTITION BY txid) AS size FROM pairs), kept AS (SELECT * FROM calm WHERE size <= 500),
 walk AS MATERIALIZED (SELECT address, txid, 1.0::DOUBLE / count(*) OVER (PARTITION BY address) AS leave, 1.0::DOUBLE / size AS arrive FROM kept), marked AS (SELECT DISTINCT address, address IN (SELECT 'A' || p_partkey FROM part WHERE p_size = 1) AS seed FROM pairs),
 base AS MATERIALIZED (SELECT address, seed, CASE WHEN seed THEN 1.0::DOUBLE / (SELECT count(*) FROM marked WHERE seed) ELSE 0 END AS own FROM marked), r0 AS MATERIALIZED (SELECT address, own AS r FROM base), """
    + ", ".join(_rank(i) for i in range(1, 41))
    + " SELECT address, round(CASE WHEN seed THEN 1 ELSE least(1, r * (SELECT count(*) FROM marked WHERE seed) / 0.3::DOUBLE) END, 6) AS score FROM r40 JOIN base USING (address)",
)
def g_ppr(spark, d):
    return R.personalised_rank(V.edges(spark, d), _links(spark, d)[1])


def _trace(i):
    return f"""p{i} AS MATERIALIZED (SELECT address, min(o.step) AS since FROM t{i - 1} JOIN outs o USING (txid) WHERE hop = {i - 1} GROUP BY address),
 t{i} AS MATERIALIZED (SELECT txid, min(ins.step) AS step, {i} AS hop FROM ins JOIN p{i} USING (address) WHERE ins.step > since AND txid NOT IN (SELECT txid FROM t{i - 1}) GROUP BY txid UNION ALL SELECT * FROM t{i - 1})"""


@query(
    "g_trace",
    f"WITH {V.EDGE_SQL}, busy AS (SELECT address FROM edge GROUP BY address HAVING count(DISTINCT txid) > 200), ins AS MATERIALIZED (SELECT DISTINCT txid, address, step FROM edge WHERE role = 'in' AND address NOT IN (SELECT address FROM busy)), outs AS MATERIALIZED (SELECT DISTINCT txid, address, step FROM edge WHERE role = 'out' AND address NOT IN (SELECT address FROM busy)),"
    + " t1 AS MATERIALIZED (SELECT txid, min(step) AS step, 1 AS hop FROM ins WHERE address IN (SELECT 'A' || p_partkey FROM part WHERE p_size = 1) GROUP BY txid), "
    + ", ".join(map(_trace, (2, 3, 4)))
    + " SELECT txid, step, hop FROM t4",
)
def g_trace(spark, d):
    start = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"))
    return R.money_trace(checkpoint(V.edges(spark, d)), start)


@query("g_superlinear", V.EDGE + ", s AS (SELECT step, count(DISTINCT txid) AS t, count(DISTINCT address) AS a FROM edge GROUP BY step), w AS (SELECT step, regr_slope(ln(a), ln(t)) OVER (ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS slope, count(*) OVER (ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM s) SELECT step, round(slope, 6) AS slope FROM w WHERE n = 12")
def g_superlinear(spark, d):
    """Slope of log addresses over log transactions in windows of twelve steps; a table of one row a step."""
    from pyspark.sql import Window as W

    s = V.edges(spark, d).groupBy("step").agg(F.count_distinct("txid").alias("t"), F.count_distinct("address").alias("a"))
    w = W.orderBy("step").rowsBetween(-11, 0)
    return s.select("step", F.regr_slope(F.ln("a"), F.ln("t")).over(w).alias("slope"), F.count("*").over(w).alias("n")).where("n = 12").select("step", F.round("slope", 6).alias("slope"))


# --- metrics --------------------------------------------------------------------------------------------------------

SCORED = "WITH s AS (SELECT doc_id AS id, least(n_chars, 20000) / 20000 AS score, toxic::BIGINT AS label FROM documents JOIN labels USING (doc_id)) "


def _scored(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), (F.least("n_chars", F.lit(20000)) / 20000).alias("score"), F.col("toxic").cast("long").alias("label"))


@query("j_labels", SCORED + "SELECT * FROM s")
def j_labels(spark, d):
    return _scored(spark, d)


@query(
    "m_metrics",
    SCORED
    + """, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)), t AS (SELECT sum(label) AS p, count(*) AS n FROM s),
 a AS (SELECT sum(pos / t.p * tp / seen) AS ap, sum((c.n - pos) * (tp - pos / 2)) AS area FROM c, t) SELECT n, p::BIGINT AS positives, round(ap, 6) AS average_precision, round((ap - p / n) / (1 - p / n), 6) AS normalised_ap, round(area / (p * (n - p)), 6) AS roc_auc FROM a, t""",
)
def m_metrics(spark, d):
    return M.curve_metrics(_scored(spark, d))


@query(
    "w_rank_metrics",
    SCORED
    + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM s), t AS (SELECT sum(label) AS p, count(*) AS n FROM s), k AS (SELECT unnest([10, 50, 100])::INT AS k),
 h AS (SELECT k, sum(label)::BIGINT AS hits, sum(label / log2(place + 1)) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(k, (SELECT p FROM t))::BIGINT) x(i)) AS ideal FROM r JOIN k ON place <= k GROUP BY k)
 SELECT k, hits, round(hits / k, 6) AS precision, round(hits / p, 6) AS recall, round(hits / k / (p / n), 6) AS lift, round(dcg / ideal, 6) AS ndcg FROM h, t""",
)
def w_rank_metrics(spark, d):
    return M.at_k(_scored(spark, d), (10, 50, 100))


@query(
    "m_protocol_bounds",
    SCORED
    + """, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)), x AS (SELECT * FROM c WHERE seen >= 100 ORDER BY seen LIMIT 1)
 SELECT 100 AS k, round((tp - pos + greatest(0, 100 - (seen - n) - (n - pos))) / 100, 6) AS low, round((tp - pos + least(100 - (seen - n), pos)) / 100, 6) AS high FROM x""",
)
def m_protocol_bounds(spark, d):
    return M.precision_bounds(_scored(spark, d), 100)


@query("m_calibration", SCORED + "SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed, round(avg(power(score - label, 2)), 6) AS brier FROM s GROUP BY 1")
def m_calibration(spark, d):
    return M.calibration(_scored(spark, d))


@query(
    "w_bands",
    SCORED
    + """, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)),
 m AS (SELECT score, seen, min(tp / seen) OVER (ORDER BY score DESC) AS low FROM c WHERE seen >= 50) SELECT min(score) AS threshold, max(seen)::BIGINT AS support FROM m WHERE low >= 0.05""",
)
def w_bands(spark, d):
    return M.bands(_scored(spark, d), 0.05)


@query("m_holm", V.EDGE + ", t AS (SELECT step AS test, 1.0::DOUBLE / (1 + count(DISTINCT txid)) AS p FROM edge GROUP BY step) SELECT test, round(p, 8) AS p, round(max(least(1.0::DOUBLE, n * p)) OVER (ORDER BY p, test), 8) AS adjusted FROM (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1 AS n FROM t)")
def m_holm(spark, d):
    return M.holm(V.edges(spark, d).groupBy(F.col("step").alias("test")).agg((1.0 / (1 + F.count_distinct("txid"))).alias("p")))


@query("f_logchoose", V.EDGE + ", c AS (SELECT address, count(*) AS n, count(*) FILTER (role = 'in') AS k FROM edge GROUP BY 1) SELECT address, n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) AS log_choose FROM c")
def f_logchoose(spark, d):
    c = V.edges(spark, d).groupBy("address").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == "in", 1)).alias("k"))
    return c.select("address", "n", "k", F.round(F.abs(M.log_choose(F.col("n"), F.col("k"))), 6).alias("log_choose"))


AUDITED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("m_featdiag", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct, min({c}) AS low, max({c}) AS high, count(DISTINCT {c}) <= 1 AS constant FROM lineitem".replace("AS distinct", 'AS "distinct"') for c in AUDITED))
def m_featdiag(spark, d):
    return M.feature_audit(table(spark, d, "lineitem"), AUDITED)


@query("m_featdup", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(max(abs({a} - {b})), 4) AS largest, max(abs({a} - {b})) <= 1e-9 AS duplicate FROM lineitem" for i, a in enumerate(AUDITED) for b in AUDITED[i + 1 :]))
def m_featdup(spark, d):
    return M.duplicate_features(table(spark, d, "lineitem"), AUDITED)


# --- captures -------------------------------------------------------------------------------------------------------


@query(
    "split_list",
    V.EDGE
    + """, c AS (SELECT txid, list_sort(list(address)) AS items FROM edge GROUP BY txid) SELECT txid, len(items)::INT AS n, array_to_string(items, ',') AS items FROM c""",
)
def split_list(spark, d):
    sep = F.when(F.col("txid") % 3 == 0, ";").when(F.col("txid") % 3 == 1, "|").otherwise(" ")
    cells = V.edges(spark, d).groupBy("txid").agg(F.sort_array(F.collect_list("address")).alias("a")).select("txid", F.array_join("a", ",").alias("joined"), sep.alias("sep"))
    cells = cells.select("txid", S.split_list(F.replace(F.col("joined"), F.lit(","), F.col("sep"))).alias("items"))
    return cells.select("txid", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


@query("dedup", V.OBS + "SELECT txid, observer, count(*) AS rows, count(DISTINCT peer) AS kept, count(*) - count(DISTINCT peer) AS dropped FROM obs GROUP BY ALL")
def dedup(spark, d):
    """Announcements of one transaction by one peer at one observer are one; the first stays."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("txid", "observer", "peer").orderBy("ms", "obs_id"))
    o = V.observations(spark, d).withColumn("nth", nth)
    kept = F.count(F.when(F.col("nth") == 1, 1))
    return o.groupBy("txid", "observer").agg(F.count("*").alias("rows"), kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


@query("key_chain", V.EDGE + ", p AS (SELECT txid, address || '=' || CAST(round(amount * 100) AS BIGINT) AS p FROM edge) SELECT txid, sha256(txid || '|' || string_agg(p, ',' ORDER BY p)) AS chain_key FROM p GROUP BY txid")
def key_chain(spark, d):
    p = F.concat_ws("=", "address", F.round(F.col("amount") * 100).cast("long").cast("string"))
    return V.edges(spark, d).groupBy("txid").agg(F.sha2(F.concat_ws("|", F.col("txid").cast("string"), F.array_join(F.sort_array(F.collect_list(p)), ",")), 256).alias("chain_key"))


CAP = """cap AS (SELECT event_id, (event_id * 37) % 70000 AS port, CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN '999.1.1.1' WHEN event_id % 13 = 0 THEN 'zz:' END AS bad_ip, user_id * 100000000 AS asn,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE (CASE WHEN event_id % 3 = 1 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000 // 1000 * 1000 END) - CASE WHEN event_id % 19 = 0 THEN 946684800000 ELSE 0 END + CASE WHEN event_id % 29 = 0 THEN 3155760000000 ELSE 0 END END AS ms FROM events)"""


def _capture(spark, d):
    """Rows of a capture with times in three forms (some unreadable, too early or too late) and addresses of both versions, some of them none."""
    n, own = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    ms = own - F.when(n % 19 == 0, 946_684_800_000).otherwise(0) + F.when(n % 29 == 0, 3_155_760_000_000).otherwise(0)
    stamp = F.when(n % 17 == 0, "soon").when(n % 3 == 0, F.floor(ms / 1000).cast("string")).when(n % 3 == 1, ms.cast("string")).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"))
    port = ((n * 37) % 70000).cast("double")
    src, dst = F.when(n % 7 == 0, "bad").when(n % 11 == 0, "999.1.1.1").when(n % 5 == 0, "::ffff:1.2.3.4").otherwise("10.0.0.1"), F.when(n % 13 == 0, "zz:").when(n % 2 == 0, "2001:db8::1")
    return table(spark, d, "events").select("event_id", stamp.alias("timestamp"), port.alias("src_port"), port.alias("dst_port"), src.alias("src_ip"), dst.alias("dst_ip"), (F.col("user_id") * 100000000).cast("double").alias("asn"))


@query("f_ts_ms", f"WITH {CAP} SELECT event_id, ms FROM cap")
def f_ts_ms(spark, d):
    return _capture(spark, d).select("event_id", S.timestamp_ms(F.col("timestamp")).alias("ms"))


@query("contract_rows", f"WITH {CAP} SELECT coalesce(CASE WHEN ms < 1230768000000 OR ms > 4102531200000 THEN 'timestamp' WHEN port > 65535 THEN 'port' WHEN bad_ip IS NOT NULL THEN 'ip' WHEN asn > 4294967295 THEN 'asn' END, 'ok') AS kind, count(*) AS n FROM cap GROUP BY 1")
def contract_rows(spark, d):
    return _capture(spark, d).groupBy(F.coalesce(S.violations(4102444800), F.lit("ok")).alias("kind")).agg(F.count("*").alias("n"))


IP_CLASS = """CASE WHEN ip <= 16777215 THEN 'this-network' WHEN ip BETWEEN 167772160 AND 184549375 THEN 'private' WHEN ip BETWEEN 1681915904 AND 1686110207 THEN 'shared' WHEN ip BETWEEN 2130706432 AND 2147483647 THEN 'loopback'
 WHEN ip BETWEEN 2851995648 AND 2852061183 THEN 'link-local' WHEN ip BETWEEN 2886729728 AND 2887778303 THEN 'private' WHEN ip BETWEEN 3221225472 AND 3221225727 THEN 'protocol' WHEN ip BETWEEN 3221225984 AND 3221226239 THEN 'documentation'
 WHEN ip BETWEEN 3227017984 AND 3227018239 THEN 'relay' WHEN ip BETWEEN 3232235520 AND 3232301055 THEN 'private' WHEN ip BETWEEN 3323068416 AND 3323199487 THEN 'benchmarking' WHEN ip BETWEEN 3325256704 AND 3325256959 THEN 'documentation'
 WHEN ip BETWEEN 3405803776 AND 3405804031 THEN 'documentation' WHEN ip BETWEEN 3758096384 AND 4026531839 THEN 'multicast' WHEN ip = 4294967295 THEN 'broadcast' WHEN ip >= 4026531840 THEN 'reserved' ELSE 'global' END"""


@query("f_ip_class", f"WITH e AS (SELECT event_id, (event_id * 2654435 + user_id * 16777259) % 4294967296 AS ip FROM events) SELECT event_id, {IP_CLASS} AS ip_class FROM e")
def f_ip_class(spark, d):
    ip = (F.col("event_id") * 2654435 + F.col("user_id") * 16777259) % 4294967296
    dotted = F.concat_ws(".", *[(F.floor(ip / 2**s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return table(spark, d, "events").select("event_id", S.ip_class(S.ipv4_number(dotted)).alias("ip_class"))


@query("f_asn", "SELECT event_id, CASE WHEN a BETWEEN 64512 AND 65534 OR a BETWEEN 4200000000 AND 4294967294 THEN 'private' WHEN a IN (0, 65535, 4294967295) THEN 'reserved' WHEN a BETWEEN 64496 AND 64511 OR a BETWEEN 65536 AND 65551 THEN 'documentation' ELSE 'public' END AS asn_class FROM (SELECT event_id, (event_id * 64513) % 4294967296 AS a FROM events)")
def f_asn(spark, d):
    return table(spark, d, "events").select("event_id", S.asn_class((F.col("event_id") * 64513) % 4294967296).alias("asn_class"))


@query("correlatable", V.EDGE + f", {V.OBS_SQL} SELECT (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT txid) FROM edge) AS txids, (SELECT count(DISTINCT address) FROM edge) AS addresses, (SELECT count(*) FROM obs) AS announcements, (SELECT count(DISTINCT peer) FROM obs) AS peers, (SELECT max(ms) - min(ms) FROM obs) AS span_ms")
def correlatable(spark, d):
    e = V.edges(spark, d).agg(F.count("*").alias("edges"), F.count_distinct("txid").alias("txids"), F.count_distinct("address").alias("addresses"))
    o = V.observations(spark, d).agg(F.count("*").alias("announcements"), F.count_distinct("peer").alias("peers"), (F.max("ms") - F.min("ms")).alias("span_ms"))
    return e.join(F.broadcast(o))


@query("chain_index", V.TX + "SELECT e.address, e.txid, e.role, tx.step, n_in, n_out, round(tx.fee, 2) AS fee FROM (SELECT DISTINCT address, txid, role FROM edge) e JOIN tx ON e.txid = tx.txid")
def chain_index(spark, d):
    e = V.edges(spark, d)
    return e.select("address", "txid", "role").distinct().join(V.transactions(e).select("txid", "step", "n_in", "n_out", F.round("fee", 2).alias("fee")), "txid")


@query("j_anti", V.EDGE + "SELECT DISTINCT address FROM edge WHERE address NOT IN (SELECT address FROM edge GROUP BY address HAVING count(DISTINCT txid) > 30)")
def j_anti(spark, d):
    e = V.edges(spark, d)
    return e.select("address").distinct().join(A.tx_degree(e).where("degree > 30"), "address", "left_anti")


@query("o_page", V.EDGE + ", p AS (SELECT address, round(sum(amount), 2) AS total FROM edge GROUP BY 1) SELECT address, total FROM p ORDER BY total DESC, address LIMIT 50 OFFSET 100")
def o_page(spark, d):
    """One page of a ranking; the limit is the feature."""
    totals = V.edges(spark, d).groupBy("address").agg(F.round(F.sum("amount"), 2).alias("total"))
    return totals.orderBy(F.desc("total"), "address").offset(100).limit(50)


@query("o_prefix", "SELECT DISTINCT 'A' || l_partkey AS address FROM lineitem WHERE 'A' || l_partkey LIKE 'A19%'")
def o_prefix(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("address")).where(F.col("address").startswith("A19")).distinct()
