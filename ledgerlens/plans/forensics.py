"""Registered queries for whole-history clusters, traces, capture checks, tests and scorecards; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as L
from ledgerlens.functions import statistics as T
from ledgerlens.operators import addresses as A
from ledgerlens.operators import clusters as C
from ledgerlens.operators import golden as Q
from ledgerlens.operators import metrics as M
from ledgerlens.operators import network as N
from ledgerlens.operators import ranges as G
from ledgerlens.operators import transactions as X
from ledgerlens.operators import traversal as R
from ledgerlens.plans import views as V
from ledgerlens.plans.catalog import ARRIVE, FLOWS, HOPS, SCORED, STAR, _classes, _scored, query
from ledgerlens.session import checkpoint, table
from ledgerlens.sources import capture as S
from ledgerlens.sources import contracts as K

# --- clusters over the whole history ----------------------------------------------------------------------------------


def _reach(name, nodes, links):
    """SQL for components by keyed recursion: each node's least label, passed on until none falls."""
    return f"""{name}_und AS MATERIALIZED (SELECT src, dst FROM {links} UNION SELECT dst, src FROM {links}),
 {name}(node, root) USING KEY (node) AS (SELECT node, node FROM {nodes} UNION SELECT u.dst, min(c.root) FROM {name} c JOIN {name}_und u ON u.src = c.node JOIN recurring.{name} r ON r.node = u.dst WHERE c.root < r.root GROUP BY u.dst)"""


WHOLE = f"WITH RECURSIVE {V.EDGE_SQL}, {STAR}, nodes AS (SELECT DISTINCT address AS node FROM edge WHERE role = 'in'), links AS (SELECT DISTINCT center AS src, address AS dst FROM star), " + _reach("whole", "nodes", "links")


@query("g_cluster", WHOLE + " SELECT root AS cluster_id, count(DISTINCT address) AS n_addresses, count(DISTINCT txid) AS n_txs, round(sum(amount), 2) AS total_amount FROM edge JOIN whole ON address = node WHERE role = 'in' GROUP BY root")
def g_cluster(spark, d):
    """Entities over the whole history, and what they spent."""
    e = V.edges(spark, d)
    ins = e.where("role = 'in'").join(C.history_clusters(e), "address")
    return ins.groupBy("cluster_id").agg(F.count_distinct("address").alias("n_addresses"), F.count_distinct("txid").alias("n_txs"), F.round(F.sum("amount"), 2).alias("total_amount"))


YEARS = (
    f"WITH RECURSIVE {V.EDGE_SQL}, {STAR}, yr AS (SELECT *, (step - 1) // 12 AS y FROM edge), ty AS (SELECT DISTINCT txid, y FROM yr), lasty AS (SELECT max(y) AS top FROM yr WHERE role = 'in'), ys AS (SELECT unnest(range((SELECT min(y) FROM yr), (SELECT top FROM lasty) + 1)) AS snap),"
    + """ nodes AS (SELECT snap, address, lpad(snap::VARCHAR, 6, '0') || ':' || address AS node FROM (SELECT address, min(y) AS y FROM yr WHERE role = 'in' GROUP BY 1) a JOIN ys ON snap >= a.y),
 links AS (SELECT DISTINCT lpad(snap::VARCHAR, 6, '0') || ':' || center AS src, lpad(snap::VARCHAR, 6, '0') || ':' || address AS dst FROM star JOIN ty USING (txid) JOIN ys ON snap >= ty.y), """
    + _reach("grown", "nodes", "links")
)


@query("g_evolution")
def g_evolution(spark, d):
    """How the clusters grow from step to step, by common inputs and with change outputs added; SQL is too slow for all steps
    (by years it is g_evolution_years, and tests compare all steps with brute force)."""
    e = checkpoint(V.edges(spark, d).select("txid", "pos", "address", "role", "ts", "step"))
    last = e.where("role = 'in'").agg(F.max("step")).first()[0]
    series = lambda mode, change: C.size_counters(C.growing_clusters(*C.spending_links(e, change), last).sizes()).withColumn("mode", F.lit(mode))
    return series("inputs", False).unionByName(series("inputs+change", True))


@query("w_cospend_asof")
def w_cospend_asof(spark, d):
    """The size of each address's cluster as it stood at the step of the address's own last spending; SQL as for g_evolution."""
    return _as_of(_spending(V.edges(spark, d))).withColumnRenamed("at", "step")


def _spending(e):
    """What clusters by common inputs need of the rows of inputs, checkpointed."""
    return checkpoint(e.where("role = 'in'").select("txid", "pos", "address", "role", "step"))


def _as_of(e):
    own = e.where("role = 'in'").groupBy(F.col("address").alias("vertex")).agg(F.max("step").alias("at"))
    return C.growing_clusters(*C.spending_links(e), own.agg(F.max("at")).first()[0]).size_of(own).withColumnRenamed("vertex", "address")


def _by_year(spark, d):
    return V.edges(spark, d).withColumn("year", F.floor((F.col("step") - 1) / 12).cast("int"))


@query(
    "g_evolution_years",
    YEARS
    + """, s AS (SELECT snap, root, count(*) AS size FROM nodes JOIN grown USING (node) GROUP BY ALL) SELECT snap AS step, sum(size)::BIGINT AS addresses, count(*) AS clusters, (sum(size) - count(*))::BIGINT AS merges, max(size) AS largest, list_sort(list(size), 'DESC')[2] AS second, round(coalesce(sum(size) FILTER (size > 1), 0) / sum(size), 6) AS coverage FROM s GROUP BY snap""",
)
def g_evolution_years(spark, d):
    """How the clusters grow: one row a year, over all spending until its end."""
    e = _spending(_by_year(spark, d).drop("step").withColumnRenamed("year", "step"))
    return C.size_counters(C.growing_clusters(*C.spending_links(e), e.where("role = 'in'").agg(F.max("step")).first()[0]).sizes())


@query(
    "w_cospend_years",
    YEARS
    + """, s AS (SELECT root, count(*) AS size FROM nodes JOIN grown USING (node) GROUP BY root), own AS (SELECT address, max(y) AS snap FROM yr WHERE role = 'in' GROUP BY 1) SELECT address, snap AS year, size FROM own JOIN nodes USING (address, snap) JOIN grown USING (node) JOIN s USING (root)""",
)
def w_cospend_years(spark, d):
    """The size of each address's cluster as it stood in the year of the address's own last spending."""
    return _as_of(_spending(_by_year(spark, d).drop("step").withColumnRenamed("year", "step"))).withColumnRenamed("at", "year")


@query("x_classes", WHOLE + ", k AS (SELECT root AS cluster_id, CASE WHEN p_size % 3 = 1 THEN 'BAD' WHEN p_size % 3 = 2 THEN 'GOOD' ELSE 'UNKNOWN' END AS class FROM whole LEFT JOIN part ON node = 'A' || p_partkey) SELECT cluster_id, class, count(*) AS n FROM k GROUP BY ALL")
def x_classes(spark, d):
    """Members of whole-history clusters by class; addresses without a label are UNKNOWN."""
    c = C.history_clusters(V.edges(spark, d)).join(_classes(spark, d), "address", "left")
    name = F.when(F.col("class") == 1, "BAD").when(F.col("class") == 2, "GOOD").otherwise("UNKNOWN")
    return c.groupBy("cluster_id", name.alias("class")).agg(F.count("*").alias("n"))


@query("agg_snapshot", WHOLE + ", s AS (SELECT root, count(*) AS size, count(*) FILTER (p_size % 3 = 1) > 0 AND count(*) FILTER (p_size % 3 = 2) > 0 AS mixed FROM whole LEFT JOIN part ON node = 'A' || p_partkey GROUP BY root) SELECT count(*) AS clusters, max(size) AS largest, list_sort(list(size), 'DESC')[2] AS second, round(coalesce(sum(size) FILTER (size > 1), 0) / sum(size), 6) AS coverage, count(*) FILTER (mixed) AS contaminated FROM s")
def agg_snapshot(spark, d):
    """One row about the clusters as they stand: number, two largest, share of addresses in clusters of several, contaminated ones."""
    c = checkpoint(C.history_clusters(V.edges(spark, d)))
    sizes = C.merge_counters(c.withColumn("step", F.lit(1))).select("clusters", "largest", "second", "coverage")
    bad = C.purity(c, _classes(spark, d)).agg(F.count_if("contaminated").alias("contaminated"))
    return sizes.join(F.broadcast(bad))


# --- traces -----------------------------------------------------------------------------------------------------------


def _hop_sql(i):
    return f"""m{i} AS MATERIALIZED (SELECT DISTINCT txid, way FROM a{i - 1} JOIN leaving USING (address) WHERE hop = {i - 1}),
 a{i} AS MATERIALIZED (SELECT DISTINCT address, {i} AS hop FROM m{i} JOIN arriving USING (txid, way) WHERE address NOT IN (SELECT address FROM a{i - 1}) UNION ALL SELECT * FROM a{i - 1})"""


def _trace_sql(ways, first, last, start, cap):
    return (
        V.EDGE
        + f""", calm AS (SELECT txid FROM edge GROUP BY txid HAVING count(*) <= 200), r AS MATERIALIZED (SELECT DISTINCT txid, address, CASE WHEN role = 'in' THEN 1 ELSE -1 END AS way, step FROM edge WHERE txid IN (SELECT txid FROM calm)),
 leaving AS MATERIALIZED (SELECT DISTINCT address, txid, way FROM r WHERE way IN {ways} AND step BETWEEN {first} AND {last}), arriving AS MATERIALIZED (SELECT DISTINCT txid, -way AS way, address FROM r WHERE -way IN {ways}),
 a0 AS MATERIALIZED (SELECT DISTINCT address, 0 AS hop FROM edge WHERE {start}), """
        + ", ".join(map(_hop_sql, (1, 2, 3)))
        + f""", t AS (SELECT txid, min(hop) AS hop FROM (SELECT txid, 1 AS hop FROM m1 UNION ALL SELECT txid, 2 FROM m2 UNION ALL SELECT txid, 3 FROM m3) GROUP BY 1), n AS (SELECT 'address' AS kind, address AS node, hop FROM a3 UNION ALL SELECT 'transaction', txid::VARCHAR, hop FROM t)
 SELECT kind, node, hop, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) > {cap} FROM n) AS truncated FROM n ORDER BY hop, kind, node LIMIT {cap}"""
    )


@query("g_trace_both", _trace_sql("(1, -1)", -1000, 1000, "address IN ('A7', 'A42')", 2000))
def g_trace_both(spark, d):
    """Money around two addresses, both ways, cut at 2000 nodes."""
    return R.trace(V.edges(spark, d), spark.createDataFrame([("A7",), ("A42",)], "address string"), "both", 3, 2000)


@query("g_trace_up", _trace_sql("(-1)", 1, 24, "address IN (SELECT 'A' || p_partkey FROM part WHERE p_size = 2)", 10_000_000))
def g_trace_up(spark, d):
    """Where the money of many addresses came from, within two years."""
    start = table(spark, d, "part").where("p_size = 2").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"))
    return R.trace(V.edges(spark, d), start, "upstream", 3, 10_000_000, first=1, last=24)


# --- captures ---------------------------------------------------------------------------------------------------------


def _dirty(spark, d):
    """Capture rows of the transactions, some of them broken by rules on their ids."""
    e, at = V.edges(spark, d), lambda n: F.col("txid") % n == 0
    amount = F.when(at(11) & (F.col("pos") == 1), -F.col("amount")).otherwise(F.col("amount"))
    address = F.when(at(17) & (F.col("pos") == 2), " ").otherwise(F.col("address"))
    row = F.sort_array(F.collect_list(F.struct("pos", "role", address.alias("address"), amount.cast("string").alias("amount"))))
    time = F.min(F.unix_timestamp("ts") + 20 * 365 * 86400).cast("string")
    tx = e.groupBy("txid").agg(time.alias("timestamp"), F.sum(F.when(F.col("role") == "in", F.col("amount"))).alias("total"), F.sum("fee").alias("fee"), row.alias("r"))
    side = lambda role, c: F.transform(F.filter("r", lambda x: x["role"] == role), lambda x: x[c])
    outs = side("out", "amount")
    fee = F.when(at(29), -1.0).when(at(13), F.col("total") + 1).otherwise(F.least("fee", F.col("total") / 2))
    rows = tx.select(F.col("txid"), F.when(at(41), "soon").otherwise(F.col("timestamp")).alias("timestamp"), side("in", "address").alias("input_addresses"), side("in", "amount").alias("input_amounts"), side("out", "address").alias("output_addresses"), F.when(at(19), F.slice(outs, 1, F.greatest(F.size(outs) - 1, F.lit(0)))).otherwise(outs).alias("output_amounts"), fee.alias("fee"), F.when(at(31), "999.1.1.1").otherwise("10.0.0.1").alias("src_ip"), F.when(at(37), "zz:").otherwise("2001:db8::1").alias("dst_ip"))
    # the same transaction again with another fee: every second time in a row that no capture could hold
    again = rows.where(at(23)).withColumn("fee", F.col("fee") + 0.5).withColumn("timestamp", F.when(at(46), "9999-01-01").otherwise("4000000000"))
    return S.canonical(rows.unionByName(again).withColumn("txid", F.col("txid").cast("string")))


#: Rows by what is wrong with them, and transactions by what the rows that stay say about them.
DIRTY = (
    V.EDGE
    + """, t AS (SELECT txid, count(*) FILTER (role = 'out') AS n_out, bool_or(pos = 2) AS has2, bool_or(role = 'in') AS paid, txid % 11 = 0 AND bool_or(pos = 1) AS neg, txid % 31 = 0 OR txid % 37 = 0 AS bad_ip FROM edge GROUP BY txid),
 rows AS (SELECT txid, CASE WHEN bad_ip THEN 'ip' ELSE 'ok' END AS kind FROM t UNION ALL SELECT txid, CASE WHEN txid % 46 = 0 THEN 'timestamp' WHEN bad_ip THEN 'ip' ELSE 'ok' END FROM t WHERE txid % 23 = 0),
 k AS (SELECT txid::VARCHAR AS txid, list_sort(list_filter([CASE WHEN txid % 17 = 0 AND has2 THEN 'ADDRESS_INVALID' END, CASE WHEN txid % 19 = 0 AND n_out > 1 THEN 'AMOUNT_LIST_MISMATCH' END, CASE WHEN paid AND txid % 13 = 0 AND txid % 29 <> 0 AND NOT neg THEN 'FEE_EXCEEDS_INPUTS' END,
 CASE WHEN txid % 29 = 0 THEN 'NEGATIVE_FEE' END, CASE WHEN neg THEN 'NEGATIVE_OR_NONFINITE_AMOUNT' END, CASE WHEN txid % 23 = 0 AND txid % 46 <> 0 AND (paid OR txid % 13 <> 0 OR txid % 29 = 0) THEN 'CONFLICTING_CHAIN_FACTS' END], lambda x: x IS NOT NULL)) AS kinds FROM t WHERE NOT bad_ip),
 bad AS (SELECT * FROM k WHERE len(kinds) > 0), g AS (SELECT (SELECT count(*) FROM rows) AS n_rows, (SELECT count(*) FROM t) AS transactions, count(*) AS quarantined FROM bad) """
)
#: The time as of which the queries check captures: the year 2100.
NOW = 4_102_444_800


@query("contract_tx", DIRTY + "SELECT txid, array_to_string(kinds, ',') AS kinds FROM bad")
def contract_tx(spark, d):
    """What is wrong with each transaction put aside, by the rows that stay."""
    return K.enforce(_dirty(spark, d), NOW).kinds.select("txid", F.array_join("kinds", ",").alias("kinds"))


@query("contract_gate", DIRTY + "SELECT *, round(quarantined / transactions, 6) AS share, quarantined / transactions > 0.5 AS refused FROM g")
def contract_gate(spark, d):
    return K.enforce(_dirty(spark, d), NOW).gate


@query("contract_accepted", DIRTY + "SELECT txid::VARCHAR AS txid, count(*) AS n FROM rows, g WHERE kind = 'ok' AND txid::VARCHAR NOT IN (SELECT txid FROM bad) AND quarantined / transactions <= 0.5 GROUP BY txid")
def contract_accepted(spark, d):
    """The rows of a capture that may be used, by transaction."""
    return K.enforce(_dirty(spark, d), NOW).rows.groupBy("txid").agg(F.count("*").alias("n"))


@query("ingest", DIRTY + "SELECT 'transaction' AS part, kind, count(*) AS n FROM (SELECT unnest(kinds) AS kind FROM bad) GROUP BY 2 UNION ALL SELECT 'row', kind, count(*) FROM rows GROUP BY 2")
def ingest(spark, d):
    """The report of a capture's checks: rows and transactions by what is wrong with them."""
    return K.enforce(_dirty(spark, d), NOW).report


@query("x_obs", V.OBS + "SELECT observer, count(*) AS observations, count(DISTINCT txid) AS txids, count(DISTINCT peer) AS peers, min(ms) AS first_ms, max(ms) AS last_ms FROM obs WHERE txid IS NOT NULL AND peer IS NOT NULL GROUP BY observer")
def x_obs(spark, d):
    """Usable observations, by observer."""
    o = V.observations(spark, d).where("txid IS NOT NULL AND peer IS NOT NULL")
    return o.groupBy("observer").agg(F.count("*").alias("observations"), F.count_distinct("txid").alias("txids"), F.count_distinct("peer").alias("peers"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("x_outputs", V.EDGE + "SELECT txid, pos, address, amount FROM edge WHERE role = 'out'")
def x_outputs(spark, d):
    return V.edges(spark, d).where("role = 'out'").select("txid", "pos", "address", "amount")


@query("j_first_block", V.EDGE + ", f AS (SELECT address, min(step) AS first_step FROM edge GROUP BY 1) SELECT txid, pos, e.address, first_step, first_step = step AS fresh FROM edge e JOIN f ON e.address = f.address WHERE role = 'out'")
def j_first_block(spark, d):
    """Each output with the first step of its address."""
    e = V.edges(spark, d)
    return e.where("role = 'out'").join(A.first_last(e).drop("last_step"), "address").select("txid", "pos", "address", "first_step", (F.col("first_step") == F.col("step")).alias("fresh"))


@query("src_watchlist", "WITH w AS (SELECT 1 AS priority, 'sanctions' AS source, 'A' || p_partkey AS address, p_brand AS name FROM part WHERE p_size % 7 = 0 UNION ALL SELECT 2, 'lists', 'A' || ps, n FROM (SELECT s_suppkey AS ps, s_name AS n FROM supplier) UNION ALL SELECT 2, 'lists', 'A' || p_partkey, p_type FROM part WHERE p_size % 11 = 0) SELECT address, source, name FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY priority, name) AS rn FROM w) WHERE rn = 1")
def src_watchlist(spark, d):
    """Watched addresses of several lists; the first list that has an address names it."""
    part, a = table(spark, d, "part"), lambda c: F.concat(F.lit("A"), F.col(c).cast("string")).alias("address")
    row = lambda df, p, s, key, name: df.select(F.lit(p).alias("priority"), F.lit(s).alias("source"), a(key), F.col(name).alias("name"))
    w = row(part.where("p_size % 7 = 0"), 1, "sanctions", "p_partkey", "p_brand").unionByName(row(table(spark, d, "supplier"), 2, "lists", "s_suppkey", "s_name")).unionByName(row(part.where("p_size % 11 = 0"), 2, "lists", "p_partkey", "p_type"))
    return w.groupBy("address").agg(F.min(F.struct("priority", "name", "source")).alias("w")).select("address", "w.source", "w.name")


# --- scores of transactions and of hops -------------------------------------------------------------------------------


@query(
    "m_mix_score",
    V.TX
    + """, s AS (SELECT txid, n_in, n_out, CASE WHEN out_mean > 0 THEN (out_max - out_min) / out_mean END AS so, CASE WHEN in_mean > 0 THEN (in_max - in_min) / in_mean END AS si FROM tx),
 g AS (SELECT *, 1 - least(greatest((so - 0.02::DOUBLE) / 0.23::DOUBLE, 0), 1) AS u, least(greatest((si - 0.02::DOUBLE) / 0.23::DOUBLE, 0), 1) AS h, least(n_in, n_out)::DOUBLE / greatest(n_in, n_out) AS y, least(greatest((least(n_in, n_out) - 3) / 6::DOUBLE, 0), 1) AS c FROM s),
 p AS (SELECT *, CASE WHEN n_in <= 2 AND n_out >= 5 THEN 'batch' WHEN n_in >= 5 AND n_out <= 2 THEN 'consolidation' WHEN n_in <= 2 AND n_out <= 3 THEN 'ordinary' WHEN u > 0.5 AND n_in < 3 THEN 'uniform_payout' ELSE 'none' END AS suppressor, CASE WHEN so IS NOT NULL AND si IS NOT NULL AND n_in > 0 AND n_out > 0 THEN 0.4::DOUBLE * u + 0.25::DOUBLE * h + 0.2::DOUBLE * y + 0.15::DOUBLE * c END AS score FROM g)
 SELECT txid, suppressor, round(score, 6) AS mixing_score, CASE WHEN score IS NULL THEN 'INSUFFICIENT' WHEN suppressor = 'none' AND n_in >= 3 AND n_out >= 3 AND score >= 0.75 THEN 'PATTERN' WHEN suppressor = 'none' AND score >= 0.45 THEN 'LIKELIHOOD' ELSE 'NONE' END AS mixing FROM p""",
)
def m_mix_score(spark, d):
    return X.mixing_scores(V.transactions(V.edges(spark, d)))


@query("f_unit", V.OBS + f", {ARRIVE} SELECT txid, observer, round(CASE WHEN max(offset_ms) OVER (PARTITION BY txid) > 0 THEN offset_ms / max(offset_ms) OVER (PARTITION BY txid) ELSE 0 END, 6) AS unit FROM arrive")
def f_unit(spark, d):
    """Arrival offsets as shares of the transaction's largest; all 0 where that is 0."""
    a = N.arrivals(V.observations(spark, d))
    return a.select("txid", "observer", F.round(F.when(F.col("spread_ms") > 0, F.col("offset_ms") / F.col("spread_ms")).otherwise(0.0), 6).alias("unit"))


@query(
    "s_intersect",
    V.EDGE
    + f""", {V.OBS_SQL}, {HOPS}, fp AS (SELECT txid, peer, min(ms) AS ms FROM obs WHERE txid IS NOT NULL AND peer IS NOT NULL AND ms IS NOT NULL GROUP BY txid, peer), f AS (SELECT txid, peer FROM (SELECT *, dense_rank() OVER (PARTITION BY txid ORDER BY ms) AS r FROM fp) WHERE r <= 3),
 s AS (SELECT src, dst, count(*) AS shared FROM hops JOIN f a ON a.txid = src JOIN f b ON b.txid = dst AND a.peer = b.peer GROUP BY ALL) SELECT src, dst, shared FROM s""",
)
def s_intersect(spark, d):
    """Hops between transactions whose first announcing peers (those of the three earliest times) have some in common."""
    o = V.observations(spark, d).where("txid IS NOT NULL AND peer IS NOT NULL AND ms IS NOT NULL").groupBy("txid", "peer").agg(F.min("ms").alias("ms"))
    early = o.withColumn("r", F.dense_rank().over(W.partitionBy("txid").orderBy("ms"))).where("r <= 3").groupBy("txid").agg(F.collect_set("peer").alias("peers"))
    hops = X.hop_pairs(V.edges(spark, d)).select("src", "dst")
    both = hops.join(early.select(F.col("txid").alias("src"), F.col("peers").alias("a")), "src").join(early.select(F.col("txid").alias("dst"), F.col("peers").alias("b")), "dst")
    return both.select("src", "dst", F.size(F.array_intersect("a", "b")).cast("long").alias("shared")).where("shared > 0")


# --- tests and scorecards ---------------------------------------------------------------------------------------------


COUNTED = "c AS (SELECT address, count(*) AS n, count(*) FILTER (role = 'in') AS k FROM edge GROUP BY 1)"


def _counted(spark, d):
    return V.edges(spark, d).groupBy("address").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "in").alias("k"))


@query("f_binom_sf", V.EDGE + f", {COUNTED} SELECT address, n, k, round(CASE WHEN k <= 0 THEN 1 ELSE least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.55::DOUBLE) + (n - i) * ln(0.45::DOUBLE))))) END, 6) AS p FROM c")
def f_binom_sf(spark, d):
    """Chance of as many payments or more among an address's rows, if each were one with a chance of 0.55."""
    return _counted(spark, d).select("address", "n", "k", F.round(T.binomial_tail(F.col("k"), F.col("n"), F.lit(0.55)), 6).alias("p"))


@query("f_chi2_sf", V.EDGE + f", {COUNTED}, x AS (SELECT address, 1 + n % 9 AS dof, power(k - n / 2, 2) / (n / 4) AS x FROM c) SELECT address, dof, round(x, 6) AS x, round(CASE WHEN x <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400), lambda i: exp((dof / 2 + i) * ln(x / 2) - x / 2 - lgamma(dof / 2 + i + 1)))) END, 6) AS p FROM x")
def f_chi2_sf(spark, d):
    x = (F.col("k") - F.col("n") / 2) ** 2 / (F.col("n") / 4)
    rows = _counted(spark, d).select("address", (1 + F.col("n") % 9).alias("dof"), x.alias("raw"))
    return rows.select("address", "dof", F.round("raw", 6).alias("x"), F.round(T.chi2_tail(F.col("raw"), F.col("dof")), 6).alias("p"))


@query(
    "f_t_p",
    V.EDGE
    + f""", {COUNTED}, x AS (SELECT address, n AS dof, (k - n / 2) / sqrt(n / 4) AS t FROM c), g AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a, lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(pi()) / 2 AS lg FROM x)
 SELECT address, dof, round(t, 6) AS t, round(1 - 2 * exp(lg) * a / 3000 * list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos(a * i / 1000), dof - 1))), 6) AS p FROM g""",
)
def f_t_p(spark, d):
    """Two-sided Student's t; the SQL integrates the density instead."""
    t = (F.col("k") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)
    rows = _counted(spark, d).select("address", F.col("n").alias("dof"), t.alias("raw"))
    return rows.select("address", "dof", F.round("raw", 6).alias("t"), F.round(T.t_two_sided(F.col("raw"), F.col("dof")), 6).alias("p"))


@query(
    "x_perm_sign",
    V.EDGE
    + """, f AS (SELECT p_brand AS entity, (step - 1) // 12 AS fold, round(avg(CASE WHEN role = 'in' THEN amount END) - avg(CASE WHEN role = 'out' THEN amount END), 2) AS d FROM edge JOIN part ON p_partkey = entity_key GROUP BY ALL), g AS (SELECT entity, list(d ORDER BY fold) AS ds, count(*) AS n, sum(d) AS own FROM f WHERE d IS NOT NULL GROUP BY entity),
 a AS (SELECT entity, n, own, ds, unnest(range(0, (1 << n)::BIGINT)) AS signs FROM g), h AS (SELECT entity, n, own, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (signs >> (i - 1)) & 1 = 1 THEN -x ELSE x END))) >= abs(own) - 1e-9 AS hit FROM a)
 SELECT entity, max(n)::INT AS folds, round(max(own) / max(n), 6) AS mean, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 8) AS p FROM h GROUP BY entity""",
)
def x_perm_sign(spark, d):
    """Whether an entity spends other amounts than it gets, by an exact sign-flip test over years."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_key"), F.col("p_brand").alias("entity"))
    side = lambda r: F.avg(F.when(F.col("role") == r, F.col("amount")))
    f = _by_year(spark, d).join(part, "entity_key").groupBy("entity", F.col("year").alias("fold")).agg(F.round(side("in") - side("out"), 2).alias("difference"))
    return C.sign_flip_test(f.where("difference IS NOT NULL"), "entity")


@query(
    "m_threshold",
    SCORED
    + """, a AS (SELECT count(*) AS n, count(*) FILTER (score >= 0.1 AND label = 1) AS tp, count(*) FILTER (score >= 0.1 AND label = 0) AS fp, count(*) FILTER (score < 0.1 AND label = 1) AS fn, avg(power(score - label, 2)) AS b, avg(CASE WHEN label = 1 THEN -ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE -ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS l FROM s)
 SELECT n, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(b, 6) AS brier, round(l, 6) AS log_loss FROM a""",
)
def m_threshold(spark, d):
    return M.threshold_metrics(_scored(spark, d), 0.1)


@query("m_ece", SCORED + ", b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM s GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS largest_gap, count(*) AS bins FROM b")
def m_ece(spark, d):
    return M.expected_calibration_error(_scored(spark, d))


@query(
    "m_tx_metrics",
    SCORED
    + """, x AS (SELECT id % 997 AS txid, max(score) AS score, max(label) AS label FROM s GROUP BY 1), g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM x GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)), t AS (SELECT sum(label) AS p, count(*) AS n FROM x),
 a AS (SELECT sum(pos / t.p * tp / seen) AS ap, sum((c.n - pos) * (tp - pos / 2)) AS area FROM c, t) SELECT n, p::BIGINT AS positives, round(ap, 6) AS average_precision, round((ap - p / n) / (1 - p / n), 6) AS normalised_ap, round(area / (p * (n - p)), 6) AS roc_auc FROM a, t""",
)
def m_tx_metrics(spark, d):
    """The same for groups of rows, each scored by its best."""
    return M.transaction_metrics(_scored(spark, d).withColumn("txid", F.col("id") % 997))


@query(
    "m_shadow",
    SCORED
    + """, b AS (SELECT id, score AS a, (n_chars % 1000) / 1000 AS b FROM s JOIN documents ON id = doc_id), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM b),
 o AS (SELECT count(*) AS top_overlap FROM (SELECT id FROM b ORDER BY a DESC, id LIMIT 100) JOIN (SELECT id FROM b ORDER BY b DESC, id LIMIT 100) USING (id)) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 6) AS mean_abs_diff, (SELECT top_overlap FROM o) AS top_overlap FROM r""",
)
def m_shadow(spark, d):
    """How far a second score agrees with the first."""
    s = _scored(spark, d)
    other = s.select("id").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000).alias("score")), "id")
    return M.shadow(s, other)


@query(
    "m_delayed",
    SCORED
    + """, d AS (SELECT lang, doc_id, n_chars FROM documents), j AS (SELECT lang, label FROM d LEFT JOIN s ON id = doc_id) SELECT lang, count(*) AS scored, count(label) AS labelled, round(count(label) / count(*), 6) AS coverage, coalesce(sum(label), 0)::BIGINT AS positives, CASE WHEN count(label) < 50 THEN 'too few labels' WHEN coalesce(sum(label), 0) < 5 THEN 'too few positives' ELSE 'measurable' END AS health FROM j GROUP BY lang""",
)
def m_delayed(spark, d):
    """How many scored rows have a label by now, and whether that is enough to measure (50 labels, 5 positives)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    j = docs.join(_scored(spark, d).select("id", "label"), "id", "left").groupBy("lang").agg(F.count("*").alias("scored"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"))
    health = F.when(F.col("labelled") < 50, "too few labels").when(F.col("positives") < 5, "too few positives").otherwise("measurable")
    return j.select("lang", "scored", "labelled", F.round(F.col("labelled") / F.col("scored"), 6).alias("coverage"), "positives", health.alias("health"))


@query(
    "m_dataset",
    V.EDGE.replace("'A' || l_partkey AS address", "'A' || l_partkey || ':' || (year(o_orderdate) * 4 + quarter(o_orderdate)) AS address")
    + f""", {FLOWS}, t AS (SELECT address, min(step) AS first_step, max(step) AS last_step, count(DISTINCT txid) AS n_txs FROM edge GROUP BY 1), q AS (SELECT payer AS address, count(DISTINCT payee) AS out_degree FROM flow GROUP BY 1), x AS (SELECT t.*, coalesce(out_degree, 0) AS out_degree, CASE WHEN first_step <= 34 THEN 'train' WHEN first_step <= 41 THEN 'validation' ELSE 'test' END AS fold FROM t LEFT JOIN q USING (address))
 SELECT x.*, p_size % 3 AS class FROM x LEFT JOIN part ON split_part(address, ':', 1) = 'A' || p_partkey WHERE fold = 'test' OR (fold = 'train' AND last_step <= 34) OR (fold = 'validation' AND last_step <= 41)""",
)
def m_dataset(spark, d):
    """Feature blocks of addresses in each quarter with their fold by first step; those that go over a fold's end are left out, labels come last."""
    e = V.edges(spark, d).withColumn("address", F.concat_ws(":", "address", (F.year("ts") * 4 + F.quarter("ts")).cast("string")))
    degree = A.counterparties(e).select("address", "out_degree")
    x = A.first_last(e).join(A.tx_degree(e).withColumnRenamed("degree", "n_txs"), "address").join(degree, "address", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    end = {"train": 34, "validation": 41}
    fold = F.when(F.col("first_step") <= end["train"], "train").when(F.col("first_step") <= end["validation"], "validation").otherwise("test")
    inside = (F.col("fold") == "test") | (F.col("last_step") <= F.when(F.col("fold") == "train", end["train"]).otherwise(end["validation"]))
    labels = _classes(spark, d).withColumnRenamed("address", "owner")
    return x.withColumn("fold", fold).where(inside).withColumn("owner", F.substring_index("address", ":", 1)).join(labels, "owner", "left").drop("owner")


# --- alerts and small forms -------------------------------------------------------------------------------------------


@query("f_safe_float", "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-3.5' WHEN 2 THEN 'Infinity' WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '.25' END AS v FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey + 0.25::DOUBLE ELSE 0 END AS value FROM t")
def f_safe_float(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "-3.5").when(k % 5 == 2, "Infinity").when(k % 5 == 4, F.concat(k.cast("string"), F.lit(".25")))
    return table(spark, d, "orders").select("o_orderkey", L.safe_float(v).alias("value"))


@query("f_alert_id", "WITH t AS (SELECT o_orderkey AS n, substr(md5(o_orderkey::VARCHAR), 1, 16) AS run FROM orders) SELECT n, CASE n % 4 WHEN 0 THEN run || ':' || n WHEN 1 THEN run || ':0' || n WHEN 2 THEN upper('x' || run) || ':' || n ELSE run || ':' || n || ' ' END AS id, CASE WHEN n % 4 = 0 THEN run END AS run, CASE WHEN n % 4 = 0 THEN n END AS number FROM t")
def f_alert_id(spark, d):
    """Ids made and read again; those that aren't ids have no parts."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 16).alias("r"))
    whole, k = L.alert_id(F.col("r"), F.col("n")), F.col("n") % 4
    made = F.when(k == 0, whole).when(k == 1, F.replace(whole, F.lit(":"), F.lit(":0"))).when(k == 2, F.concat(F.upper(F.concat(F.lit("x"), "r")), F.lit(":"), "n")).otherwise(F.concat(whole, F.lit(" ")))
    t = t.select("n", made.alias("id"))
    run, number = L.alert_parts(F.col("id"))
    return t.select("n", "id", run.alias("run"), number.alias("number"))


@query("f_node_label", "WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey ELSE 'bc1q' || md5(p_partkey::VARCHAR) END AS address FROM part) SELECT 'addr:' || address AS id, CASE WHEN length(address) > 14 THEN substr(address, 1, 8) || '…' || substr(address, length(address) - 3) ELSE address END AS label FROM a")
def f_node_label(spark, d):
    k = F.col("p_partkey").cast("string")
    a = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("A"), k)).otherwise(F.concat(F.lit("bc1q"), F.md5(k.cast("binary")))).alias("address"))
    return a.select(F.concat(F.lit("addr:"), "address").alias("id"), L.node_label(F.col("address")).alias("label"))


ALERTS = "alerts AS (SELECT e.address, min(step) AS first_step, max(step) AS last_step, (p_size % 50) / 50 AS risk, CASE WHEN p_size % 50 >= 45 THEN 'critical' WHEN p_size % 50 >= 30 THEN 'high' ELSE 'low' END AS severity FROM edge e JOIN part ON p_partkey = entity_key GROUP BY ALL)"


def _alerts(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_key"), (F.col("p_size") % 50).alias("s"))
    kind = F.when(F.col("s") >= 45, "critical").when(F.col("s") >= 30, "high").otherwise("low")
    return V.edges(spark, d).join(part, "entity_key").groupBy("address", (F.col("s") / 50).alias("risk"), kind.alias("severity")).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("p_alert_filter", V.EDGE + f", {ALERTS} SELECT * FROM alerts WHERE severity IN ('critical', 'high') AND risk BETWEEN 0.65 AND 0.95 AND last_step >= 10 AND first_step <= 60")
def p_alert_filter(spark, d):
    """Alerts by severity, risk and overlap in time."""
    return _alerts(spark, d).where("severity IN ('critical', 'high') AND risk BETWEEN 0.65 AND 0.95 AND last_step >= 10 AND first_step <= 60")


@query("x_explain_members", V.EDGE + f", {ALERTS}, f AS (SELECT address, count(DISTINCT txid) AS n_txs, round(sum(CASE WHEN role = 'in' THEN amount END), 2) AS sent FROM edge GROUP BY 1) SELECT address, severity, n_txs, sent, row_number() OVER (PARTITION BY severity ORDER BY risk DESC, n_txs DESC, address) AS place FROM alerts JOIN f USING (address) QUALIFY place <= 5")
def x_explain_members(spark, d):
    """The first members of each severity with their features."""
    e = V.edges(spark, d)
    f = e.groupBy("address").agg(F.count_distinct("txid").alias("n_txs"), F.round(F.sum(F.when(F.col("role") == "in", F.col("amount"))), 2).alias("sent"))
    best = W.partitionBy("severity").orderBy(F.desc("risk"), F.desc("n_txs"), "address")
    return _alerts(spark, d).join(f, "address").withColumn("place", F.row_number().over(best)).where("place <= 5").select("address", "severity", "n_txs", "sent", "place")


@query(
    "j_related",
    V.EDGE
    + f""", {V.OBS_SQL}, m AS (SELECT DISTINCT p_brand AS entity, txid FROM edge JOIN part ON p_partkey = entity_key WHERE p_size = 7), p AS (SELECT DISTINCT entity, peer FROM m JOIN obs USING (txid) WHERE peer IS NOT NULL),
 t AS (SELECT a.entity, b.entity AS other, count(*) AS n FROM m a JOIN m b USING (txid) WHERE a.entity <> b.entity GROUP BY ALL), q AS (SELECT a.entity, b.entity AS other, count(*) AS n FROM p a JOIN p b USING (peer) WHERE a.entity <> b.entity GROUP BY ALL),
 r AS (SELECT entity, other, 'transaction' AS via, n FROM t UNION ALL SELECT q.entity, q.other, 'peer', q.n FROM q ANTI JOIN t USING (entity, other)) SELECT entity, other, via, n, row_number() OVER (PARTITION BY entity ORDER BY via DESC, n DESC, other) AS place FROM r QUALIFY place <= 20""",
)
def j_related(spark, d):
    """Entities that share a transaction, else a relaying peer, the first twenty of each; those by transaction come first."""
    part = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("entity_key"), F.col("p_brand").alias("entity"))
    m = checkpoint(V.edges(spark, d).join(part, "entity_key").select("entity", "txid").distinct())
    p = m.join(V.observations(spark, d).where("peer IS NOT NULL").select("txid", "peer"), "txid").select("entity", "peer").distinct()

    def shared(df, key):
        other = df.select(F.col("entity").alias("other"), key)
        return df.join(other, key).where("entity <> other").groupBy("entity", "other").agg(F.count("*").alias("n"))

    t = checkpoint(shared(m, "txid"))
    q = shared(p, "peer").join(t.select("entity", "other"), ["entity", "other"], "left_anti")
    r = t.withColumn("via", F.lit("transaction")).unionByName(q.withColumn("via", F.lit("peer")))
    best = W.partitionBy("entity").orderBy(F.desc("via"), F.desc("n"), "other")
    return r.withColumn("place", F.row_number().over(best)).where("place <= 20")


@query("dict_encode", V.EDGE + "SELECT address, row_number() OVER (ORDER BY address) - 1 AS code FROM (SELECT DISTINCT address FROM edge)")
def dict_encode(spark, d):
    """Dense codes of addresses in their order."""
    return G.places(V.edges(spark, d).select("address").distinct(), ["address"]).select("address", (F.col("place") - 1).alias("code"))


@query(
    "g_onset",
    V.EDGE
    + """, s AS (SELECT step, count(DISTINCT address) AS a FROM edge WHERE step > 0 GROUP BY step), w AS (SELECT step, first(step) OVER x AS start, regr_slope(ln(a), ln(step)) OVER x AS slope, count(*) OVER x AS n FROM s WINDOW x AS (ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 r AS (SELECT *, n = 8 AND slope > 0.1 AND lag(slope) OVER (ORDER BY step) > 0.1 AND lag(n) OVER (ORDER BY step) = 8 AND lag(slope, 2) OVER (ORDER BY step) > 0.1 AND lag(n, 2) OVER (ORDER BY step) = 8 AS hit FROM w)
 SELECT min(start) FILTER (hit) AS onset, round(arg_min(slope, step) FILTER (hit), 6) AS exponent, (SELECT round(regr_slope(ln(a), ln(step)), 6) FROM s) AS overall FROM r""",
)
def g_onset(spark, d):
    """The first of three windows in a row (of eight steps) in which addresses grow faster than a power of the step; a table of one row a step."""
    s = V.edges(spark, d).where("step > 0").groupBy("step").agg(F.count_distinct("address").alias("a"))
    line = W.orderBy("step")
    x = line.rowsBetween(-7, 0)
    w = s.select("step", F.first("step").over(x).alias("start"), F.regr_slope(F.ln("a"), F.ln("step")).over(x).alias("slope"), F.count("*").over(x).alias("n"))
    high = (F.col("n") == 8) & (F.col("slope") > 0.1)
    r = w.withColumn("high", high).withColumn("hit", F.col("high") & F.lag("high", 1, False).over(line) & F.lag("high", 2, False).over(line))
    first = r.agg(F.min(F.when(F.col("hit"), F.col("start"))).alias("onset"), F.round(F.min_by(F.when(F.col("hit"), F.col("slope")), F.when(F.col("hit"), F.col("step"))), 6).alias("exponent"))
    return first.join(F.broadcast(s.agg(F.round(F.regr_slope(F.ln("a"), F.ln("step")), 6).alias("overall"))))


@query("m_golden", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, (sum(('0x' || substr(md5({c}::VARCHAR), 1, 15))::BIGINT::HUGEINT) % 1000000000000000)::BIGINT AS digest FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")))
def m_golden(spark, d):
    return Q.column_digests(table(spark, d, "lineitem"), ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"))


@query("x_golden_vals", "SELECT 'o_totalprice' AS \"column\", count(*) FILTER (o_orderkey % 90 <> 0) AS compared, count(*) FILTER (o_orderkey % 90 <> 0 AND o_orderkey % 50 = 0) AS differing, count(*) FILTER (o_orderkey % 90 = 0) AS only_one FROM orders")
def x_golden_vals(spark, d):
    """A table against a copy with some values moved beyond and others within the tolerance, and some rows missing."""
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    b = a.where(k % 90 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 50 == 0, 0.5).when(k % 7 == 0, 1e-7).otherwise(0.0))
    return Q.value_differences(a, b, "o_orderkey", {"o_totalprice": 1e-4})
