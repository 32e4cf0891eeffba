"""More registered queries; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as L
from ledgerlens.operators import addresses as A
from ledgerlens.operators import chains as P
from ledgerlens.operators import clusters as C
from ledgerlens.operators import metrics as M
from ledgerlens.operators import neighbourhoods as H
from ledgerlens.operators import transactions as X
from ledgerlens.plans import views as V
from ledgerlens.plans.catalog import CHANGE, CHOSEN, CLUSTERS, FLOWS, IP_CLASS, MODE, SCORED, STAR, _clusters, _classes, _scored, query
from ledgerlens.session import checkpoint, table
from ledgerlens.sources import capture as S
from ledgerlens.sources import labels as B


def _brands(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("address"), F.col("p_brand").alias("entity"), ((F.col("p_size") % 50) / 50).alias("risk"))


@query(
    "g_peel_greedy",
    f"WITH RECURSIVE {V.EDGE_SQL}"
    + """, big AS (SELECT txid, address FROM (SELECT txid, address, row_number() OVER (PARTITION BY txid ORDER BY amount DESC, pos, address DESC) AS rn FROM edge WHERE role = 'out') WHERE rn = 1),
 o AS (SELECT txid, min(ts) AS ts, sum(amount) - max(amount) AS peeled FROM edge WHERE role = 'out' GROUP BY txid HAVING count(*) IN (2, 3)),
 nx AS MATERIALIZED (SELECT o.txid, o.peeled, (SELECT arg_min(s.txid, s) FROM (SELECT ts, txid FROM edge e WHERE e.role = 'in' AND e.address = big.address AND e.ts > o.ts) s) AS next FROM o JOIN big USING (txid)),
 walk(txid, cur, hops, peeled) AS (SELECT txid, next, 1, peeled FROM nx UNION ALL SELECT w.txid, n.next, w.hops + 1, w.peeled + n.peeled FROM walk w JOIN nx n ON n.txid = w.cur)
 SELECT txid, max(hops) AS hops, round(max_by(peeled, hops), 2) AS peeled FROM walk GROUP BY txid HAVING max(hops) >= 2""",
)
def g_peel_greedy(spark, d):
    return P.peel_chains(V.edges(spark, d))


@query(
    "agg_cluster_risk",
    CLUSTERS
    + """, m AS (SELECT cluster_id, c.address, (p_size % 50) / 50 AS risk, count(DISTINCT txid) AS n FROM clusters c JOIN part ON c.address = 'A' || p_partkey JOIN edge e ON e.address = c.address AND e.step = c.step AND role = 'in' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY risk DESC, address) AS rn FROM m) SELECT cluster_id, max(risk) AS risk_max, round(avg(risk) FILTER (rn <= 3), 6) AS risk_top3, round(quantile_cont(risk, 0.9), 6) AS risk_q90, round(sum(risk * (n + 1)) / sum(n + 1), 6) AS risk_weighted FROM r GROUP BY cluster_id""",
)
def agg_cluster_risk(spark, d):
    """Cluster risk by its members' risks: largest, mean of the top three, 90th percentile, mean weighted by transactions."""
    from pyspark.sql import Window as W

    e, c = _clusters(spark, d)
    n = e.where("role = 'in'").groupBy("step", "address").agg(F.count_distinct("txid").alias("n"))
    m = c.join(n, ["step", "address"]).join(_brands(spark, d), "address").withColumn("rn", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("risk"), "address")))
    return m.groupBy("cluster_id").agg(F.max("risk").alias("risk_max"), F.round(F.avg(F.when(F.col("rn") <= 3, F.col("risk"))), 6).alias("risk_top3"), F.round(F.percentile("risk", 0.9), 6).alias("risk_q90"), F.round(F.sum(F.col("risk") * (F.col("n") + 1)) / F.sum(F.col("n") + 1), 6).alias("risk_weighted"))


@query("x_tx_entity", V.EDGE + ", l AS (SELECT txid, min(address) AS address FROM edge WHERE role = 'in' GROUP BY txid) SELECT txid, address, p_brand AS entity FROM l JOIN part ON address = 'A' || p_partkey")
def x_tx_entity(spark, d):
    least = V.edges(spark, d).where("role = 'in'").groupBy("txid").agg(F.min("address").alias("address"))
    return least.join(_brands(spark, d).drop("risk"), "address")


@query(
    "agg_m4",
    V.TX
    + f""", {MODE}, k AS (SELECT txid, n_in, n_out, CASE WHEN n_in >= 3 AND n_equal >= 3 THEN 1 WHEN n_in >= 2 AND n_equal >= 2 THEN 0.5::DOUBLE ELSE 0 END AS mix FROM tx JOIN mode USING (txid)), d AS (SELECT DISTINCT address, txid FROM edge)
 SELECT address, count(*) AS n_txs, count(*) FILTER (mix > 0) AS n_mixing, round(count(*) FILTER (mix > 0) / count(*), 6) AS mixing_share, max(mix)::DOUBLE AS mixing_max, round(avg(mix), 6) AS mixing_mean, max(n_in + n_out) AS participants FROM d JOIN k USING (txid) GROUP BY address""",
)
def agg_m4(spark, d):
    """Each address's share in transactions of mixing shape."""
    e = V.edges(spark, d)
    mix = F.when(F.col("mixing") == "PATTERN", 1.0).when(F.col("mixing") == "LIKELIHOOD", 0.5).otherwise(0.0)
    k = X.mixing_shapes(V.transactions(e), e).select("txid", "n_in", "n_out", mix.alias("mix"))
    hit = F.count(F.when(F.col("mix") > 0, 1))
    return e.select("address", "txid").distinct().join(k, "txid").groupBy("address").agg(F.count("*").alias("n_txs"), hit.alias("n_mixing"), F.round(hit / F.count("*"), 6).alias("mixing_share"), F.max("mix").alias("mixing_max"), F.round(F.avg("mix"), 6).alias("mixing_mean"), F.max(F.col("n_in") + F.col("n_out")).alias("participants"))


@query("w_budget_model", SCORED + ", g AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS seen, sum(count(*)) OVER () AS n FROM s GROUP BY score) SELECT id, CASE WHEN seen <= ceil(0.01 * n) THEN 'critical' WHEN seen <= ceil(0.05 * n) THEN 'high' WHEN seen <= ceil(0.15 * n) THEN 'medium' ELSE 'low' END AS severity FROM s JOIN g USING (score)")
def w_budget_model(spark, d):
    """Bands by share of all rows; equal scores share a band and take it only if they fit as a whole."""
    return M.budget_bands(_scored(spark, d), ((0.01, "critical"), (0.05, "high"), (0.15, "medium")), "low")


@query(
    "m_hyper_null",
    CLUSTERS
    + """, k AS (SELECT cluster_id, count(*) FILTER (p_size % 3 = 1) AS bad, count(*) FILTER (p_size % 3 = 2) AS good FROM clusters JOIN part ON address = 'A' || p_partkey GROUP BY 1), t AS (SELECT sum(bad) AS b, sum(good) AS g FROM k), z AS (SELECT bad + good AS s, count(*) AS n FROM k WHERE bad + good > 1 GROUP BY 1),
 lg AS (SELECT s, n, b, g, CASE WHEN s <= b THEN exp(lgamma(b + 1) - lgamma(b - s + 1) - lgamma(b + g + 1) + lgamma(b + g - s + 1)) ELSE 0 END + CASE WHEN s <= g THEN exp(lgamma(g + 1) - lgamma(g - s + 1) - lgamma(b + g + 1) + lgamma(b + g - s + 1)) ELSE 0 END AS pure FROM z, t) SELECT s AS known, n AS clusters, round(n * (1 - pure), 4) AS expected_contaminated FROM lg""",
)
def m_hyper_null(spark, d):
    """Clusters expected to hold both classes if labels were dealt at random, by number of known members (hypergeometric)."""
    c = _clusters(spark, d)[1].join(_classes(spark, d), "address")
    k = c.groupBy("cluster_id").agg(F.sum((F.col("class") == 1).cast("long")).alias("bad"), F.sum((F.col("class") == 2).cast("long")).alias("good"))
    t = k.agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    z = k.select((F.col("bad") + F.col("good")).alias("s")).where("s > 1").groupBy("s").agg(F.count("*").alias("n")).join(F.broadcast(t))
    every = M.log_choose(F.col("b") + F.col("g"), F.col("s"))
    one = lambda side: F.coalesce(F.exp(M.log_choose(F.col(side), F.col("s")) - every), F.lit(0.0))
    return z.select(F.col("s").alias("known"), F.col("n").alias("clusters"), F.round(F.col("n") * (1 - one("b") - one("g")), 4).alias("expected_contaminated"))


@query("x_timestep", V.EDGE + "SELECT greatest(1, least(step, 49)) AS bucket, count(DISTINCT txid) AS n_txs, count(*) AS n_rows FROM edge GROUP BY 1")
def x_timestep(spark, d):
    """Steps folded into 1 to 49."""
    return V.edges(spark, d).groupBy(F.greatest(F.lit(1), F.least("step", F.lit(49))).alias("bucket")).agg(F.count_distinct("txid").alias("n_txs"), F.count("*").alias("n_rows"))


@query("x_net_sum", V.EDGE + f", {V.OBS_SQL}, m AS (SELECT DISTINCT p_brand AS entity, txid FROM edge JOIN part ON p_partkey = entity_key) SELECT entity, count(DISTINCT txid) AS n_txs, count(DISTINCT peer) AS n_peers, count(DISTINCT observer) AS n_observers, min(ms) AS first_ms, max(ms) AS last_ms FROM m JOIN obs USING (txid) GROUP BY entity")
def x_net_sum(spark, d):
    """Network footprint of each entity's transactions."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entity_key"), F.col("p_brand").alias("entity"))
    m = V.edges(spark, d).join(part, "entity_key").select("entity", "txid").distinct()
    return m.join(V.observations(spark, d), "txid").groupBy("entity").agg(F.count_distinct("txid").alias("n_txs"), F.count_distinct("peer").alias("n_peers"), F.count_distinct("observer").alias("n_observers"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("j_annotate", V.EDGE + ", g AS (SELECT address, count(DISTINCT txid) AS degree, max(step) AS last_step FROM edge GROUP BY 1) SELECT address, degree, last_step, p_brand AS entity, (p_size % 50) / 50 AS risk FROM g LEFT JOIN part ON address = 'A' || p_partkey")
def j_annotate(spark, d):
    e = V.edges(spark, d)
    return A.tx_degree(e).join(A.first_last(e).drop("first_step"), "address").join(_brands(spark, d), "address", "left")


@query(
    "agg_signals",
    V.EDGE
    + """, o AS (SELECT txid, address, count(*) OVER (PARTITION BY txid) AS n FROM edge WHERE role = 'out'), i AS (SELECT DISTINCT txid, address FROM edge WHERE role = 'in'), u AS (SELECT address, count(DISTINCT txid) AS uses FROM edge GROUP BY 1),
 f AS (SELECT i.txid IS NOT NULL AS own, uses > 1 AS reused FROM o JOIN u USING (address) LEFT JOIN i ON i.txid = o.txid AND i.address = o.address WHERE n = 2) SELECT 'own_input' AS signal, count(*) FILTER (own) AS fired, round(avg(CASE WHEN own THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM f UNION ALL SELECT 'reused', count(*) FILTER (reused), round(avg(CASE WHEN reused THEN 1.0::DOUBLE ELSE 0 END), 6) FROM f""",
)
def agg_signals(spark, d):
    """How often each change signal fires over two-output transactions."""
    from pyspark.sql import Window as W

    e = V.edges(spark, d)
    o = e.where("role = 'out'").select("txid", "address").withColumn("n", F.count("*").over(W.partitionBy("txid"))).where("n = 2")
    ins = e.where("role = 'in'").select("txid", "address").distinct().withColumn("own", F.lit(True))
    f = o.join(A.tx_degree(e), "address").join(ins, ["txid", "address"], "left")
    long = f.select(F.inline(F.array(F.struct(F.lit("own_input").alias("signal"), F.coalesce("own", F.lit(False)).alias("hit")), F.struct(F.lit("reused").alias("signal"), (F.col("degree") > 1).alias("hit")))))
    return long.groupBy("signal").agg(F.sum(F.col("hit").cast("long")).alias("fired"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("share"))


@query("f_scalars", SCORED + "SELECT id, round(least(greatest((score - 0.05::DOUBLE) / 0.25::DOUBLE, 0), 1), 6) AS ramp, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 6) AS logit, round(1 / (1 + exp(-score)), 6) AS sigmoid, CASE WHEN score + label > 0 THEN round(2 * score * label / (score + label), 6) ELSE 0 END AS f1 FROM s")
def f_scalars(spark, d):
    s, y = F.col("score"), F.col("label").cast("double")
    return _scored(spark, d).select("id", F.round(L.ramp(s, 0.05, 0.3), 6).alias("ramp"), F.round(L.logit(s), 6).alias("logit"), F.round(L.sigmoid(s), 6).alias("sigmoid"), F.round(L.f1(s, y), 6).alias("f1"))


@query("g_khop", V.EDGE + f", {FLOWS}, l AS (SELECT DISTINCT payer AS u, payee AS v FROM flow), b AS (SELECT u, v FROM l UNION SELECT v, u FROM l), two AS (SELECT u, v FROM b UNION SELECT x.u, y.v FROM b x JOIN b y ON x.v = y.u) SELECT u AS address, count(*) FILTER (v <> u) AS within_two FROM two GROUP BY u")
def g_khop(spark, d):
    """Addresses within two hops of each address, whatever the direction."""
    f = A.flows(V.edges(spark, d))
    pairs = checkpoint(f.select(F.least("payer", "payee").alias("u"), F.greatest("payer", "payee").alias("v")).distinct())
    return H.within_two(pairs).select(F.col("u").alias("address"), F.col("n").alias("within_two"))


#: Features of the risk model.
RISK_FEATURES = ["n_txs", "n_in", "n_out", "sent", "received", "mean_fee_ratio"]


def risk_model(spark, d):
    """``(rows, model)``: addresses with their features, label and fold, and boosted trees fitted on all folds but the first."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    e = V.edges(spark, d)
    rows = A.address_profile(e, V.transactions(e)).join(_classes(spark, d), "address").fillna(0.0, RISK_FEATURES).withColumn("label", (F.col("class") == 1).cast("double"))
    rows = VectorAssembler(inputCols=RISK_FEATURES, outputCol="features").transform(rows).withColumn("fold", F.pmod(F.xxhash64("address"), F.lit(4)))
    return rows, GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(rows.where("fold > 0"))


@query("m_score")
def m_score(spark, d):
    """Boosted trees on aggregate features of addresses, isotonic calibration on a held-out fold, scores of all addresses."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows, model = risk_model(spark, d)
    scored = model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("prediction")
    calibrated = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored.where("fold = 0")).transform(scored)
    return calibrated.select("address", "label", F.round("raw", 6).alias("raw"), F.round("prediction", 6).alias("score"))


@query(
    "m_compare",
    f"WITH RECURSIVE {V.EDGE_SQL}, {STAR}, {CHANGE}, picked AS ({CHOSEN})"
    + """, sender AS (SELECT txid, step, address AS sender FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY pos, address) AS rn FROM edge WHERE role = 'in') WHERE rn = 1),
 chg AS (SELECT c.txid, step, sender, address FROM picked c JOIN sender USING (txid) WHERE chosen AND address <> sender), nodes AS (SELECT DISTINCT step, address, lpad(step::VARCHAR, 3, '0') || ':' || address AS node FROM edge WHERE role = 'in'),
 nodes2 AS (SELECT * FROM nodes UNION SELECT step, address, lpad(step::VARCHAR, 3, '0') || ':' || address FROM chg), links AS (SELECT lpad(step::VARCHAR, 3, '0') || ':' || center AS src, lpad(step::VARCHAR, 3, '0') || ':' || address AS dst FROM star),
 links2 AS (SELECT * FROM links UNION SELECT lpad(step::VARCHAR, 3, '0') || ':' || sender, lpad(step::VARCHAR, 3, '0') || ':' || address FROM chg), und AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), und2 AS (SELECT src, dst FROM links2 UNION SELECT dst, src FROM links2),
 reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT dst, root FROM reach JOIN und ON node = src), reach2(node, root) AS (SELECT node, node FROM nodes2 UNION SELECT dst, root FROM reach2 JOIN und2 ON node = src),
 a AS (SELECT node, min(root) AS c FROM reach GROUP BY 1), b AS (SELECT node, min(root) AS c FROM reach2 GROUP BY 1), s AS (SELECT 'inputs' AS mode, c, count(*) AS n FROM a GROUP BY c UNION ALL SELECT 'inputs+change', c, count(*) FROM b GROUP BY c)
 SELECT mode, sum(n)::BIGINT AS addresses, count(*) AS clusters, (sum(n) - count(*))::BIGINT AS merges, max(n) AS largest FROM s GROUP BY mode""",
)
def m_compare(spark, d):
    """Clusters by common inputs, and with change outputs added."""
    e = checkpoint(V.edges(spark, d))
    stars = checkpoint(C.step_links(e))
    both = C.monthly_clusters(e, stars).withColumn("mode", F.lit("inputs")).unionByName(C.monthly_clusters_with_change(e, stars).withColumn("mode", F.lit("inputs+change")))
    size = both.groupBy("mode", "cluster_id").agg(F.count("*").alias("n"))
    return size.groupBy("mode").agg(F.sum("n").alias("addresses"), F.count("*").alias("clusters"), (F.sum("n") - F.count("*")).alias("merges"), F.max("n").alias("largest"))


@query(
    "m_perm",
    CLUSTERS
    + """, own AS (SELECT cluster_id, cluster_id || '|' || address AS member, p_brand AS entity FROM clusters JOIN part ON address = 'A' || p_partkey), t AS (SELECT unnest(range(0, 6))::INT AS trial), ev AS (SELECT * FROM own, t),
 slot AS (SELECT trial, cluster_id, row_number() OVER (PARTITION BY trial ORDER BY member) AS place FROM ev), dealt AS (SELECT trial, entity, CASE WHEN trial = 0 THEN row_number() OVER (PARTITION BY trial ORDER BY member) ELSE row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|' || member), member) END AS place FROM ev),
 cells AS (SELECT trial, cluster_id, entity, count(*) AS n FROM slot JOIN dealt USING (trial, place) GROUP BY ALL) SELECT trial, sum(n * (n - 1) / 2)::BIGINT AS pairs FROM cells GROUP BY trial""",
)
def m_perm(spark, d):
    return C.permuted_pairs(_clusters(spark, d)[1], _brands(spark, d).drop("risk"), 5)


@query(
    "m_scorecard",
    SCORED
    + """, l AS (SELECT s.*, lang FROM s JOIN documents ON id = doc_id), g AS (SELECT lang, score, sum(label) AS pos, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY lang) AS p FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
 SELECT lang, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives, round(sum(CASE WHEN p > 0 THEN pos / p * tp / seen END), 6) AS average_precision, round(sum(pos) / sum(n), 6) AS prevalence FROM c GROUP BY lang""",
)
def m_scorecard(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return M.slice_metrics(_scored(spark, d).join(docs, "id"), "lang")


@query(
    "src_labels",
    """WITH r AS (SELECT 'A' || l_partkey AS address, CASE WHEN l_linenumber % 3 = 0 THEN ' ' || upper(p_type) ELSE p_type END AS raw0, l_partkey % 50 = l_linenumber AS odd FROM lineitem JOIN part ON l_partkey = p_partkey),
 n AS (SELECT address, trim(CASE WHEN odd THEN 'other' ELSE raw0 END) AS raw FROM r WHERE regexp_matches(address, '^A[0-9]*[02468]$')), m AS (SELECT address, raw, lower(raw) AS entity FROM n WHERE raw <> ''),
 o AS (SELECT address, min(entity) AS entity, count(*) AS rows FROM m GROUP BY 1 HAVING count(DISTINCT entity) = 1), q AS (SELECT entity, raw, count(*) AS c FROM m GROUP BY ALL), d AS (SELECT entity, raw AS display FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c DESC, raw) AS rn FROM q) WHERE rn = 1)
 SELECT address, entity, display, rows FROM o JOIN d USING (entity)""",
)
def src_labels(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").join(parts, "l_partkey")
    name = F.when(F.col("l_partkey") % 50 == F.col("l_linenumber"), "other").when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.upper("p_type"))).otherwise(F.col("p_type"))
    return B.clean_labels(rows.select(F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("address"), name.alias("entity")), "^A[0-9]*[02468]$")


@query("o_point", V.EDGE + "SELECT txid, pos, address, role, amount FROM edge WHERE address = 'A42'")
def o_point(spark, d):
    """One address's rows: the key is pushed down to the scan."""
    lines = table(spark, d, "lineitem").where("l_partkey = 42")
    return lines.select(F.col("l_orderkey").alias("txid"), F.col("l_linenumber").alias("pos"), F.lit("A42").alias("address"), F.when(F.col("l_linenumber") % 2 == 1, "in").otherwise("out").alias("role"), F.col("l_extendedprice").alias("amount"))


@query("agg_geo", f"WITH e AS (SELECT (event_id * 2654435 + user_id * 16777259) % 4294967296 AS ip, user_id FROM events), c AS (SELECT ip, user_id, {IP_CLASS} AS ip_class FROM e) SELECT ip_class, count(DISTINCT ip) AS ips, count(DISTINCT user_id) AS peers FROM c GROUP BY 1")
def agg_geo(spark, d):
    """Distinct addresses and peers of each address class."""
    ip = (F.col("event_id") * 2654435 + F.col("user_id") * 16777259) % 4294967296
    return table(spark, d, "events").select(ip.alias("ip"), "user_id", S.ip_class(ip).alias("ip_class")).groupBy("ip_class").agg(F.count_distinct("ip").alias("ips"), F.count_distinct("user_id").alias("peers"))
