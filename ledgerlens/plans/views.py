"""Domain views over the star-schema tables: transaction edges, transactions, and network observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import dealt, lots, table


def edge_lots(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for as many rows as ``edges`` has."""
    return lots(spark, table(spark, sf_dir, "lineitem").count())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an input or output: ``txid, pos, address, role, amount, fee, ts, step, entity_key``.

    Large tables are dealt by transaction into as many partitions as their rows ask for; joins and aggregates by transaction stay in these.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txid"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("txid"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("address"),
        F.when(F.col("l_linenumber") % 2 == 1, "in").otherwise("out").alias("role"), F.col("l_extendedprice").alias("amount"),
        (F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5) / 100).alias("fee"), F.col("l_partkey").alias("entity_key"),
    )
    return dealt(lines, edge_lots(spark, sf_dir), "txid").join(orders, "txid").withColumn("step", ((F.year("ts") - 1995) * 12 + F.month("ts")).cast("int"))


def transactions(edge: DataFrame) -> DataFrame:
    """One row a transaction: counts and amounts of both sides, fee and time."""
    side = lambda r, c="amount": F.when(F.col("role") == r, F.col(c))
    return edge.groupBy("txid").agg(
        F.min("ts").alias("ts"), F.min("step").alias("step"), F.count(side("in")).alias("n_in"), F.count(side("out")).alias("n_out"),
        F.sum(side("in")).alias("in_total"), F.sum(side("out")).alias("out_total"), F.min(side("in")).alias("in_min"), F.max(side("in")).alias("in_max"),
        F.avg(side("in")).alias("in_mean"), F.min(side("out")).alias("out_min"), F.max(side("out")).alias("out_max"), F.avg(side("out")).alias("out_mean"), F.sum("fee").alias("fee"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an announcement: ``obs_id, txid, observer, peer, ms``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("obs_id"), F.get_json_object("props", "$.k").cast("long").alias("txid"), F.col("event_type").alias("observer"), F.col("user_id").alias("peer"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


#: The same views for the SQL statements.
EDGE_SQL = """edge AS (SELECT l_orderkey AS txid, l_linenumber AS pos, 'A' || l_partkey AS address, CASE WHEN l_linenumber % 2 = 1 THEN 'in' ELSE 'out' END AS role,
 l_extendedprice AS amount, floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS fee, l_partkey AS entity_key, o_orderdate AS ts, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS step
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TX_SQL = """tx AS (SELECT txid, min(ts) AS ts, min(step) AS step, count(CASE WHEN role = 'in' THEN 1 END) AS n_in, count(CASE WHEN role = 'out' THEN 1 END) AS n_out,
 sum(CASE WHEN role = 'in' THEN amount END) AS in_total, sum(CASE WHEN role = 'out' THEN amount END) AS out_total, min(CASE WHEN role = 'in' THEN amount END) AS in_min,
 max(CASE WHEN role = 'in' THEN amount END) AS in_max, avg(CASE WHEN role = 'in' THEN amount END) AS in_mean, min(CASE WHEN role = 'out' THEN amount END) AS out_min,
 max(CASE WHEN role = 'out' THEN amount END) AS out_max, avg(CASE WHEN role = 'out' THEN amount END) AS out_mean, sum(fee) AS fee FROM edge GROUP BY txid)"""
OBS_SQL = "obs AS (SELECT event_id AS obs_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS txid, event_type AS observer, user_id AS peer, epoch_us(ts) // 1000 AS ms FROM events)"
EDGE, TX, OBS = f"WITH {EDGE_SQL} ", f"WITH {EDGE_SQL}, {TX_SQL} ", f"WITH {OBS_SQL} "
