import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens import session
from ledgerlens.operators.traversal import money_moves
from ledgerlens.plans import views as V


def test_partitions_of_edges_grow_with_their_rows(spark, sf_dir, monkeypatch):
    used = lambda: V.edges(spark, sf_dir).select(F.spark_partition_id().alias("p"), "txid").distinct()
    assert used().select("p").distinct().count() <= 8
    monkeypatch.setattr(session, "LOT_ROWS", 200)
    found = used()
    assert found.select("p").distinct().count() > 20
    assert found.count() == found.select("txid").distinct().count()  # a transaction's rows stay together


@pytest.mark.parametrize("name", ["agg_degree", "agg_m4", "chain_index", "m_mix_tx", "g_change", "agg_signals", "x_net_sum", "g_trace_up", "g_alert_trace"])
def test_same_rows_in_many_lots(spark, sf_dir, monkeypatch, name):
    rows = lambda: sorted(map(str, entry.queries()[name](spark, sf_dir).collect()))
    few = rows()
    monkeypatch.setattr(session, "LOT_ROWS", 200)
    assert rows() == few


def test_moves_keep_the_edges_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "LOT_ROWS", 200)
    for moves in money_moves(V.edges(spark, sf_dir)):
        assert moves.select(F.spark_partition_id().alias("p")).distinct().count() > 20
