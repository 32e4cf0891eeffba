import math

import duckdb
import pytest

from ledgerlens.operators import metrics as M
from ledgerlens.plans import forensics
from ledgerlens.plans.catalog import ORACLE

COLUMNS = ("n", "positives", "average_precision", "normalised_ap", "roc_auc")


@pytest.mark.parametrize(("label", "precision"), [(1, 1.0), (0, math.nan)])
def test_rows_of_one_label(spark, label, precision):
    rows = spark.createDataFrame([(i, i % 3, i % 10 / 10, label) for i in range(30)], "id long, txid long, score double, label long")
    same = lambda a, b: a == b or math.isnan(a) and math.isnan(b)
    for got, n in ((M.curve_metrics(rows).first(), 30), (M.transaction_metrics(rows).first(), 3)):
        want = (n, n * label, precision, math.nan, math.nan)
        assert all(same(got[c], w) for c, w in zip(COLUMNS, want, strict=True)), got
    top = {r.k: r for r in M.at_k(rows, (5, 10)).collect()}
    assert top[5].hits == 5 * label and (same(top[5].recall, math.nan) if label == 0 else top[5].recall == round(5 / 30, 6))


def test_no_rows(spark):
    got = M.curve_metrics(spark.createDataFrame([], "id long, score double, label long")).first()
    assert all(got[c] is None for c in COLUMNS)


@pytest.mark.parametrize(("scores", "last"), [(997, math.inf), (300, -math.inf), (8, math.nan)])
def test_groups_that_are_all_positive_follow_sql(spark, tmp_path, scores, last):
    chars = [(i, 1 + i * i * 7919 % 20011, 1) for i in range(scores)]
    spark.createDataFrame(chars, "doc_id long, n_chars long, toxic int").createOrReplaceTempView("one_label")
    spark.sql("SELECT doc_id, n_chars FROM one_label").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT doc_id, toxic FROM one_label").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE["m_tx_metrics"]).fetchone()
    got = tuple(forensics.m_tx_metrics(spark, str(tmp_path)).first()[c] for c in COLUMNS)
    assert list(map(repr, got)) == list(map(repr, want)) and repr(got[3]) == repr(last)
