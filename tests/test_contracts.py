from pyspark.sql import functions as F

from ledgerlens.sources import capture as S
from ledgerlens.sources import contracts as K

SCHEMA = "txid string, timestamp string, input_addresses array<string>, input_amounts array<string>, output_addresses array<string>, output_amounts array<string>, fee string"


def rows(spark):
    good = ("2", ["a"], ["5"], ["b", "c"], ["2", "2.5"], "0.5")
    return spark.createDataFrame(
        [
            ("ok", *good), ("ok", *good), ("ok", "9", None, None, None, None, None),  # a repeat, and a row without chain facts
            ("clash", *good), ("clash", "1", ["a"], ["5"], ["b"], ["4"], "1"),
            ("nan", "1", ["a"], ["nan"], ["b"], ["x"], None), ("neg", "1", ["a"], ["-1"], [], None, "9"),
            ("fee", "1", ["a"], ["1"], ["b"], ["0.5"], "1.5"), ("fee2", "1", ["a"], ["1"], ["b"], ["0.5"], "-0.1"), ("fee3", "1", ["a"], None, ["b"], None, "7"),
            ("list", "1", ["a", "b"], ["1"], ["c"], None, None), ("addr", "1", ["a", " "], ["1", "1"], [None], None, None), ("long", "1", ["x" * 129], None, None, None, None),
            ("two words", "1", ["a"], None, None, None, None), ("t" * 129, "1", ["a"], None, None, None, None), ("net", "1", None, None, None, None, "-5"),
        ],
        SCHEMA,
    )


def test_kinds(spark):
    got = {r.txid: r.kinds for r in K.transaction_kinds(rows(spark)).collect()}
    assert got == {
        "clash": ["CONFLICTING_CHAIN_FACTS"], "nan": ["NEGATIVE_OR_NONFINITE_AMOUNT"], "neg": ["NEGATIVE_OR_NONFINITE_AMOUNT"], "fee": ["FEE_EXCEEDS_INPUTS"], "fee2": ["NEGATIVE_FEE"],
        "list": ["AMOUNT_LIST_MISMATCH"], "addr": ["ADDRESS_INVALID"], "long": ["ADDRESS_INVALID"], "two words": ["TXID_INVALID"], "t" * 129: ["TXID_INVALID"],
    }


def test_gate(spark):
    df = rows(spark)
    kinds = K.transaction_kinds(df)
    r = K.gate(df, kinds).first()
    assert (r.n_rows, r.transactions, r.quarantined, r.refused) == (16, 13, 10, True) and K.accepted(df, kinds).count() == 0
    some = df.where(F.col("txid").isin("ok", "fee3", "net", "neg"))
    kinds = K.transaction_kinds(some)
    assert {r.txid for r in K.accepted(some, kinds).collect()} == {"ok", "fee3", "net"} and not K.gate(some, kinds).first().refused
    none = df.limit(0)
    assert not K.gate(none, K.transaction_kinds(none)).first().refused
    report = {(r.part, r.kind): r.n for r in K.ingest_report(some, kinds, F.when(F.col("timestamp") == "9", "timestamp")).collect()}
    assert report == {("row", "ok"): 5, ("row", "timestamp"): 1, ("transaction", "NEGATIVE_OR_NONFINITE_AMOUNT"): 1}


ROW = "txid string, timestamp string, src_ip string, dst_ip string, src_port double, dst_port double, asn double"
NOW = 2_000_000_000


def test_rows_by_what_is_wrong(spark):
    inf, nan = float("inf"), float("nan")
    cases = [
        ("ok", "1700000000", "1.2.3.4", "::1", 1.0, 65535.0, 4294967295.0, None), ("blank", None, " ", None, None, None, None, None), ("unread", "soon", None, None, nan, inf, -inf, None),
        ("early", "1230767999", None, None, None, None, None, "timestamp"), ("first", "1230768000", None, None, None, None, None, None), ("late", "2000086401", None, None, None, None, None, "timestamp"), ("ahead", "2000086400", None, None, None, None, None, None),
        ("src", "1700000000", "999.1.1.1", None, None, None, None, "ip"), ("dst", "1700000000", "1.1.1.1", "zz:", None, None, None, "ip"), ("port", "1700000000", "bad", None, 65536.0, None, None, "port"), ("minus", "1700000000", None, None, None, -1.0, None, "port"), ("asn", "1700000000", None, None, None, None, 4294967296.0, "asn"),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], ROW)
    assert {r.txid: r.k for r in df.select("txid", S.violations(NOW).alias("k")).collect()} == {c[0]: c[7] for c in cases}


def test_bad_rows_go_before_transactions_are_judged(spark):
    df = S.canonical(rows(spark).where(F.col("txid").isin("ok", "clash", "neg")).withColumn("timestamp", F.lit("1700000000")).withColumn("src_ip", F.when((F.col("txid") == "clash") & (F.col("fee") == "1"), "999.1.1.1").when(F.col("txid") == "neg", "1.2.3.4.5").otherwise("1.2.3.4")))
    got = K.enforce(df, NOW)
    assert got.kinds.collect() == []  # the contradiction stood in a bad row, and so did the negative amount
    g = got.gate.first()
    assert (g.n_rows, g.transactions, g.quarantined, g.refused) == (6, 3, 0, False)
    assert sorted(r.txid for r in got.rows.collect()) == ["clash", "ok", "ok", "ok"] and got.rows.columns == df.columns
    assert {(r.part, r.kind): r.n for r in got.report.collect()} == {("row", "ok"): 4, ("row", "ip"): 2}
    assert K.enforce(df.limit(0), NOW).rows.collect() == []
