import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import capture as S


def test_formats():
    assert [S.detect_format(p) for p in ("a.CSV", "b.json", "c.xml")] == ["csv", "json", "xml"]
    assert S.detect_format("x.dat", "JSON") == "json"
    for bad in (("x.dat", None), ("x.csv", "parquet")):
        with pytest.raises(ValueError):
            S.detect_format(*bad)


def test_one_capture_in_three_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('txid,input_addresses,output_addresses,input_amounts,fee,observer,src_port\nt1,a;b,"[""c"",""d""]",1.5;2,0.1,o1,8333\n,x,,,,,\nt2,e|f,g h,,bad,,\n')
    records = [{"txid": "t1", "input_addresses": ["a", "b"], "output_addresses": ["c", "d"], "input_amounts": ["1.5", "2"], "fee": "0.1", "sensor_id": "o1", "src_port": "8333"}, {"txid": None}, {"txid": "t2", "input_addresses": ["e", "f"], "output_addresses": ["g", "h"], "fee": "bad"}]
    (tmp_path / "b.json").write_text(json.dumps({"records": records}))
    (tmp_path / "d.json").write_text(json.dumps(records))
    (tmp_path / "c.xml").write_text("<records><record><txid>t1</txid><input_addresses><x>a</x><x>b</x></input_addresses><output_addresses><x>c</x><x>d</x></output_addresses><input_amounts><x>1.5</x><x>2</x></input_amounts><fee>0.1</fee><observer_id>o1</observer_id><src_port>8333</src_port></record><record txid='t2'><input_addresses><x>e</x><x>f</x></input_addresses><output_addresses><x>g</x><x>h</x></output_addresses><fee>bad</fee></record></records>")
    want = [("t1", ["a", "b"], ["c", "d"], 0.1, "o1", 8333.0), ("t2", ["e", "f"], ["g", "h"], None, None, None)]
    for name in ("a.csv", "b.json", "c.xml", "d.json"):
        df = S.read_capture(spark, str(tmp_path / name))
        assert tuple(df.columns) == S.COLUMNS
        rows = df.orderBy("txid").select("txid", "input_addresses", "output_addresses", "fee", "observer_id", "src_port").collect()
        assert [tuple(r) for r in rows] == want, name
    keys = {n: [r.k for r in S.read_capture(spark, str(tmp_path / n)).orderBy("txid").select(S.chain_key().alias("k")).collect()] for n in ("a.csv", "b.json")}
    assert keys["a.csv"] == keys["b.json"] and len(set(keys["a.csv"])) == 2


def test_scalars(spark):
    cells = ["[\"a\", \"b\"]", "a; b;", "a|b", "a b", "a", "", None, "a10;b0"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(S.split_list(F.col("c")).alias("x")).collect()
    assert [r.x for r in rows] == [["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], ["a"], [], [], ["a10", "b0"]]
    times = ["1700000000", "1700000000123", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "soon", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in times], "t string").select(S.timestamp_ms(F.col("t")).alias("x")).collect()]
    assert got == [1700000000000, 1700000000123, 1700000000000, 1700000000000, None, None]
    ips = {"10.1.2.3": "private", "8.8.8.8": "global", "255.255.255.255": "broadcast", "240.0.0.1": "reserved", "1.2.3": "invalid", "1.2.3.999": "invalid", "192.0.2.7": "documentation"}
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", S.ip_class(S.ipv4_number(F.col("ip"))).alias("c")).collect()
    assert {r.ip: r.c for r in got} == ips
