import ipaddress
import random

from pyspark.sql import functions as F

from ledgerlens.functions.ips import ip_hex


def plain(text):
    try:
        a = ipaddress.ip_address((text or "").strip(" "))
    except ValueError:
        return None
    return f"{int(a):0{8 if a.version == 4 else 32}x}"


def test_equal_to_the_standard_library(spark):
    rnd = random.Random(1)
    texts = [
        None, "", " ", "1.2.3.4", " 1.2.3.4 ", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "999.1.1.1", "255.255.255.255", "0.0.0.0", "::", "::1", "1::", ":", ":::", "::1::", "zz:", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::",
        "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "fe80::1%eth0", "fe80::1%", "fe80::1%a/b", "12345::", "g::", "::ffff:1.2.3.4", "::ffff:1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "1.2.3.4::", "1.2.3.4:1", "1:", ":1", "1.2.3.-4", "+1.2.3.4", "١.2.3.4",
    ]
    for _ in range(300):
        groups = [f"{rnd.randrange(65536):x}" if rnd.random() < 0.7 else "0" for _ in range(rnd.randint(6, 9))]
        at = rnd.randrange(len(groups))
        texts += [":".join(groups), ":".join(groups[:at]) + "::" + ":".join(groups[at + rnd.randint(0, 3) :]), str(ipaddress.IPv6Address(rnd.getrandbits(128))), ".".join(str(rnd.randrange(260)) for _ in range(4))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ip_hex(F.col("t")).alias("x")).collect()
    wrong = [(texts[r.i], r.x, plain(texts[r.i])) for r in got if r.x != plain(texts[r.i])]
    assert wrong == []
