"""Readers and checks for transaction captures in CSV, JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ips import ip_hex

LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
NUMBERS = ("src_port", "dst_port", "fee", "asn")
#: Fixed column order of a capture.
COLUMNS = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country", "asn", "observer_id")
ALIASES = {"observer": "observer_id", "sensor_id": "observer_id"}
FORMATS = {".csv": "csv", ".json": "json", ".xml": "xml"}
_RECORD = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in LISTS else T.StringType()) for c in (*COLUMNS, *ALIASES)])


def detect_format(path: str, declared: str | None = None) -> str:
    """The declared format, else by suffix; contents are never sniffed."""
    if declared:
        if declared.lower() not in FORMATS.values():
            raise ValueError(f"unknown format {declared}")
        return declared.lower()
    for suffix, name in FORMATS.items():
        if path.lower().endswith(suffix):
            return name
    raise ValueError(f"can't tell the format of {path}")


def split_list(value: Column) -> Column:
    """A cell as a list: a JSON array if bracketed, else split at the first of ``;``, ``|`` and space that it holds."""
    clean = F.trim(value)
    cut = lambda sep: F.filter(F.transform(F.split(clean, sep), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(clean.startswith("["), F.from_json(clean, T.ArrayType(T.StringType())))
        .when(clean.contains(";"), cut(";")).when(clean.contains("|"), cut(r"\|")).when(clean.contains(" "), cut(" "))
        .when(clean != "", F.array(clean)).otherwise(F.array().cast("array<string>"))
    )


def read_capture(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """A capture with its fixed columns; absent ones are null and rows without a txid go."""
    kind = detect_format(path, declared)
    if kind == "csv":
        rows = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    elif kind == "xml":
        rows = spark.read.format("xml").option("rowTag", "record").option("attributePrefix", "").option("inferSchema", False).load(path)
    else:
        one = spark.read.option("multiLine", True).schema(T.StructType([*_RECORD, *[T.StructField(k, T.ArrayType(_RECORD)) for k in ("records", "data", "transactions", "observations")]])).json(path)
        inner = F.coalesce("records", "data", "transactions", "observations")
        whole = F.array(F.struct(*[F.col(f.name) for f in _RECORD]))
        rows = one.select(F.inline(F.coalesce(inner, whole)))
    return canonical(rows)


def canonical(rows: DataFrame) -> DataFrame:
    lower = {c.lower(): c for c in rows.columns}
    kinds = {f.name: f.dataType for f in rows.schema}

    def pick(name: str) -> Column:
        found = [lower[n] for n in (name, *[a for a, c in ALIASES.items() if c == name]) if n in lower]
        if not found:
            return F.lit(None).cast("array<string>" if name in LISTS else "double" if name in NUMBERS else "string")
        if name in LISTS:
            kind = kinds[found[0]]
            if isinstance(kind, T.ArrayType):
                return F.col(found[0]).cast("array<string>")
            if isinstance(kind, T.StructType):
                return F.flatten(F.array(*[F.col(f"{found[0]}.{f.name}") if isinstance(f.dataType, T.ArrayType) else F.array(F.col(f"{found[0]}.{f.name}").cast("string")) for f in kind]))
            return split_list(F.col(found[0]).cast("string"))
        value = F.coalesce(*[F.col(c).cast("string") for c in found])
        return F.expr(f"try_cast(`{found[0]}` AS DOUBLE)") if name in NUMBERS else F.nullif(F.trim(value), F.lit(""))

    return rows.select(*[pick(c).alias(c) for c in COLUMNS]).where("txid IS NOT NULL")


def pairs(addresses: Column, amounts: Column) -> Column:
    """Addresses with their amounts, sorted; what is missing on either side is an empty string."""
    both = F.arrays_zip(F.coalesce(addresses, F.array().cast("array<string>")).alias("a"), F.coalesce(amounts, F.array().cast("array<string>")).alias("b"))
    return F.array_sort(F.transform(both, lambda p: F.concat_ws("=", F.coalesce(p["a"], F.lit("")), F.coalesce(p["b"], F.lit("")))))


def chain_key() -> Column:
    """Digest of what the chain says about a transaction."""
    return F.sha2(F.concat_ws("|", "txid", F.array_join(pairs(F.col("input_addresses"), F.col("input_amounts")), ","), F.array_join(pairs(F.col("output_addresses"), F.col("output_amounts")), ","), F.coalesce(F.col("fee").cast("string"), F.lit("")), F.coalesce("script_type", F.lit(""))), 256)


def observation_key() -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("txid", "observer_id", "src_ip", "src_port", "timestamp")]), 256)


#: Fixed limits: no time is before this (2009, in seconds), and none more than a day ahead.
FIRST_TIME, AHEAD = 1_230_768_000, 86_400


def violations(now_s: int) -> Column:
    """The first thing wrong with a row: time, port, address or number; null if nothing.

    What is missing or can't be read is not wrong here, but for addresses, which must be what they claim to be.
    """
    ms = timestamp_ms(F.col("timestamp"))
    beyond = lambda c, most: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) & ~F.col(c).between(0, most)
    bad_ip = lambda c: F.col(c).isNotNull() & (F.trim(c) != "") & ip_hex(F.col(c)).isNull()
    return (
        F.when((ms < FIRST_TIME * 1000) | (ms > (now_s + AHEAD) * 1000), "timestamp")
        .when(beyond("src_port", 65535) | beyond("dst_port", 65535), "port")
        .when(bad_ip("src_ip") | bad_ip("dst_ip"), "ip")
        .when(beyond("asn", 4294967295), "asn")
    )


def timestamp_ms(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds or an ISO time (UTC where it names no zone), in milliseconds."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.when(F.abs(number) >= 100_000_000_000, number).otherwise(number * 1000).cast("long")).otherwise(F.unix_millis(value.try_cast("timestamp")))


#: Fixed IPv4 special-purpose blocks (IANA registry): first octets, prefix length, class.
SPECIAL = (
    ("0.0.0.0", 8, "this-network"), ("10.0.0.0", 8, "private"), ("100.64.0.0", 10, "shared"), ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link-local"), ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 24, "protocol"), ("192.0.2.0", 24, "documentation"), ("192.88.99.0", 24, "relay"), ("192.168.0.0", 16, "private"), ("198.18.0.0", 15, "benchmarking"), ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"), ("224.0.0.0", 4, "multicast"), ("255.255.255.255", 32, "broadcast"), ("240.0.0.0", 4, "reserved"),
)


def ipv4_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    octet = lambda i: F.element_at(p, i).try_cast("long")
    valid = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & (F.greatest(*[octet(i) for i in range(1, 5)]) <= 255)
    return F.when(valid, octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))


def ip_class(number: Column) -> Column:
    """Class of an IPv4 address given as a number; the first block that holds it."""
    out = F.when(number.isNull(), "invalid")
    for start, bits, name in SPECIAL:
        low = sum(int(o) << s for o, s in zip(start.split("."), (24, 16, 8, 0), strict=True))
        out = out.when(number.between(low, low + 2 ** (32 - bits) - 1), name)
    return out.otherwise("global")


def asn_class(asn: Column) -> Column:
    """Private-use, reserved or public autonomous-system numbers (RFC 6996, RFC 7300, RFC 5398)."""
    return F.when(asn.between(64512, 65534) | asn.between(4200000000, 4294967294), "private").when((asn == 0) | (asn == 65535) | (asn == 4294967295), "reserved").when(asn.between(64496, 64511) | asn.between(65536, 65551), "documentation").otherwise("public")
