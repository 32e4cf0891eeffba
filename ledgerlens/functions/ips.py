"""Internet addresses of both versions as hexadecimal digits of fixed length, in whose order ranges can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _dotted(ip: Column) -> Column:
    """The four octets of an IPv4 address in two hexadecimal digits each, as an array."""
    return F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("long"))), 2, "0"))


def _colons(ip: Column) -> Column:
    """The 32 digits of an IPv6 address; null for what isn't one."""
    none = F.array().cast("array<string>")
    part = lambda half: F.when(half == "", none).otherwise(F.split(half, ":"))

    def digits(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    def filled(halves: Column) -> Column:
        left, right = part(F.get(halves, F.lit(0))), part(F.get(halves, F.lit(1)))
        short = _once(F.struct(left.alias("l"), right.alias("r")), lambda s: F.when(F.size(s["l"]) + F.size(s["r"]) <= 7, F.concat(s["l"], F.array_repeat(F.lit("0"), 8 - F.size(s["l"]) - F.size(s["r"])), s["r"])))
        return F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, short)

    def spelled(bare: Column) -> Column:
        last = F.substring_index(bare, ":", -1)
        tail = _once(_dotted(last), lambda o: F.concat(F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.lit(":"), F.get(o, F.lit(2)), F.get(o, F.lit(3))))
        return F.when(last.rlike(f"^{_V4}$"), F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(last)), tail)).otherwise(bare)

    return _once(_once(_once(F.lower(F.regexp_replace(ip, r"%[^%/]+$", "")), spelled), lambda w: filled(F.split(w, "::"))), digits)


def ip_hex(ip: Column) -> Column:
    """8 digits of an IPv4 address or 32 of an IPv6 address; null for what is neither.

    Octets have no leading zeros. In IPv6 ``::`` stands once for one group of zeros or more, the last two groups may be written as
    an IPv4 address, and a zone after ``%`` is left out.
    """
    return _once(F.trim(ip), lambda t: F.when(t.rlike(f"^{_V4}$"), F.array_join(_dotted(t), "")).when(t.contains(":"), _colons(t)))
