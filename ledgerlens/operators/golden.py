"""Digests of columns and comparison of two tables' values, by sums that don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, nulls, digest`` of each column: the sum of 60 bits of each value's MD5, modulo 10^15; equal for equal multisets of values."""
    bits = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    wide = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("z", lambda c: F.count_if(F.col(c).isNull())), ("d", lambda c: F.sum(bits(c))))])
    digest = lambda i: F.coalesce(F.col(f"d{i}") % F.lit(10**15), F.lit(0)).cast("long")
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"z{i}").alias("nulls"), digest(i).alias("digest")) for i, c in enumerate(columns)])))


def value_differences(a: DataFrame, b: DataFrame, key: str, tolerance: Mapping[str, float]) -> DataFrame:
    """``column, compared, differing, only_one`` of each column: rows of both tables by key, and those whose values are further apart than its tolerance or null on one side.

    ``only_one`` counts keys that one table lacks. Keys must differ within each table.
    """
    left = a.select(key, *[F.col(c).alias(f"a{i}") for i, c in enumerate(tolerance)]).withColumn("in_a", F.lit(True))
    right = b.select(key, *[F.col(c).alias(f"b{i}") for i, c in enumerate(tolerance)]).withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full_outer")
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def apart(i: int, most: float):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        return F.coalesce(F.abs(x - y) > most, x.isNull() != y.isNull())

    sums = both.agg(F.count_if(met).alias("compared"), F.count_if(~met).alias("only_one"), *[F.count_if(met & apart(i, t)).alias(f"d{i}") for i, t in enumerate(tolerance.values())])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("compared"), F.col(f"d{i}").alias("differing"), F.col("only_one")) for i, c in enumerate(tolerance)])))
