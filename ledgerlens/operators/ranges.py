"""Running sums, places and exact quantiles over a whole table's order, without all of its rows in one task.

Rows are dealt into ranges of the order, sums of the ranges (one row a task) give offsets, and windows run inside a range.
Where many rows share a value they are counted first, so that a value that a third of all rows holds is one row here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint


def running_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], descending: bool = False) -> DataFrame:
    """``df`` with, for each new name in ``sums``, the sum of a column up to and with the row. Rows must differ in ``keys``; nulls come first (last if descending)."""
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])


def places(df: DataFrame, keys: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the order of ``keys``, in which rows must differ.

    Ranges are sorted as they are dealt, so a row's place in its range is its number in its partition and nothing is shuffled again.
    """
    numbered = F.monotonically_increasing_id()  # the partition above 33 bits of places
    ranged = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", numbered))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ranged.withColumn("_range", part).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, (F.col("_before") + inside + 1).alias(name))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``quantiles`` (an array by ``shares``): linear between the two values next to each place, nulls left out.

    Without ``by`` it is one row, of nulls if there are no values.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    summed = running_sums(counted, [*by, "_v"], {"_upto": "_n"})
    groups = summed.groupBy(*by).agg(F.sum("_n").alias("_size"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    ranked = summed.join(groups, list(by)) if by else summed.join(F.broadcast(groups))
    low, high = F.col("_upto") - F.col("_n") - F.col("_start"), F.col("_upto") - F.col("_start")
    at = [F.lit(float(s)) * (F.col("_size") - 1) for s in shares]
    holds = lambda place: (low <= place) & (place < high)
    picked = [f(F.when(holds(g(p)), F.col("_v"))).alias(f"_{n}{i}") for i, p in enumerate(at) for n, f, g in (("a", F.min, F.floor), ("b", F.min, F.ceil))]
    fraction = [F.max(p - F.floor(p)).alias(f"_f{i}") for i, p in enumerate(at)]
    rows = ranked.groupBy(*by).agg(*picked, *fraction)
    return rows.select(*by, F.array(*[F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i in range(len(at))]).alias("quantiles"))
