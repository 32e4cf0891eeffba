"""Hilbert-curve sharding in DataFrame operations.

Metadata dimensions are quantised at their own quantiles, every row gets the Hilbert index of its grid cell, and the
order by index is cut into runs whose row counts differ by one at most. Neighbouring cells share shards, so that the
column statistics of a shard's files are narrow in every dimension at once.

A row's place is worked out without a global sort: rows of a cell are dealt by a hash into blocks of about
``BLOCK_ROWS``, so that a cell holding a third of all rows is spread over many tasks; block counts give offsets and only
the inside of a block is sorted. The grid has ``2 ** (BITS * dimensions)`` cells whatever the data's size, which bounds
the one table that is broadcast whatever its size; levels of whole strings are broadcast by their number.

Null dimensions sort first (level 0). Null texts have no bytes (size 16, CRC of nothing). Repeated rows and equal ids
each get a slot of their own; an empty table gives no rows. Columns of the input other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.joins import narrow
from ledgerlens.operators.ranges import running_sums
from ledgerlens.session import checkpoint

#: Levels of a dimension are 2 ** BITS; rows that are sorted at once.
BITS, BLOCK_ROWS = 5, 20_000


def string_levels(df: DataFrame, name: str) -> DataFrame:
    """``value, level`` of each value of a column, by the share of rows whose whole value comes before; null is level 0."""
    values = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    summed = running_sums(values, ["value"], {"upto": "n"})
    total = F.lit(2**BITS) * (F.col("upto") - F.col("n")) / F.greatest(F.lit(1), F.lit(df.count()))
    return checkpoint(summed.select("value", F.when(F.col("value").isNull(), 0).otherwise(F.floor(total)).cast("int").alias("level")))


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point given by its levels (Skilling's transpose form, AIP Conf. Proc. 707, 2004)."""
    n = len(levels)
    rounds = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in rounds])

    def undo(x: Column, step: Column) -> Column:
        q, i, first = step["q"], step["i"], F.element_at(x, 1)
        own = F.element_at(x, i + 1)
        high = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        return F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(F.when(high, q - 1).otherwise(swap))).when((k == i) & ~high, v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in levels]), undo)
    gray = F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    last = F.element_at(gray, -1)
    flips = reduce(lambda t, b: t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0)), range(bits - 1, 0, -1), F.lit(0))
    places = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda p: F.when(F.element_at(gray, p["i"] + 1).bitwiseXOR(flips).bitwiseAND(p["q"]) != 0, 1).otherwise(0)
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, p: h * 2 + bit(p))


def hilbert_shards(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``key, size, text_crc32, hilbert, shard, slot``; the dimensions are ``dims`` and the size, counts differ by one at most."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    names = [f"d{i}" for i in range(len(dims) + 1)]
    base = df.select(F.col(key).alias("k"), (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("crc"), *[F.col(c).cast("string").alias(n) for c, n in zip(dims, names, strict=False)])
    rows = checkpoint(base)
    at = [i / 2**BITS for i in range(1, 2**BITS)]
    cuts = rows.agg(F.percentile_approx("size", at, 10_000)).first()[0]
    size_level = reduce(lambda a, b: a + b, [(F.col("size") > F.lit(x)).cast("int") for x in sorted(set(cuts or []))], F.lit(0))
    placed = rows.withColumn(names[-1], size_level)
    for n in names[:-1]:
        levels = narrow(string_levels(rows, n)).withColumnRenamed("value", "_value")
        placed = placed.join(levels, F.col(n).eqNullSafe(F.col("_value"))).drop(n, "_value").withColumnRenamed("level", n)
    placed = placed.select("k", "size", "crc", *names)
    cells = placed.groupBy(*names).agg(F.count("*").alias("cell_rows")).withColumn("hilbert", hilbert_index([F.col(n) for n in names]))
    line = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(line), F.lit(0))).withColumn("blocks", F.ceil(F.col("cell_rows") / BLOCK_ROWS))
    cells = checkpoint(cells)
    total = max(cells.agg(F.sum("cell_rows")).first()[0] or 0, 1)
    spread = F.pmod(F.xxhash64("k", "crc", "size"), F.lit(1 << 20))
    placed = placed.join(F.broadcast(cells), names).withColumn("block", F.floor(spread * F.col("blocks") / (1 << 20)))
    before = W.partitionBy("hilbert").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("hilbert", "block").agg(F.count("*").alias("n")).withColumn("block_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("hilbert", "block").orderBy("k", "crc", "size")
    ranked = placed.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["hilbert", "block"])
    ranked = ranked.withColumn("rank", F.col("cell_start") + F.col("block_start") + F.col("place"))
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", F.expr(f"CAST((rank * {shards}) div {total} AS INT)")).select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "hilbert", "shard", (F.col("rank") - start).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df`` as one folder a shard, each file sorted along the curve. Repeated or null keys are an error: their rows could not be told apart."""
    clash = placed.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not clash.isEmpty() or not placed.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} must be unique and not null")
    rows = df.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
