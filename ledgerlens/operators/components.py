"""Connected components by randomised contraction.

Every round maps each vertex to the neighbour (or itself) that comes first, follows that pointer once more, and
contracts the edges. First come vertices of more neighbours, by powers of two, so that the leaves of a star join its
hub at once; among equals a pseudo-random order drawn for the round decides, so that the number of live vertices falls
by a constant factor on chains too. What a hub's edges contribute is pre-aggregated before the shuffle (minimum and
count are algebraic). No task ever holds a component.

Rounds shrink the edges, and their partitions with them: one for each ``EDGES`` edges, so that a few thousand edges left
of a large graph don't cost as many shuffle files as the whole did.

Where edges never leave a part (``parted_components``) each part of bounded size is settled in a task of its own, and its edges are
shuffled once instead of several times a round; larger parts go through the rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint

#: Edges of a partition.
EDGES = 50_000
#: Edges of a part that one task settles at most, some 200 MB.
PART_EDGES = 2_000_000


def _settled(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges ``u, v`` with ``u`` before ``v``, once each, in as many partitions as their number asks for, and that number."""
    live = checkpoint(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    n = live.count()
    return live.coalesce(n // EDGES + 1), n


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(vertex, component_id)`` for every vertex of ``edges``; ``component_id`` is the smallest vertex reachable.

    Null endpoints are dropped, self loops give a component of one, repeated edges count once. No edges: no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = e.where("u = v").select(F.col("u").alias("vertex"))
    live, n = _settled(e.where("u <> v"))
    steps: list[DataFrame] = []
    while n:
        salt = F.lit(len(steps) + 1)
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = live.select(F.inline(ends))
        ranks = both.groupBy("u").agg(F.count("*").alias("n")).select("u", F.struct((-F.floor(F.log2("n"))).alias("d"), F.xxhash64("u", salt).alias("h"), F.col("u").alias("p")).alias("r"))
        best = both.join(ranks.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v").groupBy("u").agg(F.min("rv").alias("b"))
        one = ranks.join(best, "u").select("u", F.least("r", "b")["p"].alias("p"))
        two = one.alias("a").join(one.alias("b"), F.col("a.p") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.p").alias("p"))
        step = checkpoint(two).coalesce(2 * n // EDGES + 1)
        steps.append(step)
        left = live.join(step.select("u", F.col("p").alias("pu")), "u")
        moved = left.join(step.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        live, n = _settled(moved.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")))
    if not steps:
        return loops.distinct().select("vertex", F.col("vertex").alias("component_id"))

    def follow(outer: DataFrame, inner: DataFrame) -> DataFrame:
        nxt = inner.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        return outer.join(nxt, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))

    maps = [s.select(F.col("u").alias("vertex"), F.col("p").alias("root")) for s in steps]
    roots = reduce(follow, maps)
    least = roots.groupBy("root").agg(F.min("vertex").alias("component_id"))
    found = roots.join(least, "root").select("vertex", "component_id")
    alone = loops.distinct().join(found, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component_id"))
    return found.unionByName(alone)


def joined_components(found: DataFrame, more: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``found`` (``vertex, component_id``) after edges ``more`` were added: rounds run over the components that these join only.

    Endpoints that ``found`` lacks come in as components of their own first.
    """
    old = found.select(F.col("vertex"), F.col("component_id").alias("old"))
    at = lambda df, c: df.join(old.withColumnRenamed("vertex", c), c, "left").withColumn(c, F.coalesce("old", c)).drop("old")
    between = at(at(more.select(src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()), src), dst)
    roots = checkpoint(connected_components(between, src, dst)).select(F.col("vertex").alias("old"), F.col("component_id").alias("new"))
    moved = old.join(roots, "old", "left").select("vertex", F.coalesce("new", "old").alias("component_id"))
    fresh = roots.join(old.select("old").distinct(), "old", "left_anti").select(F.col("old").alias("vertex"), F.col("new").alias("component_id"))
    return moved.unionByName(fresh)


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each one's component, from edges between the vertices 0 to ``n - 1``."""
    label = np.arange(n)
    while len(u):
        u, v = label[u], label[v]
        apart = u != v
        u, v = np.minimum(u[apart], v[apart]), np.maximum(u[apart], v[apart])
        np.minimum.at(label, v, u)
        while (label[label] != label).any():
            label = label[label]
    return label


def parted_components(edges: DataFrame, part: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(part, vertex, component_id)`` of strings: components of the edges of each part, by their smallest vertex.

    Null endpoints are dropped, self loops give a component of one, repeated edges count once. A null part is one too.
    """
    known = checkpoint(edges.select(F.col(part), F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    large = checkpoint(known.groupBy(part).agg(F.count("*").alias("n")).where(F.col("n") > PART_EDGES).select(F.struct(part).alias("large")))

    def settle(table: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        code = place[ends.indices.to_numpy()]
        label = least_labels(code[: len(table)], code[len(table) :], len(order))
        names = ends.dictionary.take(order)
        value = pa.array([table.column(part)[0].as_py()] * len(names), table.schema.field(part).type)
        return pa.table({part: value, "vertex": names, "component_id": names.take(pa.array(label))})

    shape = f"{part} {known.schema[part].dataType.simpleString()}, vertex string, component_id string"
    if large.isEmpty():
        return known.groupBy(part).applyInArrow(settle, shape)
    whole, key = F.struct("_part", F.col("src").alias("v")), F.struct("_part", F.col("dst").alias("v"))
    tagged = known.withColumn("_part", F.struct(part)).join(large.withColumnRenamed("large", "_large"), F.col("_part").eqNullSafe(F.col("_large")), "left")
    found = connected_components(tagged.where("_large IS NOT NULL").select(whole.alias("src"), key.alias("dst")))
    found = found.select(F.col("vertex")["_part"][part].alias(part), F.col("vertex")["v"].alias("vertex"), F.col("component_id")["v"].alias("component_id"))
    return tagged.where("_large IS NULL").select(part, "src", "dst").groupBy(part).applyInArrow(settle, shape).unionByName(found)
