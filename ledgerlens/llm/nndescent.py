"""Near-duplicate vectors by NN-descent (Dong, Charikar and Li 2011) as Spark joins.

1. Ids with equal vectors are one class, so that a vector that a third of all rows hold is one point with a weight.
2. Random hyperplanes deal the points into buckets a few times over; buckets are split into chunks by a hash, and each
   point starts with its best partners in its chunks.
3. Descent: a pivot's list and the points that list the pivot meet in one small group, pairs of the group are
   compared, and those better than a member's worst partner go to its list; until few lists change. Lists keep partners
   of cosine ``FLOOR`` or more: two partners of one point at 0.9 are never below 0.62 to each other.
4. Edges at the threshold join points into components. A list that is full of links may leave out links to other
   components, where the other end's list is full too. Such points are compared across components exactly: in blocks
   with a center and a radius, of which only those near enough to each other meet. Within the components so joined,
   links are counted without a bound on their number. By the angles to the component's first point most pairs are
   certain (the sum of two angles is within the threshold's); counts by angle settle these, and only what is left is
   compared pair by pair, in blocks.
5. A bounded sample of vectors is compared with all, exactly. While less than ``RECALL`` of its links is found, steps
   2 to 4 go on with new hyperplanes, at most ``ROUNDS`` times; if that does not do, the call raises an error.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths never link. Of several vectors under one id the least counts, for all rows of that id. Null ids link with
nothing, have no component and are kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components, joined_components
from ledgerlens.session import checkpoint

#: Partners in a list; least cosine in it; tables and points of a chunk at the start; passes; share of changes to stop at.
PARTNERS, FLOOR, TABLES, CHUNK, PASSES, SETTLED = 12, 0.6, 10, 96, 8, 0.002
#: Vectors of the audit, share of their links to find, rounds; width of a bin of angles; rows and columns of a block.
AUDIT, RECALL, ROUNDS, BIN, BLOCK = 400, 0.999, 4, 0.001, 512
#: Edges and vectors of a partition of a written table.
EDGES, VECTORS = 200_000, 20_000


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: list, dim: int) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _unit(flat, len(flat) // len(column))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one value in column 0, which may go over several batches."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        marks = kept.column(0).to_numpy()
        cuts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        start = 0
        for cut in cuts:
            yield kept.slice(start, cut - start)
            start = cut
        kept = kept.slice(start).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a group its best partners there that beat its worst one."""
    names, out, size = ["a", "b", "sim"], [], 0
    for group in _groups(batches):
        ids = group.column("node").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        if len(ids) < 2:
            continue
        x = _matrix(group.column("v").combine_chunks().take(pa.array(first)))
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        worst = group.column("worst").to_numpy()[first]
        k = min(PARTNERS, len(ids) - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, best, 1)
        row, col = np.nonzero((value >= FLOOR) & (value > worst[:, None]))
        out.append((ids[row], ids[best[row, col]], value[row, col]))
        size += len(row)
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
            out, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def local_joins(rows: DataFrame) -> DataFrame:
    """Edges ``a, b, sim`` from ``grp, node, worst, v``."""
    return rows.select("grp", "node", "worst", "v").repartition("grp").sortWithinPartitions("grp").mapInArrow(_compare, "a long, b long, sim double")


def start_graph(points: DataFrame, seed: int) -> DataFrame:
    """Edges within chunks of hyperplane buckets."""
    n = points.count()
    bits = min(30, max(0, math.ceil(math.log2(max(1, n) / CHUNK))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dim_of = batch.column(1).to_numpy()
            for dim in np.unique(dim_of):
                part = batch.filter(pa.array(dim_of == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, TABLES * bits))
                signs = (_matrix(part.column(2)) @ planes[dim] > 0).reshape(part.num_rows, TABLES, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((part.num_rows, TABLES), dtype=np.int64)
                codes = (codes * TABLES + np.arange(TABLES)) * 4096 + dim % 4096
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(codes), pa.list_(pa.int64()))], names=["node", "v", "codes"])

    dealt = checkpoint(points.select("node", "dim", "v").mapInArrow(deal, f"node long, v {points.schema['v'].dataType.simpleString()}, codes array<long>"))
    bucketed = dealt.select("node", F.explode("codes").alias("code"))
    sizes = bucketed.groupBy("code").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("node", "code", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)))
    seats = bucketed.join(sizes.where("n > 1"), "code").select("node", F.xxhash64("code", chunk).alias("grp"))
    return local_joins(seats.join(dealt.select("node", "v"), "node").withColumn("worst", F.lit(-2.0)))


def _shorten(edges: DataFrame) -> tuple[DataFrame, int]:
    """The best partners of each point, from ``a, b, sim, fresh``, with their ``place`` and the list's ``worst`` similarity, and how many of them are new."""
    own = W.partitionBy("a")
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    kept = once.withColumn("place", F.row_number().over(own.orderBy(F.desc("sim"), "b"))).where(F.col("place") <= PARTNERS)
    worst = F.when(F.count("*").over(own) >= PARTNERS, F.min("sim").over(own)).otherwise(-2.0)
    graph = checkpoint(kept.withColumn("worst", worst))
    n, fresh = graph.agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
    return graph.coalesce(n // EDGES + 1), fresh / max(1, n)


def descend(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Lists refined through neighbours of neighbours."""
    graph, _ = _shorten(edges.select("a", "b", "sim", F.lit(1).alias("fresh")))
    for turn in range(PASSES):
        back = W.partitionBy("b").orderBy(F.xxhash64("a", F.lit(turn)))
        reverse = graph.withColumn("place", F.row_number().over(back)).where(F.col("place") <= PARTNERS).select(F.col("b").alias("grp"), F.col("a").alias("node"))
        first = graph.where("place = 1")
        seats = graph.select(F.col("a").alias("grp"), F.col("b").alias("node")).unionByName(reverse).unionByName(first.select(F.col("a").alias("grp"), F.col("a").alias("node")))
        seen = points.select("node", "v").join(first.select(F.col("a").alias("node"), "worst"), "node")
        more = local_joins(seats.join(seen, "node")).withColumn("fresh", F.lit(1))
        graph, changed = _shorten(graph.select("a", "b", "sim", F.lit(0).alias("fresh")).unionByName(more))
        if changed <= SETTLED:
            break
    return graph.select("a", "b", "sim")


def _block_counts(u: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """``node, more``: weight of the links of each ``u`` to the ``v`` of its group past ``beyond``. Blocks are bounded by their chunks."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = _matrix(left.column("v").combine_chunks()) @ _matrix(right.column("v_r").combine_chunks()).T >= threshold
        hit &= right.column("bin_r").to_numpy()[None, :] > left.column("beyond").to_numpy()[:, None]
        hit &= right.column("node_r").to_numpy()[None, :] != left.column("node").to_numpy()[:, None]
        return pa.table({"node": left.column("node"), "more": pa.array(hit @ right.column("m_r").to_numpy(), pa.int64())})

    sizes_u = u.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("nu"))
    sizes_v = v.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("nv"))
    sizes = sizes_u.join(sizes_v, "comp")
    cell = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).alias("own")
    left = u.join(sizes, "comp").select("comp", "node", "v", "beyond", cell("nu"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)).alias("other"))
    right = v.join(sizes, "comp").select("comp", "node", "v", "m", "bin", cell("nv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nu") - 1)).alias("other"))
    left, right = left.withColumn("cell", F.xxhash64("comp", "own", "other")), right.withColumn("cell", F.xxhash64("comp", "other", "own"))
    right = right.select(*[F.col(c).alias(f"{c}_r") for c in ("cell", "node", "v", "m", "bin")])
    return left.select("cell", "node", "v", "beyond").groupBy("cell").cogroup(right.groupBy("cell_r")).applyInArrow(_both(count, "node", "more"), "node long, more long").groupBy("node").agg(F.sum("more").alias("more"))


def _centered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Angle of each vector to the center of its block, from ``block, dim, v, center``."""
    for batch in batches:
        dim_of = batch.column(1).to_numpy()
        for dim in np.unique(dim_of):
            part = batch.filter(pa.array(dim_of == dim))
            cosine = (_matrix(part.column(2)) * _matrix(part.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["block", "angle"])


def links_across(points: DataFrame, edges: DataFrame, found: DataFrame, threshold: float) -> DataFrame | None:
    """``a, b``: a link of any two blocks of different components that have one between points whose lists are full of links."""
    full = edges.groupBy("a").agg(F.count("*").alias("k"), F.min("sim").alias("low")).where((F.col("k") >= PARTNERS) & (F.col("low") >= threshold))
    comps = found.select(F.col("vertex").alias("node"), F.col("component_id").alias("comp"))
    seats = points.join(full.select(F.col("a").alias("node")), "node").join(comps, "node").select("node", "comp", "dim", "v")
    parts = seats.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    seats = checkpoint(seats.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts"))
    centers = seats.groupBy("comp", "part").agg(F.min("node").alias("block"), F.min_by("v", "node").alias("center"))
    placed = checkpoint(seats.join(centers, ["comp", "part"]).select("block", "comp", "dim", "node", "v", "center"))
    radius = placed.select("block", "dim", "v", "center").mapInArrow(_centered, "block long, angle double").groupBy("block").agg(F.max("angle").alias("radius"))
    blocks = checkpoint(placed.where("node = block").select("block", "comp", "dim", F.col("center").alias("v")).join(radius, "block"))
    if blocks.select("comp").distinct().count() < 2:
        return None
    tiles = math.ceil(blocks.count() / BLOCK)
    reach = math.acos(threshold) + 1e-6

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        angle = np.arccos(np.clip(_matrix(left.column("v").combine_chunks()) @ _matrix(right.column("v_r").combine_chunks()).T, -1, 1))
        hit = angle <= reach + get(left, "radius")[:, None] + get(right, "radius_r")[None, :]
        hit &= (get(left, "comp")[:, None] != get(right, "comp_r")[None, :]) & (get(left, "block")[:, None] < get(right, "block_r")[None, :])
        row, col = np.nonzero(hit)
        return pa.table({"a": get(left, "block")[row], "b": get(right, "block_r")[col]})

    def first_link(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = _matrix(left.column("v").combine_chunks()) @ _matrix(right.column("v_r").combine_chunks()).T >= threshold
        row, col = np.unravel_index(np.flatnonzero(hit)[:1], hit.shape)
        return pa.table({"a": left.column("node").to_numpy()[row], "b": right.column("node_r").to_numpy()[col]})

    named = lambda df: df.select(*[F.col(c).alias(f"{c}_r") for c in df.columns])
    tiled = blocks.withColumn("own", F.pmod(F.xxhash64("block"), F.lit(tiles))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    sides = tiled.groupBy("dim", "own", "other"), named(tiled).groupBy("dim_r", "other_r", "own_r")
    pairs = checkpoint(sides[0].cogroup(sides[1]).applyInArrow(_both(near, "a", "b"), "a long, b long"))
    left = pairs.join(placed.select(F.col("block").alias("a"), "node", "v"), "a")
    right = named(pairs.join(placed.select(F.col("block").alias("b"), "node", "v"), "b"))
    return checkpoint(left.groupBy("a", "b").cogroup(right.groupBy("a_r", "b_r")).applyInArrow(_both(first_link, "a", "b"), "a long, b long"))


def _both(count, *names: str):
    """``count`` where both sides have rows, else a table without rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return count(left, right)
        return pa.table({n: pa.array([], pa.int64()) for n in names})

    return run


def count_links(points: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``node, comp, links``: the weight of all links within each point's component."""
    inside = points.join(found.select(F.col("vertex").alias("node"), F.col("component_id").alias("comp")), "node")
    pivots = inside.where("node = comp").select("comp", F.col("v").alias("pivot"))

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [int(math.acos(max(-1.0, min(1.0, float((_matrix(a) * _matrix(b)).sum())))) / BIN) for a, b in ((batch.column(3).slice(i, 1), batch.column(4).slice(i, 1)) for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins, pa.int32())], names=["node", "comp", "m", "v", "bin"])

    placed = checkpoint(inside.join(pivots, "comp").select("node", "comp", "m", "v", "pivot").mapInArrow(angle, f"node long, comp long, m long, v {points.schema['v'].dataType.simpleString()}, bin int"))
    limit = int(math.acos(threshold) / BIN) - 3  # bins whose edges add up to the threshold's angle at most
    bins = placed.groupBy("comp", "bin").agg(F.sum("m").alias("m"))
    upto = bins.withColumn("total", F.sum("m").over(W.partitionBy("comp").orderBy("bin"))).select("comp", F.col("bin").alias("at"), "total")
    last = bins.groupBy("comp").agg(F.max("bin").alias("last"), F.sort_array(F.collect_list("bin")).alias("bins"))
    reach = placed.join(last, "comp").withColumn("beyond", F.lit(limit) - F.col("bin"))
    reach = reach.withColumn("at", F.array_max(F.filter("bins", lambda b: b <= F.col("beyond")))).drop("bins")
    known = reach.join(upto, ["comp", "at"], "left").withColumn("sure", F.coalesce("total", F.lit(0)) - F.when(F.col("bin") <= F.col("beyond"), F.col("m")).otherwise(0))
    known = checkpoint(known.select("node", "comp", "m", "v", "bin", "beyond", "last", "sure"))
    open_ = known.where("last > beyond")
    out = known.select("node", "comp", "sure", "m")
    if not open_.isEmpty():
        least = open_.groupBy("comp").agg(F.min("beyond").alias("least"))
        far = placed.join(least, "comp").where("bin > least").drop("least")
        out = out.join(_block_counts(open_, far, threshold), "node", "left").select("node", "comp", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("sure"), "m")
    return out.select("node", "comp", (F.col("sure") + F.col("m") - 1).alias("links"))


def audit(points: DataFrame, links: DataFrame, threshold: float) -> tuple[int, int]:
    """Links of a sample of at most about ``AUDIT`` points: found, and in truth by comparison with all points."""
    n = points.count()
    sample = points.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, AUDIT / max(1, n))))
    got = sample.join(links, "node", "left").select("node", "dim", "m", "v", F.coalesce("links", F.col("m") - 1).alias("links")).collect()
    shared = points.sparkSession.sparkContext.broadcast([(r.node, r.dim, r.v) for r in got])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list] = {}
        for node, dim, v in shared.value:
            queries.setdefault(dim, []).append((node, v))
        total = 0
        for batch in batches:
            dim_of = batch.column(1).to_numpy()
            for dim, own in queries.items():
                part = batch.filter(pa.array(dim_of == dim))
                for i in range(0, part.num_rows, 2048):
                    block = part.slice(i, 2048)
                    hit = _matrix(block.column(3)) @ _unit([v for _, v in own], dim).T >= threshold
                    hit &= block.column(0).to_numpy()[:, None] != np.array([q for q, _ in own])[None, :]
                    total += int((hit.T @ block.column(2).to_numpy()).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    true = points.select("node", "dim", "m", "v").mapInArrow(compare, "n long").agg(F.sum("n")).first()[0] or 0
    return sum(r.links for r in got), true + sum(r.m - 1 for r in got)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    single = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    named = checkpoint(single.where(usable(F.col("v"))))
    points = named.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("m")).select("node", F.size("v").cast("long").alias("dim"), "m", "v")
    points = checkpoint(points)
    points = points.coalesce(points.count() // VECTORS + 1)
    edges = None
    for turn in range(ROUNDS):
        more = start_graph(points, turn)
        edges = descend(points, more if edges is None else edges.unionByName(more))
        near = edges.where(F.col("sim") >= threshold).select("a", "b")
        found = checkpoint(connected_components(near, "a", "b"))
        across = links_across(points, edges, found, threshold)
        if across is not None and not across.isEmpty():
            found = checkpoint(joined_components(found, across, "a", "b"))
        links = checkpoint(count_links(points, found, threshold))
        got, true = audit(points, links, threshold)
        if got >= RECALL * true:
            break
    else:
        raise RuntimeError(f"only {got} of {true} links of the audited vectors were found in {ROUNDS} rounds")
    classes = points.join(links, "node", "left").select("v", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.col("m") - 1).alias("links"))
    placed = named.join(classes, "v").select("id", "comp", "links")
    least = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    out = rows.select("id").join(placed, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(True)).alias("kept"))
