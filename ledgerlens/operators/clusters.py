"""Entity clusters by common inputs, their summaries, and how they agree with known entities."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components, parted_components
from ledgerlens.operators.ranges import places
from ledgerlens.operators.transactions import change_candidates, star_edges
from ledgerlens.session import LOT_ROWS, checkpoint, checkpoint_folder


def _by_step(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``step, address, cluster_id`` of ``nodes`` (step, address), joined by ``links`` (step, src, dst) within their steps."""
    part = F.lpad(F.col("step").cast("string"), 3, "0").alias("part")
    found = parted_components(links.select(part, "src", "dst"), "part").withColumnRenamed("vertex", "address")
    own = nodes.select("step", "address", part).repartition("part", "address").distinct()
    met = own.join(found, (own.part.eqNullSafe(found.part)) & (own.address == found.address), "left")
    return met.select("step", own.address, F.concat_ws(":", own.part, F.coalesce("component_id", own.address)).alias("cluster_id"))


def step_links(edge: DataFrame) -> DataFrame:
    """``step, src, dst``: addresses that spend together."""
    return star_edges(edge).select("step", F.col("center").alias("src"), F.col("address").alias("dst")).distinct()


def monthly_clusters(edge: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """``step, address, cluster_id`` of every address that spends in a step; addresses that spend together are one entity of that step. ``stars``: ``step_links``, where they are at hand."""
    return _by_step(edge.where("role = 'in'"), stars or step_links(edge))


def monthly_clusters_with_change(edge: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """The same with each step's chosen change outputs joined to their senders."""
    stars = stars or step_links(edge)
    ins = edge.where("role = 'in'")
    sender = ins.groupBy("txid", "step").agg(F.min_by("address", F.struct("pos", "address")).alias("sender"))
    change = change_candidates(edge).where("chosen").select("txid", "address").join(sender, "txid").where("address <> sender")
    links = stars.unionByName(change.select("step", F.col("sender").alias("src"), F.col("address").alias("dst")))
    return _by_step(ins.select("step", "address").union(change.select("step", "address")), links)


def cluster_summary(edge: DataFrame, clusters: DataFrame) -> DataFrame:
    ins = edge.where("role = 'in'").join(clusters, ["step", "address"])
    return ins.groupBy("cluster_id").agg(F.count_distinct("address").alias("n_addresses"), F.count_distinct("txid").alias("n_txs"), F.round(F.sum("amount"), 2).alias("total_amount"))


def cluster_index(clusters: DataFrame) -> DataFrame:
    """Members of clusters of two or more."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("address").alias("representative")).where("size > 1")
    return clusters.join(size, "cluster_id")


def merge_counters(clusters: DataFrame) -> DataFrame:
    """Each step's addresses, clusters, merges and largest clusters."""
    return size_counters(clusters.groupBy("step", "cluster_id").agg(F.count("*").alias("size")).groupBy("step", "size").agg(F.count("*").alias("n")))


def size_counters(size: DataFrame) -> DataFrame:
    """The same from how many clusters of each size there are (``step, size, n``)."""
    best = W.partitionBy("step").orderBy(F.desc("size"))
    size = size.withColumn("second", F.when(F.col("n") > 1, F.col("size")).otherwise(F.lead("size").over(best))).withColumn("first", F.row_number().over(best) == 1)
    total = lambda c: F.sum(F.col("n") * c)
    out = size.groupBy("step").agg(total(F.col("size")).alias("addresses"), F.sum("n").alias("clusters"), F.max("size").alias("largest"), total(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("covered"), F.max(F.when(F.col("first"), F.col("second"))).alias("second"))
    return out.select("step", "addresses", "clusters", (F.col("addresses") - F.col("clusters")).alias("merges"), "largest", "second", F.round(F.col("covered") / F.col("addresses"), 6).alias("coverage"))


def binary_entropy(p: Column) -> Column:
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def purity(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: members by class (1 suspicious, 2 regular, other unknown), purity, entropy, majority, contamination."""
    got = clusters.join(labels, "address", "left")
    bad, good = F.sum(F.when(F.col("class") == 1, 1).otherwise(0)), F.sum(F.when(F.col("class") == 2, 1).otherwise(0))
    out = got.groupBy("cluster_id").agg(F.count("*").alias("size"), bad.alias("bad"), good.alias("good"))
    known, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    return out.select(
        "cluster_id", "size", "bad", "good", F.round(known / F.col("size"), 6).alias("coverage"), F.when(known > 0, F.round(F.greatest("bad", "good") / known, 6)).alias("purity"), F.when(known > 0, F.round(binary_entropy(share), 6)).alias("entropy"),
        F.when(known == 0, "NONE").when(F.col("bad") == F.col("good"), "TIE").when(F.col("bad") > F.col("good"), "BAD").otherwise("GOOD").alias("majority"), ((F.col("bad") > 0) & (F.col("good") > 0)).alias("contaminated"),
    )


def contingency(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    return clusters.join(entities, "address").groupBy("entity", "cluster_id").agg(F.count("*").alias("n"))


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def micro(cells: DataFrame) -> DataFrame:
    """Pair counts and precision, recall and F1 over all pairs."""
    both = lambda keys: cells.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("p"))
    parts = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"), F.sum("n").alias("n")).join(F.broadcast(both(["cluster_id"]).withColumnRenamed("p", "c"))).join(F.broadcast(both(["entity"]).withColumnRenamed("p", "e")))
    p, r = F.col("tp") / F.when(F.col("c") > 0, F.col("c")), F.col("tp") / F.when(F.col("e") > 0, F.col("e"))
    long = lambda c: c.cast("long")
    return parts.select(long(F.col("tp")).alias("tp"), long(F.col("c") - F.col("tp")).alias("fp"), long(F.col("e") - F.col("tp")).alias("fn"), long(pairs(F.col("n")) - F.col("c") - F.col("e") + F.col("tp")).alias("tn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.when(p + r > 0, p + r), 6).alias("f1"))


def macro(cells: DataFrame) -> DataFrame:
    """Per entity pair precision, recall and verdict. Precision of an entity without predicted pairs is undefined."""
    size = cells.groupBy("cluster_id").agg(F.sum("n").alias("size"))
    out = cells.join(size, "cluster_id").groupBy("entity").agg(F.sum("n").alias("members"), F.count("*").alias("clusters"), F.sum(pairs(F.col("n"))).alias("tp"), F.sum(F.col("n") * (F.col("size") - F.col("n"))).alias("foreign"))
    p = F.col("tp") / F.when(F.col("tp") + F.col("foreign") > 0, F.col("tp") + F.col("foreign"))
    r = F.col("tp") / F.when(F.col("members") > 1, pairs(F.col("members")))
    split, merged = F.col("clusters") > 1, F.col("foreign") > 0
    verdict = F.when(split & merged, "SPLIT+MERGED").when(split, "SPLIT").when(merged, "MERGED").otherwise("PERFECT")
    return out.select("entity", "members", "clusters", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), verdict.alias("verdict"))


def permuted_pairs(clusters: DataFrame, entities: DataFrame, trials: int) -> DataFrame:
    """Same-cluster pairs of one entity: as they are (trial 0) and with the entities dealt anew among the addresses in each trial.

    The order of a trial is that of a digest of trial and address, so that it can be repeated anywhere. Members are numbered once, in
    order; a digest's first digits, which are spread evenly, deal them into buckets of bounded size, and counts of the buckets give offsets.
    Who is alone in a cluster has no pairs.
    """
    own = clusters.join(entities, "address").select("cluster_id", F.concat_ws("|", "cluster_id", "address").alias("member"), "entity")
    slots = checkpoint(places(own, ["member"]))
    whole = slots.groupBy("cluster_id", "entity").agg(F.count("*").alias("n")).groupBy().agg(F.sum(pairs(F.col("n"))).cast("long").alias("pairs")).select(F.lit(0).alias("trial"), "pairs").where("pairs IS NOT NULL")
    digits, n = 3, slots.count()
    while n > 16**digits * LOT_ROWS:
        digits += 1
    drawn = F.unhex(F.md5(F.concat_ws("|", F.col("trial").cast("string"), "member").cast("binary")))
    every = slots.select("member", "entity", "place", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).select("trial", drawn.alias("drawn"), "place", "entity")
    every = every.withColumn("bucket", F.conv(F.substring(F.hex("drawn"), 1, digits), 16, 10).cast("int"))
    sizes = every.groupBy("trial", "bucket").agg(F.count("*").alias("n"))
    before = checkpoint(sizes.select("trial", "bucket", (F.sum("n").over(W.partitionBy("trial").orderBy("bucket")) - F.col("n")).alias("before")))
    inside = W.partitionBy("trial", "bucket").orderBy("drawn", "place")
    dealt = every.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(before), ["trial", "bucket"]).select("trial", (F.col("before") + F.col("rank")).alias("place"), "entity")
    several = slots.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    seats = slots.select("cluster_id", "place").join(several, "cluster_id")
    cells = seats.join(dealt, "place").groupBy("trial", "cluster_id", "entity").agg(F.count("*").alias("n"))
    out = cells.groupBy("trial").agg(F.sum(pairs(F.col("n"))).cast("long").alias("pairs"))
    all_trials = slots.limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return whole.unionByName(all_trials.join(out, "trial", "left").select("trial", F.coalesce("pairs", F.lit(0)).alias("pairs")))


def history_clusters(edge: DataFrame) -> DataFrame:
    """``address, cluster_id`` of every spending address over the whole history; addresses that ever spend together are one entity."""
    found = connected_components(star_edges(edge).select(F.col("center").alias("src"), F.col("address").alias("dst"))).withColumnRenamed("vertex", "address")
    return edge.where("role = 'in'").select("address").distinct().join(found, "address", "left").select("address", F.coalesce("component_id", "address").alias("cluster_id"))


def spending_links(edge: DataFrame, change: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)`` with the step from which on they stand: ``vertex, at`` of spending addresses, ``src, dst, at`` of addresses
    that spend together; with ``change`` also chosen change outputs and their links to the sender."""
    ins = edge.where("role = 'in'")
    links = star_edges(edge).select(F.col("center").alias("src"), F.col("address").alias("dst"), F.col("step").alias("at"))
    nodes = ins.select(F.col("address").alias("vertex"), F.col("step").alias("at"))
    if change:
        sender = ins.groupBy("txid", "step").agg(F.min_by("address", F.struct("pos", "address")).alias("sender"))
        chosen = checkpoint(change_candidates(edge).where("chosen").select("txid", "address").join(sender, "txid").where("address <> sender"))
        links = links.unionByName(chosen.select(F.col("sender").alias("src"), F.col("address").alias("dst"), F.col("step").alias("at")))
        nodes = nodes.unionByName(chosen.select(F.col("address").alias("vertex"), F.col("step").alias("at")))
    return nodes.groupBy("vertex").agg(F.min("at").alias("at")), links.groupBy("src", "dst").agg(F.min("at").alias("at"))


@dataclass
class Growth:
    """Clusters as they stand at the end of every step.

    A vertex is in a block (``blocks``: era, vertex, block): what it belonged to before the era of a step, or itself. ``moved`` says
    which cluster a block that the era's links touch is in at a step (at, block, cluster_id, weight); other blocks are clusters
    as they are (``still``: era, block, weight, since).
    """

    blocks: DataFrame
    moved: DataFrame
    still: DataFrame
    first: int
    last: int
    width: int

    def sizes(self) -> DataFrame:
        """``step, size, n``: how many clusters of each size there are at the end of each step."""
        moved = self.moved.groupBy("at", "cluster_id").agg(F.sum("weight").alias("size")).groupBy(F.col("at").alias("step"), "size").agg(F.count("*").alias("n"))
        end = F.least(self.first + (F.col("era") + 1) * self.width - 1, F.lit(self.last))
        still = self.still.groupBy("era", "since", "weight").agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.col("since"), end.cast("int"))).alias("step"), F.col("weight").alias("size"), "n")
        return moved.unionByName(still).groupBy("step", "size").agg(F.sum("n").alias("n"))

    def size_of(self, asked: DataFrame) -> DataFrame:
        """``vertex, at, size``: the size of a vertex's cluster at the end of a step at which it is there (``asked``: vertex, at)."""
        own = asked.withColumn("era", _era("at", self.first, self.width)).join(self.blocks, ["era", "vertex"])
        total = self.moved.groupBy("at", "cluster_id").agg(F.sum("weight").alias("size"))
        moved = self.moved.join(total, ["at", "cluster_id"]).select("at", "block", "size")
        alone = self.still.select("era", "block", F.col("weight").alias("alone"))
        return own.join(moved, ["at", "block"], "left").join(alone, ["era", "block"], "left").select("vertex", "at", F.coalesce("size", "alone").alias("size"))


def _era(c: str, first: int, width: int) -> Column:
    return F.floor((F.col(c) - first) / width).cast("int")


def growing_clusters(nodes: DataFrame, links: DataFrame, last: int | None = None) -> Growth | None:
    """Clusters at the end of each step up to ``last`` (else that of the last new node), by all links that stand by then (see
    ``spending_links``); None without nodes.

    Steps are gathered in eras, about as many as an era has steps. First come the clusters before each era, one era after the
    other: its links are put between the clusters before it, those within one are left out, and the rest joins clusters for the
    next. Then come those of every step, in one run over the links between the clusters before their era, repeated for each later
    step of the era alone. So a link is in one run of its era and is repeated at most as often as an era has steps, and clusters
    that an era leaves alone aren't repeated at all.
    """
    span = nodes.agg(F.min("at"), F.max("at")).first()
    if span[0] is None:
        return None
    first, last = span[0], max(span[1], last or span[1])
    width = math.ceil(math.sqrt(last - first + 1))
    eras = (last - first) // width + 1
    tag = lambda at, c: F.concat_ws(":", F.lpad(F.col(at).cast("string"), 6, "0"), c)
    nodes, links = checkpoint(nodes.withColumn("own", _era("at", first, width))), checkpoint(links.where("at IS NOT NULL").withColumn("own", _era("at", first, width)))

    spark, folder = nodes.sparkSession, f"{checkpoint_folder(nodes)}/growth-{uuid.uuid4()}"

    def stored(df: DataFrame, name: str, era: int) -> DataFrame:  # with checkpoints planning takes minutes after some eras, as each step's plan builds on the one before
        path = f"{folder}/{name}/era={era}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    held = None
    for era in range(eras):
        here = nodes.where(F.col("own") == era).select("vertex", F.col("vertex").alias("block"), F.col("at").cast("int").alias("since"))
        if held is not None:
            here = here.unionByName(held.withColumn("since", F.lit(first + era * width).cast("int")))
        here = stored(here, "blocks", era)
        at = lambda df, c: df.join(here.select(F.col("vertex").alias(c), F.col("block").alias(f"b_{c}")), c)  # noqa: B023, E731
        ends = at(at(links.where(F.col("own") == era), "src"), "dst").where("b_src <> b_dst")
        apart = stored(ends.groupBy(F.least("b_src", "b_dst").alias("u"), F.greatest("b_src", "b_dst").alias("v")).agg(F.min("at").alias("at")), "between", era)
        if era < eras - 1:
            found = connected_components(apart, "u", "v").withColumnRenamed("vertex", "block")
            held = here.join(found, "block", "left").select("vertex", F.coalesce("component_id", "block").alias("block"))
    blocks, between = (spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "between"))
    touched = between.select("era", F.col("u").alias("block")).union(between.select("era", "v")).distinct()
    weights = checkpoint(blocks.groupBy("era", "block").agg(F.count("*").alias("weight"), F.min("since").alias("since")))
    end = F.least(first + (F.col("era") + 1) * width - 1, F.lit(last)).cast("int")
    steps = between.select("u", "v", F.explode(F.sequence(F.col("at"), end)).alias("at"))
    joined = connected_components(steps.select(tag("at", "u").alias("src"), tag("at", "v").alias("dst"))).withColumnRenamed("vertex", "node")
    there = weights.join(touched, ["era", "block"], "left_semi").select("block", "weight", F.explode(F.sequence(F.col("since"), end)).alias("at")).withColumn("node", tag("at", "block"))
    moved = there.join(joined, "node", "left").select("at", "block", F.coalesce("component_id", "node").alias("cluster_id"), "weight")
    return Growth(blocks.select("era", "vertex", "block"), checkpoint(moved), weights.join(touched, ["era", "block"], "left_anti"), first, last, width)


def sign_flip_test(differences: DataFrame, by: str, most: int = 20) -> DataFrame:
    """``by, folds, mean, p``: share of all sign assignments of a group's fold differences whose mean is as far from 0 as theirs, exactly.

    Groups have ``most`` folds at the outside (``by, fold, difference``); more are an error, since the assignments double with each.
    """
    folds = differences.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("fold", "difference"))).alias("f")).select(by, F.transform("f", lambda x: x["difference"]).alias("d"))
    checked = folds.withColumn("n", F.when(F.size("d") <= most, F.size("d")).otherwise(F.raise_error(F.lit(f"more than {most} folds"))))
    every = checked.select(by, "d", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, n)") - 1)).alias("signs"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda t, i: t + F.get("d", i) * F.when(F.getbit("signs", i) == 1, -1.0).otherwise(1.0))
    own = F.aggregate("d", F.lit(0.0), lambda t, x: t + x)
    hit = F.abs(total) >= F.abs(own) - 1e-9
    return every.groupBy(by).agg(F.max("n").alias("folds"), F.round(F.max(own / F.col("n")), 6).alias("mean"), F.round(F.avg(hit.cast("double")), 8).alias("p"))
