"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets, and components.

1. Each text becomes its set of word shingles and the set its SuperMinHash signature (Ertl 2017): the slots that an
   element goes to come from a random permutation, one step of it at a time, so that the slots are negatively
   correlated and a signature is done once every slot holds a value below the next step's. Steps are taken for all
   elements of a block of texts at once.
2. Equal sets are one class, named by its smallest id. Only classes go on: a third of all rows being copies costs one
   pre-aggregated minimum.
3. Signatures are cut into bands. In each bucket of classes that share a band one hub is drawn, the same order in all
   buckets, and every member is held against the hub only.
4. Pairs are verified on full sets, and links joined into components.
   Where a bucket's members are left in several components, a second hub is drawn, each bucket for itself.
5. Buckets whose members still are in several components are finished exactly, by an inverted index of their classes
   with prefix and positional filters (Xiao et al. 2008): shingles stand from rare to frequent, two sets that link share
   one among the first few of each, and the places of the first shared one bound what both can share. In a large
   family of variants these first shingles are those that the variants' own edits made, so that few pairs meet. Of
   these, parity bitmaps of the sets (Sandes et al. 2020) rule most out: bits in which two bitmaps differ are no more
   than the shingles in which the sets do.

The number of bands makes the chance that a pair at the threshold shares none below ``MISS``.

Null ids get no component and are kept; null, blank and wordless texts have empty sets and link with nothing. Rows with
equal ids share the id's component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import U, mix, shingle_set, tidy
from ledgerlens.llm.joins import by_ids, narrow
from ledgerlens.operators.components import connected_components, joined_components
from ledgerlens.session import checkpoint

#: Slots of a band, chance of missing a pair at the threshold, bytes of text hashed at once, bits of a set's bitmap.
BAND_ROWS, MISS, BLOCK_BYTES, BITS = 4, 1e-7, 1_000_000, 512


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row a set; a value is the step in the high half and a random number in the low half."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, dtype=U)
    item = np.concatenate(sets) if sets else np.empty(0, dtype=U)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for step in range(slots):
        if not len(item):
            break
        draw = mix(item + U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = step + ((draw & U(0xFFFFFFFF)) * U(slots - step) >> U(32)).astype(np.int64)
        value = U(step << 32) | (draw >> U(32))
        if perm is None:
            slot = at
        else:
            every = np.arange(len(item))
            slot = perm[every, at].astype(np.int64)
            perm[every, at] = perm[:, step]
        np.minimum.at(sig, (doc, slot), value)
        open_ = (sig >= U((step + 1) << 32)).any(axis=1)
        keep = open_[doc]
        if perm is None:
            item, doc, at = item[keep], doc[keep], at[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (len(item), 1))
            perm[np.arange(len(item)), at] = 0
        elif not keep.all():
            item, doc, perm = item[keep], doc[keep], perm[keep]
    return sig


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size > BLOCK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def signatures(df: DataFrame, key: str, text: str, width: int, bands: int) -> DataFrame:
    """``id, n, set_key, bands`` of every row; the set's digest and the band keys are null for empty sets."""
    slots = bands * BAND_ROWS
    salt = mix(np.arange(1, bands + 1, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                sets = [shingle_set(t.as_py(), width) for t in batch.column(1).slice(a, b - a)]
                parts = superminhash(sets, slots).reshape(len(sets), bands, BAND_ROWS)
                keys = np.broadcast_to(salt, (len(sets), bands)).copy()
                for r in range(BAND_ROWS):
                    keys = mix(keys * U(0x9E3779B97F4A7C15) + parts[:, :, r])
                keys = keys.view(np.int64)
                cols = [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [k if len(s) else None for k, s in zip(keys, sets, strict=True)]]
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["id", "n", "set_key", "bands"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), "id long, n long, set_key binary, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``rep, items`` (sorted distinct shingles as bytes) from ``rep, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "items"])

    return texts.select("rep", "text").mapInArrow(tidy(run), "rep long, items binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a")), "a")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row."""
    rows = checkpoint(signatures(df, key, text, width, band_count(percent)))
    classes = rows.where("id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = checkpoint(classes)
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("rep"), F.col("rep"))
    hubs = checkpoint(banded.groupBy("bucket").agg(F.min_by("rep", order).alias("hub"), F.count("*").alias("size")).where("size > 1").select("bucket", "hub"))
    members = checkpoint(banded.join(narrow(hubs), "bucket").select("bucket", "rep", "n", "hub"))
    pairs = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    named = by_ids(texts, members.select("rep").distinct(), "rep")
    sets = checkpoint(shingle_sets(named, width).where("length(items) > 0").dropDuplicates(["rep", "items"]))
    sets = _named_sets(sets, classes.select("rep", "set_key"))
    found = checkpoint(connected_components(checkpoint(verify(pairs, sets, percent)), "a", "b"))
    for step in (_other_hubs, _finish):
        more = step(_open_buckets(members, found), sets, percent)
        if more is None:
            break
        found = checkpoint(joined_components(found, more, "a", "b"))
    groups = classes.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("id", "n", "set_key").join(groups, "set_key", "left")
    least = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(True)).alias("kept"))


def _named_sets(sets: DataFrame, own: DataFrame) -> DataFrame:
    """Of several rows with one id, the set that the class was named for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(x.as_buffer()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["rep", "items", "set_key"])

    repeated = sets.groupBy("rep").count().where("count > 1")
    if repeated.isEmpty():
        return sets
    return sets.mapInArrow(tidy(run), "rep long, items binary, set_key binary").join(own, ["rep", "set_key"]).select("rep", "items")


def _open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that are in several components, with their component and that of the hub."""
    comp = narrow(found).select(F.col("vertex").alias("rep"), F.col("component_id").alias("comp"))
    main = comp.select(F.col("rep").alias("hub"), F.col("comp").alias("main"))
    placed = members.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(main, "hub", "left").withColumn("main", F.coalesce("main", "hub"))
    several = checkpoint(placed.where("comp <> main").select("bucket").distinct())
    return checkpoint(placed.join(narrow(several), "bucket", "left_semi"))


def _other_hubs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links to a second hub, drawn for each bucket by itself: a class meets as many different ones as it has open buckets."""
    if placed.isEmpty():
        return None
    drawn = placed.groupBy("bucket").agg(F.min_by(F.struct(F.col("rep").alias("hub2"), F.col("comp").alias("main2")), F.struct(F.xxhash64("rep", "bucket"), "rep")).alias("h"))
    pairs = placed.join(drawn, "bucket").where("comp <> h.main2").select(F.least("rep", "h.hub2").alias("a"), F.greatest("rep", "h.hub2").alias("b")).distinct()
    return checkpoint(verify(pairs, sets, percent))


def _finish(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between classes of a bucket that the hubs leave in different components."""
    open_ = placed.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("loose"))
    open_ = checkpoint(open_)
    if open_.isEmpty():
        return None
    items = sets.join(open_.select("rep"), "rep", "left_semi")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                got = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column(1)]
                rep = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(g) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(np.concatenate(got), pa.int64())], names=["rep", "item"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                odd = [np.bincount((np.frombuffer(x.as_buffer(), dtype=U) % U(BITS)).astype(np.int64), minlength=BITS) & 1 for x in part.column(1)]
                words = np.packbits(np.array(odd, dtype=np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(w) for w in words.T.copy()]], names=["rep", *parity])

    parity = [f"w{i}" for i in range(BITS // 64)]
    folded = items.mapInArrow(tidy(fold), "rep long, " + ", ".join(f"{w} long" for w in parity))
    each = checkpoint(items.mapInArrow(tidy(spread), "rep long, item long"))
    often = each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    rarest = W.partitionBy("rep").orderBy("df", "item")
    ranked = each.join(often, "item").withColumn("shared", F.count("*").over(W.partitionBy("rep"))).withColumn("nth", F.row_number().over(rarest)).join(open_, "rep")
    ranked = ranked.withColumn("place", F.col("n") - F.col("shared") + F.col("nth"))
    prefix = ranked.where(f"100 * (place - 1) <= {100 - percent} * n").select("item", "rep", "n", "comp", "loose", "place")
    prefix = checkpoint(prefix.join(folded, "rep"))
    differ = " + ".join(f"bit_count(a.{w} ^ b.{w})" for w in parity)
    a, b = prefix.where("loose").alias("a"), prefix.alias("b")
    fits = f"a.item = b.item AND a.comp <> b.comp AND (a.rep < b.rep OR NOT b.loose) AND {100 + percent} * (1 + least(a.n - a.place, b.n - b.place)) >= {percent} * (a.n + b.n) AND {100 + percent} * (a.n + b.n - ({differ})) >= {2 * percent} * (a.n + b.n)"
    rest = a.join(b, F.expr(fits)).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    return checkpoint(verify(rest, sets, percent))
