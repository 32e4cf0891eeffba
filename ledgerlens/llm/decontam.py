"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are words (runs of letters and digits, lower case). Fixed masks look at some positions of a window and ignore the
others, so that a window still hashes alike where ignored words are replaced (Ma, Tromp and Li 2002). Every window of
every document is hashed under each mask and joined with the windows of the benchmark; a hit says which offset lays the
item over the document. Around it the words are compared one by one, and any run that holds enough matches at
``IDENTITY`` or more makes the document contaminated: the best run (a match counts 1, a replaced word -``PENALTY``) where
that is one, else the run at ``IDENTITY`` or more with most matches.

The benchmark's windows are counted first: up to ``BROADCAST_SEEDS`` they are broadcast and no text is shuffled;
beyond, the same join is a shuffle. Hits are few, and go back to the documents the same way.

Null and empty texts and items have no words and no hits. An item under ``SHORTEST`` words stands in many texts by chance; it
is found in documents of the very same words and no others. Repeated items each report; repeated rows of a document report once. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.joins import by_ids, narrow
from ledgerlens.session import checkpoint

#: Positions that each mask looks at. The first allows any one word in five to be replaced.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 3, 4, 7, 9, 10, 11), (0, 2, 3, 6, 8, 9, 10), (0, 1, 2, 3, 4), (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: The fourth mask is for all items. Those after it, for items of up to SHORT_ITEM words, allow any one word to be replaced.
TINY_MASK, SHORT_ITEM, SHORTEST = 4, 9, 5
#: Matches asked of a run: this many, or IDENTITY of the item where that is less; and their share of the run.
MATCHES, IDENTITY, PENALTY = 12, 0.8, 2
BROADCAST_SEEDS, BROADCAST_HITS = 2_000_000, 2_000_000


def words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, masks: list[int]) -> DataFrame:
    """``id, at, seed`` for each window and mask, from ``id, words``."""
    span = max(p for m in masks for p in MASKS[m]) + 1
    shifted = [F.slice("words", j + 1, F.greatest(F.size("words") - j, F.lit(0))).alias(f"w{j}") for j in range(span)]
    rows = df.select("id", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    hashed = [F.when(F.col(f"w.w{MASKS[m][-1]}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w.w{p}") for p in MASKS[m]])) for m in masks]
    return rows.select("id", "at", F.explode(F.array(*hashed)).alias("seed")).where("seed IS NOT NULL")


def _best_run(match: Column) -> Column:
    """``(start, end, matches)`` of the best run of a row of booleans."""

    def add(s: Column, hit: Column) -> Column:
        gain = F.when(hit, 1).otherwise(-PENALTY)
        fresh = s["score"] <= 0
        score, start = F.when(fresh, gain).otherwise(s["score"] + gain), F.when(fresh, s["at"]).otherwise(s["start"])
        n = F.when(fresh, hit.cast("int")).otherwise(s["n"] + hit.cast("int"))
        better = score > s["top"]
        pick = lambda new, old: F.when(better, new).otherwise(s[old])
        return F.struct((s["at"] + 1).alias("at"), score.alias("score"), start.alias("start"), n.alias("n"), pick(score, "top").alias("top"), pick(start, "from").alias("from"), pick(s["at"] + 1, "to").alias("to"), pick(n, "matches").alias("matches"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "score", "start", "n", "top", "from", "to", "matches")])
    return F.aggregate(match, zero, add)


def _any_run(match: Column) -> Column:
    """``(from, to, matches)`` of the run of most matches at IDENTITY or more: one where a match counts 1 and another word -4 and the sum is not negative.

    A run that ends at a sum is longest from the first place where the sum so far was not above it; ``lows`` has these
    places, and the matches before them, by how far below zero the sum was.
    """

    def add(s: Column, hit: Column) -> Column:
        at, n, total = s["at"] + 1, s["n"] + hit.cast("int"), s["sum"] + F.when(hit, 1).otherwise(-4)
        new = F.greatest(F.lit(0), F.lit(1) - total - F.size(s["lows"]))
        lows = F.when(new > 0, F.concat(s["lows"], F.array_repeat(F.struct(at.alias("at"), n.alias("n")), new))).otherwise(s["lows"])
        low = F.element_at(lows, F.greatest(F.lit(0), -total) + 1)
        better = n - low["n"] > s["matches"]
        pick = lambda value, old: F.when(better, value).otherwise(s[old])
        return F.struct(at.alias("at"), n.alias("n"), total.alias("sum"), lows.alias("lows"), pick(low["at"], "from").alias("from"), pick(at, "to").alias("to"), pick(n - low["n"], "matches").alias("matches"))

    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("n"), zero.alias("sum"), F.array(F.struct(zero.alias("at"), zero.alias("n"))).alias("lows"), zero.alias("from"), zero.alias("to"), zero.alias("matches"))
    return F.aggregate(match, start, add, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["matches"].alias("matches")))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, start, end, n_words, n_matches``: the best overlap of each document with each item that it holds.

    ``start`` and ``end`` are word places in the document, the end exclusive.
    """
    every_item = benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("item_words")).where("item IS NOT NULL AND size(item_words) > 0")
    every_item = checkpoint(every_item.distinct())
    items, short = every_item.where(F.size("item_words") >= SHORTEST), every_item.where(F.size("item_words") < SHORTEST)
    lengths = items.agg(F.min(F.size("item_words"))).first()[0]
    masks = [m for m in range(len(MASKS)) if m < TINY_MASK or (lengths or SHORT_ITEM + 1) <= SHORT_ITEM]
    source = items.select(F.struct("item", F.size("item_words").alias("size")).alias("id"), F.col("item_words").alias("words"))
    usual = seeds(source, [m for m in masks if m < TINY_MASK])
    tiny = [m for m in masks if m >= TINY_MASK]
    every = usual.unionByName(seeds(source.where(F.col("id.size") <= SHORT_ITEM), tiny)) if tiny else usual
    wanted = every.select(F.col("id.item").alias("item"), F.col("id.size").alias("size"), F.col("at").alias("item_at"), "seed").distinct()
    wanted = checkpoint(wanted)
    small = wanted.count() <= BROADCAST_SEEDS
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = texts.select("id", words(F.col("text")).alias("words"))
    hits = seeds(rows, masks).join(F.broadcast(wanted) if small else wanted, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    hits = checkpoint(hits)
    few = hits.count() <= BROADCAST_HITS
    held = by_ids(texts, hits.select("id").distinct(), "id").select("id", words(F.col("text")).alias("words"))
    placed = held.join(F.broadcast(hits) if few else hits, "id").join(F.broadcast(items) if small else items, "item")
    first = F.greatest(F.lit(0), -F.col("offset"))
    n = F.greatest(F.least(F.size("item_words"), F.size("words") - F.col("offset")) - first, F.lit(0))
    match = F.zip_with(F.slice("item_words", first + 1, n), F.slice("words", first + F.col("offset") + 1, n), lambda a, b: a == b)
    runs = placed.select("id", "item", (first + F.col("offset")).alias("base"), F.size("item_words").alias("size"), match.alias("match"), _best_run(match).alias("top"))
    asked = F.least(F.lit(MATCHES), F.ceil(F.col("size") * IDENTITY))
    fits = (F.col("top.matches") >= asked) & (F.col("top.matches") >= (F.col("top.to") - F.col("top.from")) * IDENTITY)
    top = F.struct(*[F.col(f"top.{c}").alias(c) for c in ("from", "to", "matches")])
    runs = runs.withColumn("run", F.when(fits, top).otherwise(_any_run(F.col("match"))))
    length = F.col("run.to") - F.col("run.from")
    found = runs.where(F.col("run.matches") >= asked).select("id", "item", F.struct(F.col("run.matches").alias("n"), (-F.col("base") - F.col("run.from")).alias("early"), length.alias("length")).alias("best"))
    best = found.groupBy("id", "item").agg(F.max("best").alias("best"))
    start = -F.col("best.early")
    found = best.select(F.col("id").alias(key), F.col("item").alias(item), start.alias("start"), (start + F.col("best.length")).alias("end"), F.col("best.length").alias("n_words"), F.col("best.n").alias("n_matches"))
    if short.isEmpty():
        return found
    same = rows.where((F.size("words") > 0) & (F.size("words") < SHORTEST)).distinct().join(narrow(short), F.col("words") == F.col("item_words"))
    n = F.size("words")
    whole = same.select(F.col("id").alias(key), F.col("item").alias(item), F.lit(0).alias("start"), n.alias("end"), n.alias("n_words"), n.alias("n_matches"))
    return found.unionByName(whole)
