"""Phrase collocations: words that stand together more often than their parts would have it, per language.

Counts come from weighted acyclic automata (``transducers``): each task counts the phrases of its texts, sorts them and
builds transducers by range of their first word; transducers of a range are united, which sums their weights; a
candidate's first parts are read on its own path, its rests are looked up by composing a transducer of the rests asked for
with the one of the range where they begin.

So that tasks needn't carry the many phrases which are too rare to matter, three passes before count hashes: of words, of
pairs of words that may be frequent, and of three or four words whose pairs may be. A hash is at least as frequent as
what it stands for, so what is left out is rare for certain; what is kept is counted exactly. The frequent hashes travel
as bit masks of a fixed size: with more phrases than bits they leave out less, and nothing else changes.

A null text is empty and a null language is ``und``. Repeated rows count as often as they stand there. Texts are read whole
(very long ones in parts that overlap by three words, each counted once). A table without rows gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import mix, tidy
from ledgerlens.llm.pretokens import distinct_spans, span_hashes
from ledgerlens.llm.transducers import Transducer, build, compose, rows, union
from ledgerlens.llm.transducers import phrases as listed
from ledgerlens.session import checkpoint

U = np.uint64
#: Bits of a mask: 8 MB.
MASK_BITS = 26
#: Bytes of text that are looked at together; different hashes, and phrases, that a task holds before it sends them on.
TEXT_BLOCK, HASHES_HELD, PHRASES_HELD = 1_500_000, 1_000_000, 800_000
#: Splits of the input that make a shard, where there are enough: what a shard has often is counted before anything is sent.
SHARD_SPLITS = 3
#: Shards whose transducers are united in one step; frequent phrases for which there is a range.
FAN_IN, RANGE_PHRASES = 256, 5_000
#: Salts of a language's ranking before the last one.
RANK_SALTS = 64

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256)], dtype=np.uint8)
_GAP = re.compile(rb"[\x20\t.,;:!?\n-\r]")


def _word_starts(kind: np.ndarray) -> np.ndarray:
    word = kind == 0
    return np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))


def _parts(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """``(part, words at its head that the part before had too)``."""
    at = old = seek = 0
    while len(text) - at > TEXT_BLOCK and (gap := _GAP.search(text, max(at + TEXT_BLOCK, seek))):
        seek = gap.end()
        part = text[at : gap.start()]
        yield part, old
        starts = _word_starts(_KIND[np.frombuffer(part, dtype=np.uint8)])[-overlap:]
        old = len(starts)
        at = at + int(starts[0]) if old else gap.start()
    yield text[at:], old


class Block:
    """The words of some texts: hashes (with the language) and which neighbours stand in one piece."""

    def __init__(self, texts: list[tuple[bytes, str, int]]):
        self.langs = sorted({lang for _, lang, _ in texts})
        self.bytes = np.frombuffer(b"\n".join(t for t, _, _ in texts).translate(_LOWER) + b"\n", dtype=np.uint8)
        kind = _KIND[self.bytes]
        self.starts = _word_starts(kind)
        word = kind == 0
        self.ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        edges = np.cumsum([len(t) + 1 for t, _, _ in texts])
        of = np.searchsorted(edges, self.starts, "right")
        self.lang = np.array([self.langs.index(lang) for _, lang, _ in texts], dtype=np.int64)[of] if texts else np.empty(0, np.int64)
        own = np.array([span_hashes(np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\n", np.uint8), np.array([0]), np.array([len(lang.encode("utf-8", "surrogatepass"))]))[0] for lang in self.langs], dtype=U)
        self.hash = mix(span_hashes(self.bytes, self.starts, self.ends) ^ own[self.lang]) if len(self.starts) else np.empty(0, U)
        first = np.searchsorted(of, np.arange(len(texts)))
        self.fresh = np.arange(len(of)) - first[of] >= np.array([o for _, _, o in texts], dtype=np.int64)[of] if len(of) else np.empty(0, bool)
        piece = np.cumsum(kind == 2)[self.starts]
        self.joined = np.concatenate((piece[1:] == piece[:-1], [False]))[: len(piece)]  # with the next word

    def phrases(self, width: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each place on, and where they are a phrase that wasn't counted before (and all ``ok``)."""
        n = len(self.starts) - width + 1
        if n < 1:
            return np.empty(0, U), np.empty(0, bool)
        hashes, there = self.hash[:n].copy(), self.fresh[width - 1 :].copy()
        for j in range(1, width):
            hashes = mix(hashes * U(0x9E3779B97F4A7C15) + self.hash[j : n + j])
            there &= self.joined[j - 1 : n + j - 1]
        for j in range(width if ok is not None else 0):
            there &= ok[j : n + j]
        return hashes, there


def _blocks(batch: pa.RecordBatch, overlap: int) -> Iterator[Block]:
    texts, size = [], 0
    langs = batch.column(1).to_pylist()
    for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), langs, strict=True):
        for part, old in _parts(text or b"", overlap):
            texts.append((part, "und" if lang is None else lang, old))
            size += len(part)
            if size > TEXT_BLOCK:
                yield Block(texts)
                texts, size = [], 0
    if texts:
        yield Block(texts)


def _inside(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> U(58 - (len(mask) - 1).bit_length())  # a mask has a power of two of words of 64 bits
    return (mask[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) != 0


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    number, found = pd.factorize(np.concatenate([h for h, _ in parts]))
    return found, np.bincount(number, weights=np.concatenate([n for _, n in parts]), minlength=len(found)).astype(np.int64)


def _hash_counts(df: DataFrame, widths: tuple[int, ...], longest: int, masks) -> DataFrame:
    """``lang, hash, n``: how often hashes of phrases of these widths occur; with a language and no hash its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        held, size = [], 0
        names = ["lang", "hash", "n"]

        def out(parts):
            h, n = _summed(parts)
            return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=names)

        for batch in batches:
            for block in _blocks(batch, longest - 1):
                known = None if masks is None else _inside(masks.value[-1], block.phrases(len(masks.value))[0])
                for width in widths:
                    h, there = block.phrases(width)
                    for j in range(0 if known is None else width - len(masks.value) + 1):
                        there &= known[j : len(there) + j]
                    number, found = pd.factorize(h[there])
                    held.append((found, np.bincount(number, minlength=len(found))))
                    size += len(found)
                if widths == (1,):
                    for i, n in enumerate(np.bincount(block.lang[block.fresh], minlength=len(block.langs)).tolist()):
                        totals[block.langs[i]] += n
                if size > 2 * HASHES_HELD:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HASHES_HELD:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=names)

    return df.mapInArrow(tidy(run), "lang string, hash bigint, n bigint")


def _mask(frequent: DataFrame) -> tuple[np.ndarray, int]:
    """The bits of these hashes, in a mask whose size is fixed, and how many there are."""
    bit = F.shiftrightunsigned("hash", 64 - MASK_BITS)
    found = frequent.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"), F.count("*").alias("n")).toPandas()
    mask = np.zeros(1 << (MASK_BITS - 6), dtype=np.int64)
    mask[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return mask.view(U), int(found["n"].sum())


GRAMS = f"lang string, part int, shard int, {Transducer.FIELDS}"


def _shard_transducers(df: DataFrame, longest: int, masks, ranges: int) -> DataFrame:
    """Transducers of the phrases that may be frequent, a row for each task, language and range of first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId(), Shard(ranges)
        for batch in batches:
            for block in _blocks(batch, longest - 1):
                held.add(block, longest, masks.value)
                if held.size > 2 * PHRASES_HELD:
                    held.sum_up()
                    if held.size > PHRASES_HELD:
                        yield from held.transducers(shard)
                        held = Shard(ranges)
        held.sum_up()
        if held.size:
            yield from held.transducers(shard)

    return df.mapInArrow(tidy(run), GRAMS)


class Shard:
    """A task's counts of phrases, as places of their words in the task's own list."""

    def __init__(self, ranges: int):
        self.ranges, self.size = ranges, 0
        self.place: dict[tuple[str, bytes], int] = {}
        self.part: list[int] = []
        self.counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first and second word, third and fourth, how often

    def add(self, block: Block, longest: int, masks: list[np.ndarray]) -> None:
        frequent = np.flatnonzero(_inside(masks[0], block.hash))
        local, first = distinct_spans(block.bytes, block.starts[frequent], block.ends[frequent])
        spelled = [block.bytes[block.starts[i] : block.ends[i]].tobytes() for i in frequent[first].tolist()]
        own, found = pd.factorize(local * len(block.langs) + block.lang[frequent])
        one = np.empty(len(found), dtype=np.int64)
        one[own] = frequent
        part = _range_of(block.hash[one], self.ranges).tolist()
        places = np.empty(len(found), dtype=np.int64)
        for i, (key, p) in enumerate(zip(found.tolist(), part, strict=True)):
            word = (block.langs[key % len(block.langs)], spelled[key // len(block.langs)])
            places[i] = at = self.place.setdefault(word, len(self.part))
            if at == len(self.part):
                self.part.append(p)
        word = np.zeros(len(block.starts) + longest, dtype=np.int64)  # from 1; 0 is none
        word[frequent] = places[own] + 1
        for width in range(1, longest + 1):
            h, there = block.phrases(width, word[: len(block.starts)] > 0)
            if width > 1:
                there &= _inside(masks[min(width, len(masks)) - 1], h)
            at = np.flatnonzero(there)
            w = [word[at + j] if j < width else np.int64(0) for j in range(4)]
            self._keep((w[0] << 32) + w[1], np.zeros(len(at), dtype=np.int64) + (w[2] << 32) + w[3], None)

    def _keep(self, head: np.ndarray, tail: np.ndarray, n: np.ndarray | None) -> None:
        (a, heads), (b, tails) = pd.factorize(head), pd.factorize(tail)
        number, found = pd.factorize(a * np.int64(max(1, len(tails))) + b)
        summed = np.bincount(number, weights=n, minlength=len(found)).astype(np.int64)
        self.counts.append((heads[found // max(1, len(tails))], tails[found % max(1, len(tails))], summed))
        self.size += len(found)

    def sum_up(self) -> None:
        held, self.counts, self.size = self.counts, [], 0
        if held:
            self._keep(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def transducers(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A transducer for each language and range; phrases are sorted by the places of their words in the sorted list."""
        ((head, tail, n),) = self.counts
        words = list(self.place)
        order = sorted(range(len(words)), key=lambda i: words[i][1])
        rank = np.empty(len(words) + 1, dtype=np.int64)
        rank[np.array(order, dtype=np.int64) + 1] = np.arange(len(words))
        rank[0] = -1
        cols = [rank[c] for c in (head >> 32, head & 0xFFFFFFFF, tail >> 32, tail & 0xFFFFFFFF)]
        langs = sorted({lang for lang, _ in words})
        lang = np.array([langs.index(lang) for lang, _ in words], dtype=np.int64)[(head >> 32) - 1]
        group = np.array(self.part, dtype=np.int64)[(head >> 32) - 1] * len(langs) + lang
        by = np.lexsort((*reversed(cols), group))
        width = sum((c >= 0).astype(np.int64) for c in cols)
        spelled = [words[i][1].decode("utf-8", "surrogatepass") for i in order]
        made, cuts = [], np.flatnonzero(np.diff(group[by])) + 1
        for own in np.split(by, cuts):
            rows = zip(*(c[own].tolist() for c in cols), width[own].tolist(), n[own].tolist(), strict=True)
            found, key = build((r[: r[4]], r[5]) for r in rows), int(group[own[0]])
            made.append({"lang": langs[key % len(langs)], "part": key // len(langs), "shard": shard, **found.columns(spelled)})
            if len(made) == 64:
                yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)


_SCHEMA = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("final", pa.list_(pa.int64())), ("arcs", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("word", pa.list_(pa.int32())), ("weight", pa.list_(pa.int64())), ("target", pa.list_(pa.int32()))])


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _united(df: DataFrame, by: list[str], least: int = 0) -> DataFrame:
    """One transducer for all of a group, without phrases of fewer than ``least``."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [k.as_py() for k in key]
        found = union([Transducer.of(r) for r in rows(batches)], least)
        yield pa.RecordBatch.from_pylist([{"lang": own[0], "part": own[1], "shard": own[2] if len(own) > 2 else 0, **found.columns()}], schema=_SCHEMA)

    return df.groupBy(*by).applyInArrow(run, GRAMS)


def _hash_of(lang: str, words: list[str]) -> np.ndarray:
    """Hashes of single words as in a block of that language."""
    return Block([(w.encode("utf-8", "surrogatepass"), lang, 0) for w in words]).hash


def _candidates(grams: DataFrame, ranges: int) -> DataFrame:
    """``lang, phrase, a, firsts, rests, parts``: phrases of two words and more, counts of their first 1, 2, ... words, and what
    follows those, with the range that it begins in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            found, path = [], {}
            for words, n in listed(Transducer.of(row)):
                path[len(words)] = n
                if len(words) > 1:
                    found.append((words, n, [path[k] for k in range(1, len(words))]))
            known = sorted({w for words, _, _ in found for w in words})
            part = dict(zip(known, _range_of(_hash_of(row["lang"], known), ranges).tolist(), strict=True)) if known else {}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * len(found), pa.string()),
                    pa.array([" ".join(w) for w, _, _ in found], pa.string()),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([f for _, _, f in found], pa.list_(pa.int64())),
                    pa.array([[" ".join(w[k:]) for k in range(1, len(w))] for w, _, _ in found], pa.list_(pa.string())),
                    pa.array([[part[x] for x in w[1:]] for w, _, _ in found], pa.list_(pa.int32())),
                ],
                names=["lang", "phrase", "a", "firsts", "rests", "parts"],
            )

    return grams.select("lang", *[c for c in grams.columns if c != "lang"]).mapInArrow(tidy(run), "lang string, phrase string, a bigint, firsts array<bigint>, rests array<string>, parts array<int>")


def _looked_up(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang, rest, r``: counts of the phrases asked for (``lang, part, rest``, each once), by composition with their range."""

    def run(key, asking: pa.Table, counting: pa.Table) -> pa.Table:
        wanted = sorted(tuple(x.split(" ")) for x in asking.column("rest").to_pylist())
        queries = build((w, 0) for w in wanted)
        found = [p for row in counting.to_pylist() for p in compose(queries, Transducer.of(row))] if wanted else []
        if len(found) != len(wanted):
            raise ValueError(f"{len(wanted) - len(found)} parts of phrases have no count")
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string()), "rest": pa.array([" ".join(p) for p, _ in found], pa.string()), "r": pa.array([n for _, n in found], pa.int64())})

    return asked.groupBy("lang", "part").cogroup(grams.groupBy("lang", "part")).applyInArrow(run, "lang string, rest string, r bigint")


def frequent_phrases(df: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, int]:
    """``(grams, totals, ranges)``: transducers of all phrases of up to ``longest`` words that occur ``least`` times or more, a
    row for each language and range of first words; ``lang, n`` with all words of a language; the number of ranges."""
    if longest != 4:
        raise ValueError("the passes before are made for phrases of up to four words")
    spark, own = df.sparkSession, df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    masks, shared, totals = [], None, None
    for widths in ((1,), (2,), (3, 4)):
        # tasks have summed already: dealt first, rows aren't gathered once more before the shuffle
        counted = _hash_counts(own, widths, longest, shared).repartition("hash").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
        kept = checkpoint(counted.where((F.col("n") >= least) | F.col("hash").isNull()))
        totals = kept.where("hash IS NULL").select("lang", "n") if totals is None else totals
        masks.append(_mask(kept.where("hash IS NOT NULL")))
        if shared is not None:
            shared.destroy()
        shared = spark.sparkContext.broadcast([m for m, _ in masks])
    ranges = max(8, -(-sum(n for _, n in masks) // RANGE_PHRASES))
    shards, cores = max(1, own.rdd.getNumPartitions()), spark.sparkContext.defaultParallelism
    if shards > 2 * cores:
        shards = max(2 * cores - 1, -(-shards // SHARD_SPLITS))
        own = own.coalesce(shards)
    grams = _shard_transducers(own, longest, shared, ranges)
    while shards > FAN_IN:
        grams = checkpoint(_united(grams.withColumn("shard", (F.col("shard") / FAN_IN).cast("int")), ["lang", "part", "shard"]))
        shards = -(-shards // FAN_IN)
    return checkpoint(_united(grams, ["lang", "part"], least)), totals, ranges


def collocations(df: DataFrame, least: int = 30, cover: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to four words.

    ``a`` is how often a phrase occurs, ``l`` and ``r`` how often the two parts of its lowest-scoring cut do, ``n`` the number of
    words of the language. The score of a cut is 2000000 * a / (l + r), floored. Phrases inside of a longer one that occurs at
    least ``cover`` % as often are left out. Ties go to the more frequent and then to the lesser phrase.
    """
    grams, totals, ranges = frequent_phrases(df, 4, least, text, lang)
    found = checkpoint(_candidates(grams, ranges))
    cuts = found.select("lang", "phrase", "a", F.posexplode(F.arrays_zip("firsts", "rests", "parts")).alias("k", "cut")).select("lang", "phrase", "a", "k", F.col("cut.firsts").alias("l"), F.col("cut.rests").alias("rest"), F.col("cut.parts").alias("part"))
    counts = _looked_up(cuts.select("lang", "part", "rest").distinct(), grams)
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.join(counts, ["lang", "rest"]).withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    words = F.split("phrase", " ")
    inner = F.explode(F.expr("filter(flatten(transform(sequence(2, 3), m -> transform(sequence(1, 3), i -> IF(m < size(w) AND i + m - 1 <= size(w), array_join(slice(w, i, m), ' '), NULL)))), x -> x IS NOT NULL)"))
    longer = found.withColumn("w", words).where(F.size("w") > 2).select("lang", inner.alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    covered = F.expr(f"100 * CAST(f AS DECIMAL(19,0)) >= {int(cover)} * CAST(a AS DECIMAL(19,0))")
    own = scored.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | ~covered)
    flat = own.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = flat.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))).withColumn("_n", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w)::BIGINT + 1)) AS i FROM words),
runs AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM found),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, size, w, unnest(range(1, size)) AS i FROM found WHERE size > 2),
inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS f FROM spans CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
own AS (
  SELECT c.* FROM lowest c LEFT JOIN inner_phrases i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
