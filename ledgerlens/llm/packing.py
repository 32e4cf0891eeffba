"""Packing of tokenized documents into as few sequences as can be: patterns fitted to the histogram of lengths.

1. Tasks tokenize whole texts and cut documents that are longer than a sequence into pieces; the pieces are checkpointed.
2. The histogram of piece lengths (one number for each length up to a sequence's) goes to the driver. There all patterns of
   two or three lengths that fill a sequence exactly are enumerated (but for short ones, which fill gaps later), and how
   often each is to be used is fitted to the histogram by non-negative least squares, rounded, and kept within what there is.
3. Lengths that this leaves over are packed best fit, longest first, as counts and not as rows.
4. Each piece takes a place among those of its length, and the plan's table says which sequence and offset that place has.
   Places come from a window over small salted groups of a length, so that a length which a third of all pieces share
   doesn't meet in a task.

The plan's size hangs on the sequence length alone. A null text is empty; an empty text is the separator alone. Repeated
rows are packed as often as they stand there. Pieces that differ in nothing may swap their places. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerlens.llm.hashing import tidy
from ledgerlens.llm.pretokens import cut_words, distinct_spans, parts
from ledgerlens.session import checkpoint

#: Characters that are cut at once, and words that a task remembers.
TEXT_BLOCK, MEMO_WORDS = 1_000_000, 250_000
#: Pieces of a length that get their places together.
GROUP_ROWS = 20_000
#: Rounds of the fit, patterns looked at a round, and the change of a repeat count at which it ends.
ROUNDS, PICKS, SETTLED = 400, 20_000, 0.05
#: Pieces under this share of a sequence are left for the gaps.
FILLER = 1 / 16

_ID = np.dtype("<u4")


class Encoder:
    """A task's tokenizer with a bounded memo of words' ids (as little-endian bytes)."""

    def __init__(self, definition: str, memo_words: int = MEMO_WORDS):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.memo_words = self.tokenizer.model, memo_words
        printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype=_ID) for p in parts(text, TEXT_BLOCK)])

    def learn(self, words: list[str]) -> None:
        """Ids of new words by the tokenizer's merges; each is spelled in the tokenizer's alphabet of bytes."""
        spelled = "".join(words).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        upto, at, flat, ends = 0, 0, [], []
        for word in words:
            upto += len(word) if word.isascii() else len(word.encode("utf-8", "surrogatepass"))
            flat += [t.id for t in self.model.tokenize(spelled[at:upto])]
            ends.append(4 * len(flat))
            at = upto
        ids = np.array(flat, dtype=_ID).tobytes()
        self.young.update((w, ids[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.young) > self.memo_words:
            self.young, self.old = {}, self.young
        new = [w for w in words if w not in self.young]
        self.young.update((w, self.old[w]) for w in new if w in self.old)
        self.learn([w for w in new if w not in self.old])
        return list(map(self.young.__getitem__, words))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined, points, starts, ends, of, odd = cut_words(texts)
        number, first = distinct_spans(points, starts, ends)
        known = self.words([joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(known), dtype=_ID)
        lens = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        takes = lens[number]
        upto = np.cumsum(takes)
        inside = np.arange(int(takes.sum())) - np.repeat(upto - takes, takes)
        ids = flat[np.repeat((np.cumsum(lens) - lens)[number], takes) + inside]
        last = np.searchsorted(of, np.arange(len(texts)), "right")
        upto = np.append(0, upto)[last]
        out = np.split(ids, upto[:-1])
        return [self.whole(t) if o else i for t, o, i in zip(texts, odd.tolist(), out, strict=True)]


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    if hash(definition) not in _encoders:
        _encoders.clear()
        _encoders[hash(definition)] = Encoder(definition)
    return _encoders[hash(definition)]


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """``(row, part of a text)`` in blocks of about TEXT_BLOCK characters."""
    block, size = [], 0
    for row, text in enumerate(texts):
        for part in parts(text, TEXT_BLOCK) if len(text) > TEXT_BLOCK else [text]:
            block.append((row, part))
            size += len(part)
            if size > TEXT_BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def pieces(df: DataFrame, path: str, size: int = 2048, separator: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and ``ids`` if asked for): every document's ids and the separator, cut to ``size``.

    The first piece of a longer document is the shorter one; ``start`` is the number of its ids before a piece.
    """
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids
    end = np.array([separator], dtype=_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, cols, ids_out, open_row, open_ids = [], [[], [], [], []], [], -1, []

            def close():
                ids = np.concatenate([*open_ids, end])
                head = len(ids) % size or size
                cuts = [0, *range(head if len(ids) > size else len(ids), len(ids) + 1, size)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(open_row)
                    for col, value in zip(cols, (i, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        col.append(value)
                    if with_ids:
                        ids_out.append(ids[a:b].astype(np.int32))

            for block in _blocks(texts):
                for (row, _), ids in zip(block, encoder.ids([p for _, p in block]), strict=True):
                    if row != open_row:
                        if open_row >= 0:
                            close()
                        open_row, open_ids = row, []
                    open_ids.append(ids)
            if open_row >= 0:
                close()
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(tidy(run), T.StructType(fields))


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All sets of two or three of these lengths that fill ``size`` exactly, a row each, longest first; 0 for no third."""
    there = np.zeros(size + 1, dtype=bool)
    there[lengths] = True
    found = []
    for a in lengths[lengths < size]:
        b = lengths[(lengths <= a) & (lengths <= size - a)]
        c = size - a - b
        fits = (c <= b) & ((c == 0) | there[c])
        found.append(np.stack([np.full(int(fits.sum()), a), b[fits], c[fits]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)


def fit(histogram: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """How often to use each pattern: the x >= 0 that minimises the squared difference of ``histogram`` and what x uses.

    Differences are weighted by length, as long pieces are harder to place elsewhere. Solved by coordinate steps: a round
    moves, each to its own minimum, the patterns of greatest gain that have no length in common.
    """
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size
    weight[0] = 0
    left, x = histogram.astype(float), np.zeros(len(shapes))
    left[0] = 0
    same = (shapes[:, :, None] == shapes[:, None, :]).sum(axis=2)  # of a length that stands twice both copies count twice
    norm = (weight[shapes] * same).sum(axis=1)
    for _ in range(ROUNDS):
        step = np.maximum((weight * left)[shapes].sum(axis=1) / norm, -x)
        gain = step * step * norm
        top = np.argpartition(gain, -PICKS)[-PICKS:] if len(gain) > PICKS else np.arange(len(gain))
        top = top[np.abs(step[top]) > SETTLED]
        if not len(top):
            break
        used, picked = bytearray(size + 1), []
        for j, shape in zip(top[np.argsort(-gain[top])].tolist(), shapes[top[np.argsort(-gain[top])]].tolist(), strict=True):
            if not (used[shape[0]] or used[shape[1]] or (shape[2] and used[shape[2]])):
                picked.append(j)
                for s in shape:
                    used[s] = 1
        x[picked] += step[picked]
        np.subtract.at(left, shapes[picked].ravel(), np.repeat(step[picked], 3))
        left[0] = 0
    return x


Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: np.ndarray, size: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, of so many pieces of each length: ``(((length, copies), ...), sequences)``."""
    spaces: dict[int, list[tuple[Pattern, int]]] = {}
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            space = min((s for s in spaces if s >= length), default=None)
            pattern, bins = spaces[space].pop() if space is not None else ((), left)
            if space is None:
                space = size
            elif not spaces[space]:
                del spaces[space]
            copies = space // length
            full = min(bins, left // copies)
            rest = left - full * copies if full < bins else 0
            for n, m in ((full, copies), (min(1, rest), rest)):
                if n:
                    spaces.setdefault(space - m * length, []).append(((*pattern, (length, m)), n))
            left -= full * copies + rest
            unused = bins - full - min(1, rest)
            if pattern and unused:
                spaces.setdefault(space, []).append((pattern, unused))
    return [group for groups in spaces.values() for group in groups]


def plan(histogram: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences take each, for a histogram whose last entry is the length of a sequence."""
    size, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    out = [(((size, 1),), int(left[size]))] if left[size] else []
    left[size] = left[0] = 0
    lengths = np.flatnonzero(left)
    shapes = patterns(lengths[lengths >= size * FILLER], size)
    x = fit(left, shapes)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        shape = [(int(s), int((shapes[j] == s).sum())) for s in np.unique(shapes[j])[::-1] if s]
        n = min(int(x[j] + 0.5), *(int(left[s]) // m for s, m in shape))
        if n:
            out.append((tuple(shape), n))
            for s, m in shape:
                left[s] -= n * m
    return out + best_fit(left, size)


def _segments(planned: list[tuple[Pattern, int]], size: int) -> tuple[np.ndarray, ...]:
    """By length and first place: key, first sequence and offset of runs of places."""
    taken, first, rows = np.zeros(size + 1, dtype=np.int64), 0, []
    for pattern, n in planned:
        at = 0
        for length, copies in pattern:
            for _ in range(copies):
                rows.append((length, taken[length], first, at))
                taken[length] += n
                at += length
        first += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(df: DataFrame, path: str, size: int = 2048, separator: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The columns of ``pieces`` with ``sequence_id`` and ``offset``; what a sequence holds lies there without gaps from 0."""
    cut = checkpoint(pieces(df, path, size, separator, text, key, with_ids).withColumn("_row", F.monotonically_increasing_id()))
    found = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    histogram = np.array([found.get(i, 0) for i in range(size + 1)], dtype=np.int64)
    keys, starts, sequences, offsets = _segments(plan(histogram), size)
    shared = df.sparkSession.sparkContext.broadcast((keys, starts, sequences, offsets))

    salts = F.array(*[F.lit(int(n)) for n in -(-histogram // GROUP_ROWS)])
    salted = cut.withColumn("_salt", F.when(salts[F.col("length").cast("int")] > 1, F.pmod(F.xxhash64("_row"), salts[F.col("length").cast("int")])).otherwise(F.lit(0)))
    inside = salted.withColumn("_place", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_row")))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    groups = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = inside.join(groups, ["length", "_salt"]).withColumn("_place", F.col("_before") + F.col("_place") - 1)
    columns = [f for f in cut.columns if f != "_row"]
    schema = T.StructType([*(cut.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, sequences, offsets = shared.value
        for batch in batches:
            length, place = (batch.column(i).to_numpy() for i in (at, len(columns)))
            segment = np.searchsorted(keys, (length << 48) + place, "right") - 1
            more = [pa.array(sequences[segment] + place - starts[segment]), pa.array(offsets[segment])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return placed.select(*columns, "_place").mapInArrow(tidy(run), schema)
