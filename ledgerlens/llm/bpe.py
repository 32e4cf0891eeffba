"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Texts are cut into words by the tokenizer's pattern. Each task keeps the distinct words it has met in a bounded memo;
new words go to DuckDB in blocks. There a recursive query holds one row per token position: it joins neighbouring
tokens with the merge table, contracts every word's leftmost pair of least rank, and repeats until no pair is left.
Decoding joins ids with the vocabulary and concatenates the bytes by an ordered aggregation. No row leaves its task, so
there is no shuffle and a lost task is simply run again.

Null texts count as empty; empty texts give no ids and the digests of the empty string. Repeated rows give repeated
results. An id that the vocabulary lacks raises an error on decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.hashing import tidy

#: Bytes of text that are cut into words at once; words that a task remembers; words in one DuckDB block.
TEXT_BLOCK, MEMO_WORDS, WORD_BLOCK = 1_500_000, 80_000, 40_000
#: Words of more characters are long.
LONG_WORD = 200

ENCODE = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE step(pos, word, tok, live) AS (
  SELECT pos, word, tok, true FROM symbols
  UNION ALL
  (WITH pairs AS (
     SELECT s.pos, s.word, s.tok, m.merged
     FROM (SELECT pos, word, tok, CASE WHEN lead(word) OVER o = word THEN lead(tok) OVER o END AS next_tok
           FROM step WHERE live WINDOW o AS (ORDER BY pos)) s
     LEFT JOIN merges m ON m.lhs = s.tok AND m.rhs = s.next_tok),
   best AS (
     SELECT word, min(merged::BIGINT * 4294967296 + pos) AS k FROM pairs WHERE merged IS NOT NULL GROUP BY word),
   marked AS (
     SELECT p.pos, p.word, b.word IS NOT NULL AS live, coalesce((b.k & 4294967295) = p.pos, false) AS hit,
            CASE WHEN (b.k & 4294967295) = p.pos THEN p.merged ELSE p.tok END AS tok
     FROM pairs p LEFT JOIN best b ON p.word = b.word)
   SELECT pos, word, tok, live FROM (SELECT *, lag(hit, 1, false) OVER (ORDER BY pos) AS gone FROM marked) WHERE NOT gone)
)
SELECT word, pos, tok FROM step WHERE NOT live
"""
#: The same for long words: one round contracts all pairs of a word's least rank, leftmost first and not overlapping, up to
#: and including the first one whose contraction makes a pair of lesser rank. Up to there the order is that of one at a time.
ENCODE_LONG = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE step(pos, word, tok, live) AS (
  SELECT pos, word, tok, true FROM symbols
  UNION ALL
  (WITH around AS (
     SELECT pos, word, tok, row_number() OVER o AS place, lag(tok) OVER o AS before, lead(tok) OVER o AS next_tok, lead(tok, 2) OVER o AS after
     FROM step WHERE live WINDOW o AS (PARTITION BY word ORDER BY pos)),
   pairs AS (SELECT a.*, m.merged FROM around a LEFT JOIN merges m ON m.lhs = a.tok AND m.rhs = a.next_tok),
   best AS (SELECT word, min(merged) AS merged FROM pairs WHERE merged IS NOT NULL GROUP BY word),
   runs AS (
     SELECT p.word, p.pos, p.merged, p.before, p.after, p.place - row_number() OVER (PARTITION BY p.word ORDER BY p.pos) AS run
     FROM pairs p JOIN best b ON p.word = b.word AND p.merged = b.merged),
   apart AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1 AS takes FROM runs),
   risks AS (
     SELECT a.word, a.pos, least(l.merged, r.merged, t.merged) < a.merged AS risky
     FROM apart a LEFT JOIN merges l ON l.lhs = a.before AND l.rhs = a.merged
     LEFT JOIN merges r ON r.lhs = a.merged AND r.rhs = a.after LEFT JOIN merges t ON t.lhs = a.merged AND t.rhs = a.merged
     WHERE a.takes),
   stops AS (SELECT word, min(pos) FILTER (risky) AS stop FROM risks GROUP BY word),
   hits AS (SELECT r.word, r.pos FROM risks r JOIN stops s ON r.word = s.word AND (s.stop IS NULL OR r.pos <= s.stop)),
   marked AS (
     SELECT p.pos, p.word, b.word IS NOT NULL AS live, h.pos IS NOT NULL AS hit, CASE WHEN h.pos IS NULL THEN p.tok ELSE p.merged END AS tok
     FROM pairs p LEFT JOIN best b ON p.word = b.word LEFT JOIN hits h ON h.word = p.word AND h.pos = p.pos)
   SELECT pos, word, tok, live FROM (SELECT *, lag(hit, 1, false) OVER (ORDER BY pos) AS gone FROM marked) WHERE NOT gone)
)
SELECT word, pos, tok FROM step WHERE NOT live
"""
IDS = "SELECT word, count(*) AS n, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids FROM encoded GROUP BY word ORDER BY word"
DECODE = """
SELECT e.word, string_agg(v.hex, '' ORDER BY e.pos) AS hex, count(*) FILTER (v.hex IS NULL) AS unknown
FROM {rows} e LEFT JOIN vocabulary v ON v.tok = e.tok GROUP BY e.word ORDER BY e.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """One task's vocabulary in DuckDB and its memo of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_words: int = MEMO_WORDS, word_block: int = WORD_BLOCK):
        self.memo_words, self.word_block = memo_words, word_block
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        lhs, rhs, merged = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})  # in memory, nothing spills to the task's disk
        self.db.register("merges_in", pa.table({"lhs": lhs, "rhs": rhs, "merged": merged}))
        self.db.register("vocabulary_in", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS FROM merges_in; CREATE TABLE vocabulary AS FROM vocabulary_in")
        self.db.unregister("merges_in")
        self.db.unregister("vocabulary_in")
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def symbols(self, words: list[bytes]) -> pa.Table:
        """Token positions to start from: the bytes, or the one token that a whole word is."""
        toks = [[r] if (r := self.ranks.get(w)) is not None else self.byte[np.frombuffer(w, np.uint8)] for w in words]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(t) for t in toks])
        return pa.table({"pos": np.arange(len(word), dtype=np.int32), "word": word, "tok": np.concatenate(toks).astype(np.int32)})

    def solve(self, words: list[str], rounds: str = ENCODE) -> list[tuple[str, int, bytes]]:
        """Ids joined by commas, number of ids, and the bytes that those ids decode to, per word."""
        self.db.register("symbols", self.symbols([w.encode() for w in words]))
        self.db.execute(rounds)
        self.db.unregister("symbols")
        ids, back = self.db.execute(IDS).fetchall(), self.db.execute(DECODE.format(rows="encoded")).fetchall()
        return [(i[2], i[1], bytes.fromhex(h[1])) for i, h in zip(ids, back, strict=True)]

    def learn(self, words: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """A memo that holds at least these words."""
        if len(self.young) > self.memo_words:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for w in words:
            if w not in young:
                if (hit := old.get(w)) is not None:
                    young[w] = hit
                else:
                    new.append(w)
        short = [w for w in new if len(w) <= LONG_WORD]
        for i in range(0, len(short), self.word_block):
            block = short[i : i + self.word_block]
            young.update(zip(block, self.solve(block), strict=True))
        for w in new:
            if len(w) > LONG_WORD:
                young[w] = self.solve([w], ENCODE_LONG)[0]
        return young

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        lens = [len(r) for r in rows]
        flat = np.array([t for r in rows for t in r], dtype=np.int64)
        self.db.register("given", pa.table({"pos": np.arange(len(flat)), "word": np.repeat(np.arange(len(rows)), lens), "tok": flat}))
        out = [b""] * len(rows)
        for word, text, unknown in self.db.execute(DECODE.format(rows="given")).fetchall():
            if unknown:
                raise ValueError(f"{unknown} ids are not in the vocabulary")
            out[word] = bytes.fromhex(text)
        return out


_codecs: dict[bytes, Codec] = {}


def _codec(key: bytes, shared, pattern: str, *sizes: int) -> Codec:
    """This worker's codec; a worker serves one vocabulary at a time."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern, *sizes)
    return _codecs[key]


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size > TEXT_BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False, memo_words: int = MEMO_WORDS, word_block: int = WORD_BLOCK) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every text, and the ids themselves if asked for.

    ``path`` is the vocabulary, read on the driver and broadcast (its size is that of the tokenizer, not of the data).
    Smaller ``memo_words`` and ``word_block`` take less memory and more time; the result is the same.
    """
    spark = df.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)
    mark = hashlib.sha256(repr((sorted(ranks.values()), pattern, memo_words, word_block)).encode() + b"".join(ranks)).digest()
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(mark, shared, pattern, memo_words, word_block)
        for batch in batches:
            for a, b in _blocks(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                words = [codec.cut(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                memo = codec.learn(set().union(*words))
                cols: list[list] = [[], [], [], []]
                for own in words:
                    got = [memo[w] for w in own]
                    ids = ",".join([g[0] for g in got])
                    cols[0].append(sum([g[1] for g in got]))
                    cols[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    cols[2].append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
                    if with_ids:
                        cols[3].append(np.array(ids.split(",") if ids else [], dtype=np.int32))
                arrays = [batch.column(0).slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                if with_ids:
                    arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(tidy(run), T.StructType(fields))


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key, decoded`` (binary) of every row of ids; null or no ids decode to no bytes."""
    ranks = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    mark = hashlib.sha256(repr(sorted(ranks.items())).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(mark, shared, r"\s+")
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                got = codec.decode([r or [] for r in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(tidy(run), T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("decoded", T.BinaryType())]))
