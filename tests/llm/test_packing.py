import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import packing, pretokens, queries
from ledgerlens.session import table

PATH = queries.PACKING_TOKENIZER
FIELDS = "doc_id bigint, text string"


def brute(rows, size):
    """Pieces of every row, by the tokenizer alone."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for key, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % size or size
        cuts = [0, len(ids)] if len(ids) <= size else [0, *range(head, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out.append((-1 if key is None else key, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out)


def check(rows, result, size):
    """Pieces as by brute force, every sequence without gaps and within size; the number of sequences."""
    got = result.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(rows, size)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    return len(held), sum(r.length for r in got)


def test_words_are_cut_as_by_the_pattern():
    cut, rnd = regex.compile(public_tokenizers.PATTERN).findall, random.Random(5)
    signs = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "1", "22", "!", "...", "é", "中", " ", "\x1c", "r", "v", "l", "e", "\0"]
    for _ in range(100):
        texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(40)]
        joined, points, starts, ends, of, odd = pretokens.cut_words(texts)
        found = [[] for _ in texts]
        for a, b, k in zip(starts, ends, of, strict=True):
            found[k].append(joined[a:b])
        assert found == [cut(t) for t in texts] and not odd.any()
        number, first = pretokens.distinct_spans(points, starts, ends)
        words = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
        assert [words[first[n]] for n in number] == words and len(set(words)) == len(first)
        whole = " ".join(texts)
        assert sum(map(cut, pretokens.parts(whole, 50)), []) == cut(whole)


def test_words_of_one_hash_are_told_apart():
    points = np.frombuffer(b"abcabd", dtype=np.uint8)
    number, first = pretokens.distinct_spans(points, np.array([0, 3, 0]), np.array([3, 6, 3]), np.array([7, 7, 7], dtype=np.uint64))
    assert number.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_small_cases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BLOCK", 300)
    rnd = random.Random(3)
    words = ["alpha", "Größe", "<|endoftext|>", "ﬆrange", "\U000323b5", "x" * 90, "don't", "42", "\n\n", "  ", "tail "]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (None, "no id"), (7, "again"), (7, "again")] + [(600 + i, "the same copy") for i in range(200)]
    df = spark.createDataFrame(rows, FIELDS).withColumn("piece", F.lit("clash")).withColumn("offset", F.lit(1)).withColumn("_row", F.lit(2))
    n, tokens = check(rows, packing.pack(df, PATH, size=64), 64)
    assert n <= 1.02 * tokens / 64 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], FIELDS), PATH).collect() == []


def test_ids_come_with_the_pieces(spark):
    rows = [(1, "some words " * 50), (2, "few")]
    for r in packing.pack(spark.createDataFrame(rows, FIELDS), PATH, size=32, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32


def test_hot_length_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    rows = [(i, "copy") for i in range(1000)] + [(i + 1000, "w " * (i % 40)) for i in range(200)]
    n, tokens = check(rows, packing.pack(spark.createDataFrame(rows, FIELDS), PATH, size=48), 48)
    assert n <= 1.02 * tokens / 48 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_fits(seed):
    rnd = np.random.default_rng(seed)
    size = 256
    histogram = np.bincount(np.minimum(rnd.lognormal(4, 1, 20_000).astype(int) + 1, size), minlength=size + 1)
    used, n = np.zeros(size + 1, dtype=int), 0
    for pattern, times in packing.plan(histogram):
        assert sum(a * b for a, b in pattern) <= size and times > 0
        n += times
        for length, copies in pattern:
            used[length] += copies * times
    assert (used == histogram).all()
    left = histogram.copy()
    left[size] = 0
    assert n <= histogram[size] + sum(k for _, k in packing.best_fit(left, size))
    assert n <= 1.005 * (np.arange(size + 1) * histogram).sum() / size + 1


def test_fit_leaves_no_gain(monkeypatch):
    monkeypatch.setattr(packing, "SETTLED", 1e-6)
    monkeypatch.setattr(packing, "ROUNDS", 5000)
    histogram = np.zeros(33, dtype=int)
    histogram[[8, 10, 12, 20, 22, 24]] = [30, 7, 50, 9, 11, 13]
    shapes = packing.patterns(np.flatnonzero(histogram), 32)
    x = packing.fit(histogram, shapes)
    use = np.zeros((33, len(shapes)))
    for j, shape in enumerate(shapes):
        for s in shape[shape > 0]:
            use[s, j] += 1
    slope = use.T @ (np.arange(33) / 32 * (histogram - use @ x))
    assert (x >= 0).all() and slope.max() < 1e-3 and np.abs(slope[x > 1e-9]).max() < 1e-3


def test_query_on_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    n, tokens = check(rows, queries.op13_packing(spark, sf_dir), 2048)
    assert n <= 1.02 * tokens / 2048 + 1


def test_places_take_one_shuffle_of_the_pieces(spark, sf_dir):
    plan = queries.op13_packing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("row_number()") == 1
