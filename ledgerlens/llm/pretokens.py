"""Words of many texts at once: the cuts of the public byte-level pattern, and which words are the same, with numpy."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import regex

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
LETTER, NUMBER, OTHER, SPACE, EDGE, ODD = range(6)
#: Blocks of characters whose class (letter, number, white space, other) the Unicode versions of today's libraries agree on.
STEADY = ((0x0, 0x557), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF))


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point; those outside STEADY are odd."""
    table = np.full(0x110000, ODD, dtype=np.uint8)
    for low, high in STEADY:
        text = "".join(map(chr, range(low, high + 1)))
        table[low : high + 1] = OTHER
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run in regex.finditer(pattern, text):
                table[low + run.start() : low + run.end()] = kind
    return table


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(1 << bits, base, dtype=U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's symbols and length, equal wherever they stand."""
    up, down = _powers(max(16, int(len(symbols)).bit_length()))
    sums = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum((symbols.astype(U) + U(1)) * up[: len(symbols)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def distinct_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(number, first)``: a number for each span, the same for the same symbols, and one span of each number.

    Spans are told apart by a hash; then each is compared, symbol by symbol, with the one that stands for it.
    """
    hashes = span_hashes(symbols, starts, ends) if hashes is None else hashes
    number, found = pd.factorize(hashes)
    first = np.empty(len(found), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    lens, like = ends - starts, first[number]
    same = bool((lens == lens[like]).all())
    if same and len(lens):
        inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        same = bool((symbols[np.repeat(starts, lens) + inside] == symbols[np.repeat(starts[like], lens) + inside]).all())
    if not same:  # two words of one hash: told apart by what they are
        number, found = pd.factorize(np.array([symbols[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], dtype=object))
        first = np.empty(len(found), dtype=np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, first


def cut_words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(joined, code_points, starts, ends, text, odd)``: the places of all words in the joined texts, the text that each is
    of, and which texts hold characters outside STEADY (their words are not to be used).

    The cuts are those of ``public_tokenizers.PATTERN``: contractions, letters, numbers, others (each with one blank before
    it), and white space, of which the last character before a word stands apart or is that blank.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edges = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    kind = _classes()[points]
    kind[edges] = EDGE
    start = np.ones(len(points), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[edges] = True
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != EDGE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(start & (points == 0x27))
    one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))
    real = kind[starts] != EDGE
    starts, ends = starts[real], ends[real]
    odd = np.zeros(len(texts), dtype=bool)
    odd[np.searchsorted(edges, np.flatnonzero(kind == ODD))] = True
    return joined, points, starts, ends, np.searchsorted(edges, starts), odd


#: A place where a text can be parted so that both parts have the words of the whole: before white space.
PART = regex.compile(r"(?<=\S)\s")


def parts(text: str, size: int) -> list[str]:
    """The text in parts of about ``size`` characters that have the words of the whole."""
    out, at = [], 0
    while len(text) - at > size and (cut := PART.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]
