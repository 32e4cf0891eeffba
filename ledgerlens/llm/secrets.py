"""Secret scanning by patterns and sliding-window entropy, in SQL functions only.

Matches come from ``regexp_extract_all`` anchored at the end of the match before, so that each part is the text skipped
and then the match; lengths added up give code-point offsets. What base spans leave of a text, between them, is looked
through for candidate strings. Parts of a candidate that are on the allow-list (UUIDs, dates, placeholders) are taken
out of it, and what is left is scanned by a window, unless it is a path or slug of plain words: counts of the window's
symbols are carried from one place to the next, of which the one that enters and the one that leaves change, and with
them the sum of ``n * log2(n)``. The largest entropy is held against the threshold of the string's character class.

All folds keep small states or go in chunks, so that texts of a megabyte, as one candidate or with a hundred thousand
spans, take seconds. Rows never leave their task.

Null and empty texts have no spans. Spans of repeated rows are repeated. Very long texts are scanned whole. Only the
text is read and only the column of spans is put in; a column of that name is replaced, all others stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. Kinds in the order in which spans that start together are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_VALUE = 12
#: Candidates for the entropy scan are runs of this many characters or more; symbols of a window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Bits a symbol that the best window must reach, by class of the whole string (tried in this order).
CLASSES = (("hexadecimal", r"^[0-9A-Fa-f]+$", 3.0), ("lower or upper with digits", r"^([a-z0-9]+|[A-Z0-9]+)$", 3.4), ("mixed letters and digits", r"^[A-Za-z0-9]+$", 3.6), ("base64 and separators", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Allow-list: between separators, words with one of these in them, and UUIDs and dates with or without a time.
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)"
ALLOWED = (
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[0-9]{4}[-/_][0-9]{2}[-/_][0-9]{2}(T[0-9]{2}([-_]?[0-9]{2}){0,2}Z?)?(?![A-Za-z0-9])",
)
#: A word of a path or slug.
PLAIN = r"^([A-Za-z]{2,}|[0-9]{1,4})?$"
#: Items of a chunk of a running fold; code points of a block of text.
CHUNK, BLOCK = 256, 4096
SPAN = "start: INT, kind: INT, `end`: INT"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, add: Callable[[Column, Column], Column]) -> Column:
    """``before`` and ``last`` of a fold of integers from 0: its states before each item, and the final one.

    Each chunk appends to a short array of its own, so that the copies grow with the chunk's size and not with the number of items.
    """
    none = F.array().cast("array<int>")

    def within(acc: Column, item: Column) -> Column:
        return F.struct(add(acc["state"], item).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before"))

    def chunk(items: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0)))
        start = F.struct(F.struct(F.lit(0).alias("state"), none.alias("before")).alias("own"), F.array().cast("array<array<int>>").alias("done"))

        def add_chunk(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), F.struct(acc["own"]["state"].alias("state"), none.alias("before")), within)
            return F.struct(own.alias("own"), F.concat(acc["done"], F.array(acc["own"]["before"])).alias("done"))

        return F.aggregate(places, start, add_chunk, lambda acc: F.struct(F.flatten(F.concat(acc["done"], F.array(acc["own"]["before"]))).alias("before"), acc["own"]["state"].alias("last")))

    return let(items, chunk)


def located(text: Column, pattern: str, kind: int, offset: Column | int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans ``(start, kind, end, match)`` of the pattern's matches, of those whose part of the text ``keep`` accepts."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))

    def span(part: Column, before: Column) -> Column:
        match = F.regexp_extract(part, pattern, 0)
        end = offset + before + F.length(part)
        return let(match, lambda m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("match")))

    def spans(parts: Column) -> Column:
        return let(running(parts, lambda at, part: at + F.length(part)), lambda r: F.zip_with(parts, r["before"], span))

    found = let(parts, lambda p: F.when(F.size(p) > 0, spans(p)).otherwise(F.array().cast(f"array<struct<{SPAN}, match: STRING>>")))
    return F.filter(found, lambda s: keep(s["match"])) if keep else found


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(body: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    none = F.array().cast(f"array<struct<{SPAN}>>")
    assign = plain(located(body, ASSIGN, 0, keep=lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE))
    access = F.when(F.contains(body, F.lit("AKIA")), plain(located(body, ACCESS, 1))).otherwise(none)
    return F.array_sort(F.concat(assign, access, plain(located(body, HEX, 2))))


def blocks_of(body: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a piece in its middle is not looked for from its start."""
    return F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from ``a`` to before ``b``."""
    first = F.floor(a / BLOCK).cast("int")
    last = F.floor(F.greatest(a, b - 1) / BLOCK).cast("int")
    return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a % BLOCK + 1, b - a)


def gaps(spans: Column, size: Column) -> Column:
    """``(from, to)`` between the runs of overlapping spans, from sorted spans: before each run, and after the last."""

    def between(r: Column, spans: Column) -> Column:
        each = F.zip_with(spans, r["before"], lambda s, b: F.struct(b.alias("from"), s["start"].alias("to")))
        return F.concat(F.filter(each, lambda g: g["to"] >= g["from"]), F.array(F.struct(r["last"].alias("from"), size.alias("to"))))

    return let(spans, lambda s: let(running(s, lambda at, x: F.greatest(at, x["end"])), lambda r: between(r, s)))


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a symbol, of the windows of ``width`` symbols of an ASCII string; of shorter values their own.

    The counts are a string of bytes, one for each symbol, in which two change at a step.
    """
    base = 65  # how often a symbol is in the window, as a character from A on
    weight = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(width + 1)])
    code = lambda b: F.ascii(b.cast("string"))
    w = lambda n: F.element_at(weight, n + 1)

    def scan(bytes_: Column) -> Column:
        n = F.octet_length(bytes_)
        size = F.least(n, F.lit(width))
        held = lambda counts, symbol: code(F.substring(counts, symbol + 1, F.lit(1))) - base
        put = lambda counts, symbol, k: F.overlay(counts, F.char(k + base).cast("binary"), symbol + 1, F.lit(1))

        def enter(state: Column, symbol: Column) -> Column:
            return let(held(state["counts"], symbol), lambda k: F.struct(put(state["counts"], symbol, k + 1).alias("counts"), (state["total"] - w(k) + w(k + 1)).alias("total"), state["least"].alias("least")))

        def leave(state: Column, symbol: Column) -> Column:
            return let(held(state["counts"], symbol), lambda k: F.struct(put(state["counts"], symbol, k - 1).alias("counts"), (state["total"] - w(k) + w(k - 1)).alias("total"), state["least"].alias("least")))

        def slide(state: Column, i: Column) -> Column:
            into, out = code(F.substring(bytes_, i, F.lit(1))), code(F.substring(bytes_, i - width, F.lit(1)))
            moved = F.when(i <= width, enter(state, into)).when(into == out, state).otherwise(let(leave(state, out), lambda s: enter(s, into)))
            return let(moved, lambda s: F.struct(s["counts"].alias("counts"), s["total"].alias("total"), F.when(i >= size, F.least(s["least"], s["total"])).otherwise(s["least"]).alias("least")))

        start = F.struct(F.lit("A" * 128).cast("binary").alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
        least = F.aggregate(F.sequence(F.lit(1), n), start, slide, lambda s: s["least"])
        return F.when(n > 0, F.log2(size) - least / size).otherwise(F.lit(0.0))

    return let(value.cast("binary"), scan)


def remains(value: Column) -> Column:
    """What is left of a candidate without the allow-listed parts: strings long enough to be scanned that aren't plain words."""
    words = F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+|[+/_=-]+"), F.lit(0))
    kept = F.array_join(F.transform(words, lambda x: F.when(x.rlike(PLACEHOLDER), "\n").otherwise(x)), "")
    kept = reduce(lambda v, p: F.regexp_replace(v, p, "\n"), ALLOWED, kept)
    slug = lambda v: F.forall(F.split(v, "[+/_=-]+"), lambda x: x.rlike(PLAIN))
    return F.filter(F.split(kept, "\n"), lambda v: (F.length(v) >= WINDOW) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~slug(v))


def is_secret(value: Column) -> Column:
    """Whether what the allow-list leaves of a candidate is random enough for its class."""
    need = lambda v: reduce(lambda e, c: e.when(v.rlike(c[1]), F.lit(c[2])), CLASSES[1:], F.when(v.rlike(CLASSES[0][1]), F.lit(CLASSES[0][2])))
    return F.exists(remains(value), lambda v: window_entropy(v) >= need(v))


def all_spans(body: Column) -> Column:
    """Base spans and those of the entropy scan, by start and then kind."""
    long_enough = lambda g: g["to"] - g["from"] >= WINDOW

    def extra(base: Column, blocks: Column) -> Column:
        found = F.transform(F.filter(gaps(base, F.length(body)), long_enough), lambda g: plain(located(piece(blocks, g["from"], g["to"]), CANDIDATE, 3, g["from"], is_secret)))
        return F.array_sort(F.concat(base, F.flatten(found)))

    return let(base_spans(body), lambda base: let(blocks_of(body), lambda blocks: extra(base, blocks)))


def scan(df: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``df`` with an array of ``(start, kind, end)``, by start and then kind; offsets are code points, ends exclusive."""
    return df.withColumn(out, all_spans(F.coalesce(F.col(text), F.lit(""))))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[secret]") -> DataFrame:
    """``df`` with the spans' characters replaced by ``mark`` once for each run of overlapping spans; null texts stay null."""
    body = F.col(text)
    kept = let(blocks_of(body), lambda blocks: F.array_join(F.transform(gaps(F.col(spans), F.length(body)), lambda g: piece(blocks, g["from"], g["to"])), mark))
    return df.withColumn(text, F.when(F.size(spans) > 0, kept).otherwise(body))


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: counts of base kinds, digest of the base spans, and all spans."""
    got = scan(df.select(key, "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return got.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))
