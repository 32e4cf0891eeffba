import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import phrases, transducers
from ledgerlens.llm.transducers import Transducer, build, compose, union
from ledgerlens.llm.transducers import phrases as listed

FIELDS = "text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < cover * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def texts(seed, n, words):
    rnd = random.Random(seed)
    return [("".join(w + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", " . "]) for w in rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["en", "de", None])) for _ in range(n)]


WORDS = ["New", "york", "city", "HALL", "of", "the", "Größe", "ÄÖ", "東京", "it's", "a-b", " ", "x" * 50]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BLOCK", 200)
    rows = texts(1, 300, WORDS) + [("new york city " * 200, "en"), (None, "en"), ("", None), (" ,;. ", "fr"), ("one", "und")] + [("the same text again", "es")] * 5
    df = spark.createDataFrame(rows, FIELDS).withColumns({"rank": F.lit(1), "phrase": F.lit("clash"), "hash": F.lit(2)})
    for least, top in ((2, 2000), (5, 7)):
        assert got(df, least=least, top=top) == brute(rows, least, top=top)


def test_many_shards_and_full_masks(spark, monkeypatch):
    """Counts don't hang on where tasks send on, how often transducers are united, or on bits of the masks."""
    for name, value in (("HASHES_HELD", 10), ("PHRASES_HELD", 50), ("FAN_IN", 2), ("RANGE_PHRASES", 20), ("MASK_BITS", 7)):
        monkeypatch.setattr(phrases, name, value)
    rows = texts(2, 200, WORDS)
    assert got(spark.createDataFrame(rows, FIELDS).repartition(7), least=3) == brute(rows, 3)


def test_long_pieces_in_parts_count_once(monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BLOCK", 30)
    for text in (b"ab " * 200, b"a" * 500 + b" b c d " + b"e" * 100 + b" f", b"x, y " * 50, b"w" * 90):
        words = [p.split() for p in re.split(rb"[.,;:!?\n-\r]", text)]
        want = sum(max(0, len(w) - 2) for w in words)
        parts = list(phrases._parts(text, 3))
        assert sum(int(phrases.Block([(p, "en", o)]).phrases(3)[1].sum()) for p, o in parts) == want
        assert sum(int(phrases.Block([(p, "en", o)]).fresh.sum()) for p, o in parts) == len([x for w in words for x in w])


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en")]])
def test_nothing_to_count(spark, rows):
    assert got(spark.createDataFrame(rows, FIELDS)) == []


def test_exact_beyond_64_bits(spark):
    a, l, r = 10**16, 10**16 + 3, 10**17
    row = spark.sql(f"SELECT CAST(2000000 AS DECIMAL(7,0)) * CAST({a}L AS DECIMAL(19,0)) div (CAST({l}L AS DECIMAL(19,0)) + CAST({r}L AS DECIMAL(19,0))) AS s").first()
    assert row.s == 2000000 * a // (l + r)


def counts(seed, n):
    rnd = random.Random(seed)
    return {tuple(rnd.choices("abcde", k=rnd.randint(1, 4))): rnd.randint(1, 5) for _ in range(n)}


def test_transducers_keep_counts_and_are_minimal():
    for seed in range(20):
        found = counts(seed, 120)
        made = build(iter(sorted(found.items())))
        assert list(listed(made)) == sorted(found.items())
        assert dict(listed(Transducer.of(made.columns()))) == found
        assert union([made]).states == made.states
        assert len(set(made.states)) == len(made.states)
        for final, arcs in made.states[:-1]:  # weights stand as near to the root as they can
            assert min([w for _, w, _ in arcs] + ([] if final is None else [final])) == 0
    alike = build(iter([(("a", "x"), 3), (("a", "y"), 5), (("b", "x"), 10), (("b", "y"), 12)]))
    assert len(alike.states) == 3  # both first words lead to the same state


def test_union_sums_and_composition_looks_up():
    a, b, c = counts(1, 80), counts(2, 80), counts(3, 1)
    total = Counter(a) + Counter(b) + Counter(c)
    made = [build(iter(sorted(x.items()))) for x in (a, b, c, {})]
    assert list(listed(union(made))) == sorted(total.items())
    assert list(listed(union(made, least=6))) == sorted((p, n) for p, n in total.items() if n >= 6)
    assert union(made).states == build(iter(sorted(total.items()))).states
    asked = build((p, 0) for p in sorted({*list(a)[:30], ("z",), ("a", "z")}))
    assert dict(compose(asked, union(made))) == {p: total[p] for p in list(a)[:30]}
    assert transducers.build(iter(())).states == [(None, ())]


def test_native_ranking_plan_has_no_single_task_window_before_the_salted_one(spark):
    rows = texts(4, 30, WORDS)
    plan = phrases.collocations(spark.createDataFrame(rows, FIELDS), least=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 2 and "_salt" in plan and "CartesianProduct" not in plan
