import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import decontam, queries


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def brute(docs, items):
    """All offsets of all items over all documents that share a word; every run by all start and end places."""
    found = {}
    split = [(doc, words(body)) for doc, body in docs]
    for item, text in items:
        iw = words(text)
        if item is None or not iw:
            continue
        if len(iw) < decontam.SHORTEST:
            found |= {(doc, item): len(iw) for doc, dw in split if dw == iw}
            continue
        asked = min(decontam.MATCHES, -(-len(iw) * 4 // 5))
        for doc, dw in split:
            places = {}
            for p, w in enumerate(dw):
                places.setdefault(w, []).append(p)
            shared = Counter(p - i for i, w in enumerate(iw) for p in places.get(w, []))
            for off in [o for o, n in shared.items() if n >= asked]:
                a, b = max(0, -off), min(len(iw), len(dw) - off)
                hit = [iw[i] == dw[i + off] for i in range(a, b)]
                best, run, widest = 0, (0, 0, 0), 0
                for s in range(len(hit)):
                    score = n = 0
                    for e in range(s, len(hit)):
                        score += 1 if hit[e] else -decontam.PENALTY
                        n += hit[e]
                        if score > best:
                            best, run = score, (s, e + 1, n)
                        if 5 * n >= 4 * (e + 1 - s):
                            widest = max(widest, n)
                n = run[2] if run[2] >= asked and 5 * run[2] >= 4 * (run[1] - run[0]) else widest
                if n >= asked:
                    found[doc, item] = max(found.get((doc, item), 0), n)
    return found


def test_small_table_against_every_offset(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.op3_decontam(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id): r.n_matches for r in got} == brute(docs, items)
    for r in got:
        assert r.end - r.start == r.n_words and 0 <= r.start


def test_replaced_words_parts_and_edges(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((40, 30, 16, 9, 6, 5))]
    items += [(10, None), (11, ""), (12, "too short"), (13, items[0][1]), (None, items[1][1])]
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, noise(50) + ". " + text.upper().replace(" ", ", ") + "%%% " + noise(30)) for i, text in items[:6]]
    for k, n in ((100, 5), (101, 6), (102, 7)):  # each n-th word replaced
        docs.append((k, noise(20) + " " + " ".join(w if (j + 1) % n else "zz" for j, w in enumerate(items[0][1].split())) + " " + noise(9)))
    docs += [(103, " ".join(items[1][1].split()[8:23])), (104, " ".join(items[1][1].split()[:8])), (105, noise(500)), (106, None), (107, ""), (108, "..."), (109, noise(60_000) + " " + items[2][1]), (110, "TOO, short!"), (111, "not too short")]
    df = spark.createDataFrame([*docs, docs[0], (None, items[0][1])], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("item", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(3))
    got = {(r.doc_id, r.item_id): r.n_matches for r in decontam.contaminated(df, bench).collect()}
    assert got == brute(docs, items)
    assert {d for d, _ in got} >= {0, 1, 2, 3, 4, 5, 100, 101, 102, 103, 109, 110} and not {d for d, _ in got} & {104, 105, 106, 107, 108, 111}
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = queries.op3_decontam(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_any_qualifying_run_and_short_items_alone(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(9000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    long_ = some(164)
    replaced = [w if i < 14 or i % 25 not in (1, 4, 8, 11, 15, 18, 22) else "zz" for i, w in enumerate(long_)]  # 72 % alike after 14 words
    docs, items = [(1, some(20) + replaced + some(20))], [(1, long_)]
    for n in (5, 6, 7, 8, 9):
        items.append((n * 10, some(n)))
        docs += [(n * 100 + k, some(15) + [w if i != k else "zz" for i, w in enumerate(items[-1][1])] + some(15)) for k in range(n)]
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    got = decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in docs}
    assert all(r.n_matches >= 0.8 * r.n_words and r.n_words == r.end - r.start for r in got)
    alone = decontam.contaminated(frame(docs, "doc_id"), frame([items[4]], "item_id")).collect()
    assert {r.doc_id for r in alone} == {d for d, _ in docs if 800 <= d < 900}
