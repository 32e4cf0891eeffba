import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import html_extract as H
from ledgerlens.llm import queries


def expected(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    body = re.sub(r"<br>|</?(p|h1|h2|ul|li|div)[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", body)).split())


def extract(model, source):
    page = H.Page(source)
    return H.main_text(page, H.decode(page, H.log_odds(model, H.features(page, model["weights"]))))


@pytest.fixture(scope="module")
def sources(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(sources):
    return H.fit(sources[:80])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = queries.op7_main_text(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, expected(pages[r.page_id].html), len(r.text))


def test_other_layouts_held_out(sources, model):
    rng, kept, wrong, lost = random.Random(99), 0, 0, 0
    for s in sources[80:180]:
        page = H.Page(s)
        y = H.semantic_labels(page)
        made = H.Page(H.compose([t for b, t, _ in page.runs if y[b] == 1][: rng.randint(1, 12)], [t for b, t, _ in page.runs if y[b] == 0], rng))
        given, got = H.given_labels(made), H.decode(made, H.log_odds(model, H.features(made, model["weights"])))
        for b, t, _ in made.runs:
            kept += len(t) * (given[b] == 1 and got[b])
            wrong += len(t) * (given[b] != 1 and got[b])
            lost += len(t) * (given[b] == 1 and not got[b])
    assert kept / (kept + wrong) > 0.97 and kept / (kept + lost) > 0.97


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        page = H.Page("")
        page.parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        page.tag = ["#"] * n
        page.runs = [(i, "x" * int(rng.integers(1, 9)), 0) for i in range(n) if rng.random() < 0.8]
        odds = rng.standard_normal(n)
        size = np.zeros(n)
        for b, t, _ in page.runs:
            size[b] += len(t)
        best = max(sum((1 if k else -1) * o * s for k, o, s in zip(ks, odds, size)) for ks in itertools.product((0, 1), repeat=n) if all(not k or i == 0 or ks[page.parent[i]] for i, k in enumerate(ks)))
        kept = H.decode(page, odds)
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, n))
        assert abs(sum((1 if k else -1) * o * s for k, o, s in zip(kept, odds, size)) - best) < 1e-9


def test_broken_markup(model):
    p = H.Page("<p>one<p>two <b>bo</b>ld<br>line<div>three &amp; &nbsp; &#233;</p></div><script>var t='</p>';</script><ul><li>a<li>b</ul><!-- x > --><td>t < 3 <a href='>'>l</a>")
    assert [t for _, t, _ in p.runs] == ["one", "two bold line", "three & é", "a", "b", "t < 3 l"]
    for s in (None, "", " ", "<", "<div", "&&&;", "</div></p>", "<div>" * 5000 + "deep", "<!--", "<script>", "<a b='", "<p " + "a='" * 3000, "x" * 300_000):
        assert isinstance(extract(model, s), str)
    long = "".join(f"<p>Paragraph {i}, with some words of text.</p>" for i in range(5000))
    assert extract(model, f"<body><nav><a>x</a></nav><article>{long}</article></body>").count("Paragraph") == 5000


def test_rows_and_empty_tables(spark, sources, model):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", sources[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("source", F.lit(1))
    got = H.extract(df, model).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert H.extract(df.limit(0), model).count() == 0
    empty = H.train(df.where("html IS NULL"))
    assert [r.text for r in H.extract(df.where("page_id = 2"), empty).collect()] == [""]


def runs(source):
    return [t for _, t, _ in H.Page(source).runs]


def test_formulas_fallbacks_and_unclosed_elements():
    assert runs("<article><p>One <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> two.</p><noscript><p>Three</p></noscript><object>four</object></article>") == ["One x=2 two.", "Three", "four"]
    assert runs("<p>a <svg><title>no</title><text>no</text></svg> b <svg><text>no<p>c<p>d <select><option>no<option>no</select> e") == ["a b", "c", "d e"]
    assert runs("<p>a<select><option>no<div>b</div>c") == ["a", "b", "c"]
    assert runs("<p>a<script>if (1 < 2) no</script>b<p>c<style>no") == ["ab", "c"]
    assert runs("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></i></b>f") == ["a", "b", "c", "d", "e", "f"]
    assert runs("") == runs(None) == []


def test_deep_markup_takes_linear_time():
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert len(runs("<div>a" * n + "<b>x</i>" * n)) == n
        times.append(time.process_time() - began)
    assert times[1] < 12 * times[0] + 0.5


def test_page_written_by_hand(sources):
    """A layout that neither the tables nor ``compose`` have."""
    model = H.fit(sources[:150])
    paragraphs = [t for _, t, _ in H.Page(sources[160]).runs if len(t) > 120][:4]
    page = f"""<!doctype html><html><head><title>Site</title></head><body class="home"><div id="top-bar"><ul class="links"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div>
    <div class="wrap"><div class="sidebar"><h4>More</h4><ul><li><a href="/1">First link</a></li><li><a href="/2">Second link</a></li></ul></div>
    <article class="post"><h1>{paragraphs[0][:40]}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}</article></div>
    <div class="footer"><p>Copyright. <a href="/c">Contact</a></p></div></body></html>"""
    got = extract(model, page)
    assert all(p in got for p in paragraphs) and "First link" not in got and "Copyright" not in got and "Home" not in got


def test_sample_holds_each_page_once(spark, monkeypatch):
    monkeypatch.setattr(H, "TRAIN_PAGES", 3)
    monkeypatch.setattr(H, "fit", lambda sources: {"weights": {"<p": float(len(sources))}, "start": 0.0, "feature": np.zeros((1, 31), int), "cut": np.zeros((1, 31)), "leaf": np.zeros((1, 31))})
    rows = [(i, "<p>hot</p>") for i in range(300)] + [(300 + i, f"<p>{i}</p>") for i in range(3)] + [(400, None)]
    model = H.train(spark.createDataFrame(rows, "page_id long, html string"))
    assert model["weights"]["<p"] <= 4.0
