"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser makes the page's tree of block elements (inline elements belong to the block around them). Each
block gets features of its own and of its place: lengths and link shares of itself and of its subtree, density, depth,
siblings, and learnt weights of its tag and attribute tokens and of those of its ancestors. Boosted trees (logistic
loss, second-order leaves, histogram splits; Friedman 2001) give each block the log-odds of being article text.

Decoding maximises the sum of the blocks' log-odds, weighted by their text, over choices in which a dropped block drops
all below it, so that no kept block sits in a dropped one. It runs bottom-up and then top-down over the tree.

The trees are trained on a bounded sample of pages (``TRAIN_PAGES``): pages as they are, where an ``article`` or
``main`` element says what the text is, and pages composed of the same paragraphs in other layouts (``compose``), where
that is known by construction. Training is one small task; the model is broadcast. Pages never leave their tasks.

Formulas, fallback text of embedded objects and text for readers without scripts are read like other text; drawings and
lists of choices are passed over up to their end or the next block. Null and empty pages, and pages without main text, give
an empty text. Nothing is capped; broken markup is read on, but for scripts, styles and the like, which without an end tag
go to the page's end, as in a browser.
Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.hashing import tidy

#: Bound of the training sample; composed pages for each sampled one; trees, their depth, learning rate, bins, leaf penalty.
TRAIN_PAGES, COMPOSED, TREES, DEPTH, RATE, BINS, PENALTY, SEED = 150, 4, 60, 4, 0.25, 32, 1.0, 11

#: Fixed element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
#: Elements whose text isn't read: until their end tag or, where that is missing, the next block.
SILENT = frozenset("svg select annotation".split())
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of the first kind unless one of the second kind is open inside.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_MARKS = re.compile(r"[.!?;:,]")


class Page:
    """Blocks in page order: tag, parent, depth, tokens, label; and runs of text: block, text, how much of it is links."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.tokens, self.label = ["#"], [-1], [0], [()], [None]
        self.runs: list[tuple[int, str, int]] = []
        source = source or ""
        stack: list[tuple[str, int]] = [("#", 0)]
        parts: list[str] = []
        linked = links = at = 0
        opened: dict[str, int] = {}  # how many elements of a name are open

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.runs.append((stack[-1][1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not any(opened.get(t) for t in SILENT):
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked += len(text.strip())

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                if stack[-1][0] in BLOCKS:
                    flush()
                name = stack.pop()[0]
                opened[name] -= 1
                links -= name == "a"

        while m := _TAG.search(source, at):
            add(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name == "br" or name == "hr":
                if name == "hr":
                    flush()
                else:
                    parts.append(" ")
                continue
            if m[1]:
                for d in range(0) if not opened.get(name) else range(len(stack) - 1, 0, -1):
                    if stack[d][0] == name:
                        close(d)
                        break
                    if stack[d][0] in ("table", "body") and name not in BLOCKS:
                        break
                continue
            if name in VOID:
                continue
            if name in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                    at = end.end()
                continue
            if name in BLOCKS:
                for d in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in SILENT) else ():
                    if stack[d][0] in SILENT:
                        close(d)
                if opened.get("p"):
                    for d in range(len(stack) - 1, 0, -1):
                        if stack[d][0] == "p" and name not in ("button", "label", "option", "legend"):
                            close(d)
                            break
                        if stack[d][0] in ("td", "th", "table", "button"):
                            break
                if name in ENDS:
                    kinds, walls = ENDS[name]
                    for d in range(0) if not any(opened.get(k) for k in kinds) else range(len(stack) - 1, 0, -1):
                        if stack[d][0] in walls:
                            break
                        if stack[d][0] in kinds:
                            close(d)
                            break
                flush()
                block = len(self.tag)
                tokens, label = [], None
                for kind, a, b, c in _ATTR.findall(m[3]) if "=" in m[3] else ():
                    if kind == "data-y":
                        label = int((a or b or c) == "1")
                    else:
                        tokens += [t.lower() for t in _TOKEN.findall(a or b or c)]
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.depth.append(len(stack))
                self.tokens.append(tuple(tokens))
                self.label.append(label)
                stack.append((name, block))
                opened[name] = opened.get(name, 0) + 1
            elif not m[3].endswith("/") or name not in SILENT:
                links += name == "a"
                stack.append((name, stack[-1][1]))
                opened[name] = opened.get(name, 0) + 1
        add(source[at:])
        close(1)
        flush()


def features(page: Page, weights: dict[str, float]) -> np.ndarray:
    """One row a block."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, link, marks, words = (np.zeros(n) for _ in range(4))
    for b, text, linked in page.runs:
        own[b] += len(text)
        link[b] += linked
        marks[b] += len(_MARKS.findall(text))
        words[b] += text.count(" ") + 1
    sub, sub_link, blocks, kids, paras = own.copy(), link.copy(), np.ones(n), np.zeros(n), np.zeros(n)
    place, siblings_alike, last = np.zeros(n), np.zeros(n), {}
    tag_w = np.array([weights.get(f"<{t}", 0.0) for t in page.tag])
    low, high = np.zeros(n), np.zeros(n)
    for i, tokens in enumerate(page.tokens):
        if tokens:
            w = [weights.get(t, 0.0) for t in tokens]
            low[i], high[i] = min(0.0, *w), max(0.0, *w)
    up_low, up_high, up_tag_low, up_tag_high = (np.zeros(n) for _ in range(4))
    for i in range(1, n):
        p = parent[i]
        place[i] = kids[p]
        kids[p] += 1
        last[p, page.tag[i]] = last.get((p, page.tag[i]), 0) + 1
        up_low[i], up_high[i] = min(up_low[p], low[p]), max(up_high[p], high[p])
        up_tag_low[i], up_tag_high[i] = min(up_tag_low[p], tag_w[p]), max(up_tag_high[p], tag_w[p])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        sub_link[p] += sub_link[i]
        blocks[p] += blocks[i]
        paras[p] += page.tag[i] == "p"
    for i in range(1, n):
        siblings_alike[i] = last[parent[i], page.tag[i]]
    total = max(1.0, sub[0])
    up = np.maximum(parent, 0)
    return np.column_stack([
        np.log1p(own), link / np.maximum(own, 1), marks / np.maximum(words, 1), np.log1p(words), np.log1p(sub), sub / total,
        sub_link / np.maximum(sub, 1), np.log1p(sub / blocks), page.depth, place, np.log1p(kids[up]), siblings_alike, paras, paras[up],
        tag_w, low, high, up_low, up_high, up_tag_low, up_tag_high, sub[up] / total, sub_link[up] / np.maximum(sub[up], 1), np.arange(n) / n,
    ])


def token_weights(pages: list[Page], labels: list[np.ndarray]) -> dict[str, float]:
    """Smoothed log-odds of tags and attribute tokens, by the blocks with text that they hold or stand over."""
    seen: dict[str, list[float]] = {}
    for page, y in zip(pages, labels, strict=True):
        texty = {b for b, _, _ in page.runs}
        for b in texty:
            if y[b] < 0:
                continue
            over, i = set(), b
            while i > 0:
                over |= {f"<{page.tag[i]}", *page.tokens[i]}
                i = page.parent[i]
            for t in over:
                seen.setdefault(t, [1.0, 1.0])[int(y[b])] += 1
    base = np.log(sum(v[1] for v in seen.values()) / max(1.0, sum(v[0] for v in seen.values()))) if seen else 0.0
    return {t: float(np.clip(np.log(v[1] / v[0]) - base, -4, 4)) for t, v in seen.items() if v[0] + v[1] >= 5}


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """Trees as arrays: feature, cut and leaf value of each node in heap order."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    size, start = 2 ** (DEPTH + 1) - 1, float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
    trees, score = [], np.full(len(y), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(size):
            mine = np.flatnonzero(node == at)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            leaf[at] = RATE * gs / (hs + PENALTY)
            if at >= 2**DEPTH - 1:
                continue
            best = (1e-6, -1, -1)
            for f in range(x.shape[1]):
                cg = np.cumsum(np.bincount(bins[mine, f], g[mine], BINS + 1))[:-1]
                ch = np.cumsum(np.bincount(bins[mine, f], h[mine], BINS + 1))[:-1]
                gain = cg**2 / (ch + PENALTY) + (gs - cg) ** 2 / (hs - ch + PENALTY) - gs**2 / (hs + PENALTY)
                gain[(ch < 1e-3) | (hs - ch < 1e-3)] = 0
                k = int(gain[: len(cuts[f])].argmax()) if len(cuts[f]) else 0
                if len(cuts[f]) and gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] < 0:
                continue
            feature[at], cut[at] = best[1], cuts[best[1]][best[2]]
            node[mine] = 2 * at + 1 + (bins[mine, best[1]] > best[2])
        score += leaf[node]
        trees.append((feature, cut, leaf))
    return {"start": start, "feature": np.array([t[0] for t in trees]), "cut": np.array([t[1] for t in trees]), "leaf": np.array([t[2] for t in trees])}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > cut[node]))
        out += leaf[node]
    return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Kept blocks of the best choice in which a dropped block drops all below it."""
    n = len(page.tag)
    size = np.zeros(n)
    for b, text, _ in page.runs:
        size[b] += len(text)
    keep, drop = odds * size, -odds * size
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, dtype=bool)
    for i in range(n):
        kept[i] = keep[i] > drop[i] and (i == 0 or kept[page.parent[i]])
    return kept


def main_text(page: Page, kept: np.ndarray) -> str:
    return " ".join(text for b, text, _ in page.runs if kept[b])


def semantic_labels(page: Page) -> np.ndarray:
    """1 inside the page's article or main element, 0 elsewhere; -1 throughout if it has none."""
    y = np.zeros(len(page.tag), dtype=int)
    if not any(t in ("article", "main") for t in page.tag):
        return y - 1
    for i in range(1, len(y)):
        inside = y[page.parent[i]] or page.tag[i] in ("article", "main")
        y[i] = inside and page.tag[i] not in ("nav", "aside", "footer", "form", "header")
    return y


def given_labels(page: Page) -> np.ndarray:
    """Labels written by ``compose``, inherited downwards; -1 above them."""
    y = np.full(len(page.tag), -1)
    for i in range(1, len(y)):
        y[i] = page.label[i] if page.label[i] is not None else y[page.parent[i]]
    return y


#: Fixed words that page authors give to the parts of a page: of the article, and of what surrounds it.
ARTICLE_NAMES = "content article post entry story body main text post-content entry-content article-body main-content story-text".split()
BESIDE = {
    "nav": ("nav", "menu navbar breadcrumb breadcrumbs navigation topnav main-menu site-nav"), "header": ("header", "header masthead site-header top banner logo"),
    "footer": ("footer", "footer site-footer copyright legal bottom colophon"), "side": ("aside", "sidebar side rail widget widget-area secondary right-rail"),
    "ad": ("div", "ad ads advert advertisement sponsored promo sponsor adsbox banner-ad"), "notice": ("div", "cookie notice consent cookie-banner gdpr alert popup modal paywall disclaimer"),
    "form": ("form", "form newsletter signup login search subscribe contact"), "comments": ("section", "comments comment discussion replies disqus comment-list reader-comments responses"),
    "related": ("div", "related recommended more trending popular read-next tags social share sharing author-bio meta pagination"),
}


def compose(paragraphs: list[str], other: list[str], rng: random.Random) -> str:
    """A page of these paragraphs in a random layout; ``data-y`` marks what is article text."""
    esc = html.escape
    some = lambda k: [esc(rng.choice(other or paragraphs or [""])) for _ in range(k)]

    def beside(kind: str) -> str:
        tag, names = BESIDE[kind]
        tag = tag if rng.random() < 0.5 else rng.choice(("div", "section", "div"))
        attr = f' {rng.choice(("class", "id"))}="{rng.choice(names.split())}"' if tag != BESIDE[kind][0] or tag == "div" or rng.random() < 0.6 else ""
        if kind in ("nav", "related") or (kind in ("footer", "side", "header") and rng.random() < 0.5):
            body = "<ul>" + "".join(f'<li><a href="#">{" ".join(t.split()[: rng.randint(1, 5)])}</a></li>' for t in some(rng.randint(2, 8))) + "</ul>"
        elif kind == "comments":
            one = lambda: f'<div class="{rng.choice(("comment", "reply", "comment-body"))}"><p>{esc(rng.choice(paragraphs or [""]))}</p></div>' if rng.random() < 0.7 else f"<p>{esc(rng.choice(paragraphs or ['']))}</p>"
            body = (f"<h3>{some(1)[0][:20]}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = f"<label>{some(1)[0][:30]}</label><input><button>{some(1)[0][:12]}</button>" + (f"<p>{some(1)[0]}</p>" if rng.random() < 0.5 else "")
        else:
            body = "".join(f"<p>{t}</p>" if rng.random() < 0.6 else f"<div>{t}</div>" if rng.random() < 0.5 else t for t in some(rng.randint(1, 3)))
        return f'<{tag}{attr} data-y="0">{body}</{tag}>'

    inner = [f"<{t}>{esc(p)}</{t}>" for p in paragraphs for t in [rng.choice("p p p p p p div blockquote".split())]]
    if paragraphs and rng.random() < 0.7:
        inner.insert(0, f"<h1>{esc(paragraphs[0][:60])}</h1>")
    if rng.random() < 0.3 and len(inner) > 2:
        inner.insert(rng.randint(1, len(inner) - 1), "<ul>" + "".join(f"<li>{esc(p[:80])}</li>" for p in paragraphs[:4]) + "</ul>")
    if rng.random() < 0.3 and len(inner) > 2:
        inner.insert(rng.randint(1, len(inner) - 1), f"<h2>{esc(paragraphs[-1][:40])}</h2>")
    inside = [k for k in ("ad", "related", "form", "side", "comments", "notice") if rng.random() < 0.25]
    for k in inside:
        inner.insert(len(inner) if k == "comments" else rng.randint(0, len(inner)), beside(k))
    tag = rng.choice("article main div div div section td".split())
    attr = f' {rng.choice(("class", "id"))}="{rng.choice(ARTICLE_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
    body = f'<{tag}{attr} data-y="1">{"".join(inner)}</{tag}>'
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    before = [beside(k) for k in ("header", "nav", "ad", "notice", "form", "side") if rng.random() < 0.45]
    after = [beside(k) for k in ("comments", "related", "side", "form", "ad", "footer", "notice") if rng.random() < 0.45]
    rng.shuffle(before)
    page = "".join([*before, body, *after])
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = f'<div class="{rng.choice(("wrapper", "container", "page", "row", "site"))}">{page}</div>'
    return f"<html><head><title>{some(1)[0][:40]}</title></head><body>{page}</body></html>"


def fit(sources: list[str | None]) -> dict:
    rng, pages, labels = random.Random(SEED), [], []
    for s in sources:
        page = Page(s)
        y = semantic_labels(page)
        if (y < 0).all():
            continue
        pages.append(page)
        labels.append(y)
        text = [t for b, t, _ in page.runs if y[b] == 1]
        other = [t for b, t, _ in page.runs if y[b] == 0]
        for _ in range(COMPOSED):
            first = rng.randint(0, max(0, len(text) - 2))
            made = Page(compose(text[first : first + rng.randint(1, 12)], other, rng))
            pages.append(made)
            labels.append(given_labels(made))
    if not pages:
        none = np.zeros((0, 2 ** (DEPTH + 1) - 1))
        return {"weights": {}, "start": 0.5, "feature": none.astype(int), "cut": none, "leaf": none}
    weights = token_weights(pages, labels)
    rows, y, w = [], [], []
    for page, lab in zip(pages, labels, strict=True):
        size = np.zeros(len(lab))
        for b, t, _ in page.runs:
            size[b] += len(t)
        use = (lab >= 0) & (size > 0)
        rows.append(features(page, weights)[use])
        y.append(lab[use])
        w.append(1 + np.log1p(size[use]) / 4)
    return {"weights": weights} | boost(np.concatenate(rows), np.concatenate(y).astype(float), np.concatenate(w))


def train(pages: DataFrame, source: str = "html") -> dict:
    """The model, fitted in one task on at most about ``TRAIN_PAGES`` different pages drawn by a hash; its size is fixed."""
    hashed = pages.where(F.col(source).isNotNull()).select(F.xxhash64(source).alias("hash"), F.col(source).alias("source"))
    total = hashed.agg(F.approx_count_distinct("hash", 0.02)).first()[0]
    share = int(1_000_000 * min(1.0, TRAIN_PAGES / max(1, total)))
    picked = hashed.where(F.pmod("hash", F.lit(1_000_000)) < share).groupBy("hash").agg(F.min("source").alias("source")).select("source")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit(sorted(pdf["source"])[: 4 * TRAIN_PAGES])
        names = list(m["weights"])
        return pd.DataFrame({"names": [names], "weights": [[m["weights"][t] for t in names]], "start": [m["start"]], "feature": [m["feature"].ravel().tolist()], "cut": [m["cut"].ravel().tolist()], "leaf": [m["leaf"].ravel().tolist()]})

    got = picked.groupBy(F.lit(0).alias("all")).applyInPandas(one, "names array<string>, weights array<double>, start double, feature array<long>, cut array<double>, leaf array<double>").collect()
    if not got:
        return fit([])
    r, size = got[0], 2 ** (DEPTH + 1) - 1
    shape = lambda v, kind: np.array(v, dtype=kind).reshape(-1, size)
    return {"weights": dict(zip(r.names, r.weights, strict=True)), "start": r.start, "feature": shape(r.feature, int), "cut": shape(r.cut, float), "leaf": shape(r.leaf, float)}


def extract(pages: DataFrame, model: dict, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text, n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    fields = [pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                trees = [Page(s) for s in part.column(len(keep)).to_pylist()]
                odds = log_odds(model, np.concatenate([features(p, model["weights"]) for p in trees]))
                ends = np.cumsum([len(p.tag) for p in trees])
                texts = [main_text(p, decode(p, o)) for p, o in zip(trees, np.split(odds, ends[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in fields])

    return pages.select(*keep, source).mapInArrow(tidy(run), T.StructType(fields))
