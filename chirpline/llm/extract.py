"""Operator 3: main text of web pages by gradient-boosted trees over DOM-node features.

Every node of a page gets the log-odds that it belongs to the article, from boosted trees over its
subtree's density, its attribute words, its depth and its siblings (``dom.FEATURES``). Attribute words
count by log-odds that are learnt with the trees. Decoding is
hierarchical: of all labellings in which nothing below a dropped node stays, the likeliest is
taken, so an ancestor never contradicts a descendant.

The trees are trained on the driver from ``TRAINING_PAGES`` pages that ``training_pages`` lays out
at random from a seed: article containers of many kinds between menus, headers, footers, side
bars, notices, adverts, forms and reader comments. The given pages carry no labels. The model is a
few kilobytes and is broadcast; pages are read and scored one Arrow batch at a time, no shuffle.

Nulls: a null page is empty and has an empty text. Repeated rows give repeated results, an empty
table an empty one. Cut pages are read up to the cut; time is linear in a page's length. Only the
key, the address and the page are read, so other columns may have any name.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import map_arrow, table

TRAINING_PAGES = 500
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32
#: Nodes that must carry an attribute word before its odds count.
WORD_NODES = 8
#: Bytes of pages that are scored at once.
GROUP_BYTES = 1_000_000
SEED = 3
# fixed values: names that sites give to the parts of a page, for the laid-out pages
NAMES = {
    "article": "content post article-body entry-content story main-text post-content hentry prose main article text body-content".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs share-links sharing related recommended pagination pager toolbar tags".split(),
    "advert": "ad ads advert advertisement adslot sponsor sponsored promo-box promotion banner popup modal overlay".split(),
    "notice": "cookie-notice cookies consent notice newsletter alert legal-disclaimer copyright gdpr subscribe signup login".split(),
    "comments": "comments comment-list replies reply respond disqus-thread discussion".split(),
    "side": "sidebar side-rail aside widget social footer-links footer foot site-header header masthead topbar search hidden".split(),
}


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED):
    """Pages whose article and boilerplate roots carry a data-mark of 1 or 0."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word():
        return "".join(r.choice(letters) for _ in range(r.randint(1, 9)))

    def sentence(lo, hi):
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice(".,.!?.")

    def prose(lo, hi):
        return " ".join(sentence(3, 18) for _ in range(r.randint(lo, hi)))

    def links(k, cls=""):
        return f"<ul{cls}>" + "".join(f'<li><a href="/{word()}">{word().capitalize()}</a></li>' for _ in range(k)) + "</ul>"

    def attr(*names):
        name = r.choice(names)
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="{word()}-{name}"'))

    def inline(s):
        return r.choice((s, s, s, f"<b>{s}<br>", f"<span>{s}</span>", f'{s} <a href="#">{word()}</a> {sentence(2, 6)}'))

    def boiler():
        kind = r.randrange(10)
        if kind == 0:
            return f'<nav data-mark="0">{links(r.randint(2, 9))}</nav>'
        if kind == 1:
            return f'<div data-mark="0"{attr(*NAMES["menu"])}>{links(r.randint(2, 8))}</div>'
        if kind == 2:
            return f'<header data-mark="0"><a href="/">{word()}</a> {sentence(1, 8)}{links(r.randint(0, 5))}</header>'
        if kind == 3:
            return f'<footer data-mark="0">&copy; {word()}.example &middot; {prose(1, 3)}</footer>'
        if kind == 4:
            return f'<aside data-mark="0"{r.choice(("", attr(*NAMES["side"])))}><h3>{sentence(1, 3)}</h3>{r.choice((links(4), f"<p>{prose(1, 4)}</p>"))}</aside>'
        if kind == 5:
            return f'<div data-mark="0"{attr(*NAMES["advert"])}>{r.choice((prose(1, 2), f"<p>{prose(1, 3)}</p>"))}</div>'
        if kind == 6:
            return f'<div data-mark="0"{attr(*NAMES["notice"])}>{r.choice((prose(1, 3), f"<p>{prose(1, 3)}</p><button>OK</button>"))}</div>'
        if kind == 7:
            return f'<form data-mark="0"><label>{word()}</label><input name="q"><button>{word()}</button></form>'
        if kind == 8:
            items = "".join(r.choice((f'<div class="comment"><b>{word()}</b> <p>{prose(1, 4)}</p></div>', f"<li><p>{prose(1, 5)}</p></li>")) for _ in range(r.randint(1, 6)))
            return f'<{(t := r.choice(("div", "section", "ol")))} data-mark="0"{attr(*NAMES["comments"])}>{items}</{t}>'
        return f'<div data-mark="0"{attr(*NAMES["side"])}><p>{prose(1, 3)}</p>{links(r.randint(1, 5))}</div>'

    def article():
        blocks = [f"<h1>{sentence(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((0, 1, 2, 4, 8, 16, 40))):
            k = r.random()
            if k < 0.75:
                blocks.append(f"<p>{inline(prose(1, r.choice((1, 2, 8))))}" + r.choice(("</p>", "</p>", "")))
            elif k < 0.8:
                blocks.append(f"<h2>{sentence(1, 6)}</h2>")
            elif k < 0.86:
                blocks.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.9:
                blocks.append(f"<blockquote>{prose(1, 3)}</blockquote>")
            elif k < 0.93:
                blocks.append("<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.97:
                blocks.append(f"<div>{prose(1, 4)}</div>")
            else:
                blocks.append(boiler())
        inner = "".join(blocks)
        k = r.random()
        if k < 0.4:
            return f'<article data-mark="1">{inner}</article>'
        if k < 0.55:
            return f'<main data-mark="1">{inner}</main>'
        return f'<{(t := r.choice(("div", "section")))} data-mark="1"{attr(*NAMES["article"])}>{inner}</{t}>'

    for _ in range(n):
        above = "".join(boiler() for _ in range(r.randint(0, 3)))
        below = "".join(boiler() for _ in range(r.randint(0, 4)))
        inner = above + article() + below
        if r.random() < 0.4:
            inner = f'<div class="{r.choice(("wrapper", "page", "container", "site", "row"))}">{inner}</div>'
        page = f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>"
        yield page[: r.randint(len(page) * 3 // 4, len(page))] if r.random() < 0.1 else page


def training_labels(nodes: list[dom.Node]) -> np.ndarray:
    """1: below an article's mark and no nearer boilerplate mark, or above an article; else 0."""
    inside = [0] * len(nodes)
    for i, v in enumerate(nodes):
        inside[i] = int(v.mark) if v.mark in ("0", "1") else inside[v.parent] if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        v = nodes[i]
        if inside[i] and nodes[v.parent].mark is None:
            inside[v.parent] = 1
    return np.array(inside, np.float64)


class BoostedTrees:
    """Logistic boosting of shallow trees over binned features, with Newton leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        base = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(base / (1 - base)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                first = (1 << level) - 1
                width = 1 << level
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    cell = (at - first) * BINS + b[:, j]
                    gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[:, len(self.edges[j]) :] = 0
                    k = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(width), k] > best + 1e-9)
                    best[better] = gain[better, k[better]]
                    feature[first + better] = j
                    cut[first + better] = [self.edges[j][i] for i in k[better]]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] >= cut[at])
            leaf = at - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
            f = f + value[leaf]
            self.trees.append((feature, cut, value))

    def logits(self, x: np.ndarray) -> np.ndarray:
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] >= cut[at])
            f += value[at - ((1 << self.depth) - 1)]
        return f


def word_weights(pages: list[list[dom.Node]], labels: list[np.ndarray]) -> dict[str, float]:
    """Log-odds that a node with an attribute word is of the article, against all nodes with words."""
    seen: dict[str, list[int]] = {}
    for nodes, ys in zip(pages, labels):
        for v, y in zip(nodes, ys):
            for w in set(v.words):
                seen.setdefault(w, [0, 0])[int(y)] += 1
    no, yes = (sum(c[k] for c in seen.values()) + 1 for k in (0, 1))
    return {w: float(np.log((b + 1) / (a + 1)) - np.log(yes / no)) for w, (a, b) in seen.items() if a + b >= WORD_NODES}


class Extractor:
    """The trees and the weights of attribute words."""

    def __init__(self, pages: list[str]):
        read = [dom.read(p) for p in pages]
        labels = [training_labels(p) for p in read]
        self.words = word_weights(read, labels)
        self.trees = BoostedTrees(np.concatenate([self.features(p) for p in read]), np.concatenate(labels))

    def features(self, nodes: list[dom.Node]) -> np.ndarray:
        return dom.features(nodes, self.words).astype(np.float64)

    def texts(self, pages: list[str]) -> list[str]:
        read = [dom.read(p) for p in pages]
        sizes = np.cumsum([0, *map(len, read)])
        logits = self.trees.logits(np.concatenate([self.features(p) for p in read])) if read else np.empty(0)
        return [dom.main_text(p, dom.decode(p, logits[i:j])) for p, i, j in zip(read, sizes, sizes[1:])]


_model: list[Extractor] = []


def model() -> Extractor:
    """The trained extractor (trained once in a process)."""
    if not _model:
        _model.append(Extractor(list(training_pages())))
    return _model[0]


def extract_pages(pages: list[str], trained: Extractor):
    """The main text of each page; pages are scored in groups of ``GROUP_BYTES``."""
    group, size = [], 0
    for i, p in enumerate(pages):
        group.append(p)
        size += len(p)
        if size >= GROUP_BYTES or i == len(pages) - 1:
            yield from trained.texts(group)
            group, size = [], 0


def extract_main_text(df: DataFrame, page: str = "html", keep: list[str] = ("page_id", "url")) -> DataFrame:
    """Per row ``keep`` and text."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    keep = list(keep)

    def run(batches):
        for b in batches:
            pages = b.column("__page").to_pylist()
            texts = list(extract_pages(pages, shared.value))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    rows = df.select(*keep, F.coalesce(F.col(page), F.lit("")).alias("__page"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kept + "text string")


def op3_html_main_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
