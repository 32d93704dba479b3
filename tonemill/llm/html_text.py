"""Main-text extraction: gradient-boosted trees judge DOM nodes, hierarchical decoding makes the judgements agree.

Every element gets features of itself, its subtree, its ancestors and its siblings. Trees give the log-odds that the
element belongs to the main text. A kept element needs all its ancestors kept, so the best consistent choice is a
sum over the tree, found bottom-up in one pass.

No page is labelled. Training pages are those whose markup names the parts by itself (article or main, and nav, aside,
footer and so on); each is rendered anew in several layouts with other tags, class names and extra boilerplate, so
that the trees learn from structure, text shape and attribute words and not from one template.
"""

from __future__ import annotations

import html as entities
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import shared_dir, stage

FIT_PAGES = 400
LAYOUTS = 4
TREES, DEPTH = 20, 4
SLICE = 500

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # what is inside is text up to the end tag
NEVER = RAW | set("noscript template iframe svg math select object option head button input form label fieldset canvas audio video map dialog".split())
BROKEN_OUT = {"svg", "math", "select"}  # hold no block: one that starts inside ends them
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "tr", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header"}
# Words of class, id and role attributes by what they usually name.
CONTENT_WORDS = set("article content main post entry story body text page single news blog prose hentry".split())
BOILER_WORDS = set(
    """ad ads advert advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs topbar header
    masthead footer foot copyright sidebar side widget related recommended share social cookie cookies consent notice gdpr popup modal overlay
    newsletter subscribe signup login form search comment comments disqus reply replies respond discussion tags meta pagination pager rail toolbar skip legal""".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
# every name with its value, one after another, so that no name is found inside a value
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset[str] = frozenset()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    text: list[tuple[int, str]] = field(default_factory=list)  # (order in the page, piece) held directly


def parse(page: str | None) -> list[Node]:
    """Elements of a page in document order, node 0 above all. Unclosed and misnested tags are repaired.

    A missing end tag ends with the parent's; blocks end an unclosed drawing, formula or selection before them.
    """
    page = page or ""
    nodes = [Node("#root", -1, 0)]
    open_ = [0]
    order = at = 0
    drawing = 0  # where in ``open_`` the outermost element that holds no block was put

    def say(piece: str) -> None:
        nonlocal order
        if piece:
            order += 1
            nodes[open_[-1]].text.append((order, piece))

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag in CLOSES_P:
            if drawing and drawing < len(open_) and nodes[open_[drawing]].tag in BROKEN_OUT:
                del open_[drawing:]
            for k in range(len(open_) - 1, 0, -1):
                name = nodes[open_[k]].tag
                if name == "p":
                    del open_[k:]
                    break
                if name not in INLINE:
                    break
        if tag in SIBLINGS:
            for k in range(len(open_) - 1, 0, -1):
                name = nodes[open_[k]].tag
                if name in SIBLINGS[tag]:
                    del open_[k:]
                    break
                if name in SCOPE:
                    break
        words, hidden = set(), False
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name in ("class", "id", "role"):
                    words.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a[2] or a[3] or a[4] or "").lower()))
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
        parent = open_[-1]
        if tag in ("br", "hr"):
            say(" ")
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, frozenset(words), hidden))
        nodes[parent].children.append(len(nodes) - 1)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BROKEN_OUT and not (drawing and drawing < len(open_) and nodes[open_[drawing]].tag in BROKEN_OUT):
            drawing = len(open_)
        open_.append(len(nodes) - 1)
    return nodes


FEATURES = 30


def node_features(nodes: list[Node]) -> np.ndarray:
    """Features of every node: own kind and attribute words, subtree density, ancestors, siblings, place."""
    n = len(nodes)
    own = np.array([sum(len(t.strip()) for _, t in v.text) for v in nodes], float)
    commas = np.array([sum(t.count(",") + t.count(". ") for _, t in v.text) for v in nodes], float)
    total, link, stops, elements, paragraphs, items, controls = own.copy(), np.zeros(n), commas.copy(), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    good = np.array([bool(v.words & CONTENT_WORDS) for v in nodes], float)
    bad = np.array([bool(v.words & BOILER_WORDS) for v in nodes], float)
    has_bad = bad.copy()
    for i in range(n - 1, 0, -1):
        v, p = nodes[i], nodes[i].parent
        if v.tag == "a":
            link[i] = total[i]
        paragraphs[i] += v.tag == "p"
        items[i] += v.tag == "li"
        controls[i] += v.tag in NEVER
        for total_of in (total, link, stops, elements, paragraphs, items, controls):
            total_of[p] += total_of[i]
        has_bad[p] = max(has_bad[p], has_bad[i])
    before = np.zeros(n)
    seen = 0.0
    for i in range(n):
        before[i] = seen
        seen += own[i]
    x = np.zeros((n, FEATURES))
    up_good, up_bad, up_tag, up_semantic = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, v in enumerate(nodes):
        p = max(v.parent, 0)
        up_good[i] = max(good[i], up_good[p]) if i else 0
        up_bad[i] = max(bad[i], up_bad[p]) if i else 0
        up_tag[i] = max(up_tag[p], v.tag in ("nav", "aside", "footer", "header", "form", "menu")) if i else 0
        up_semantic[i] = max(up_semantic[p], v.tag in ("article", "main")) if i else 0
        family = nodes[p].children
        size = max(1.0, total[i])
        x[i] = (
            v.depth, np.log1p(own[i]), np.log1p(total[i]), link[i] / size, stops[i] / size, np.log1p(elements[i]), total[i] / elements[i],
            paragraphs[i], items[i], controls[i], total[i] / max(1.0, total[0]), total[i] / max(1.0, total[p]), before[i] / max(1.0, total[0]),
            len(family), family.index(i) if len(family) < 50 and i else 25, good[i], bad[i], up_good[i], up_bad[i], up_tag[i], up_semantic[i], has_bad[i],
            v.tag == "p", v.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), v.tag == "li", v.tag == "a", v.tag in INLINE, v.tag in ("ul", "ol", "table"),
            good[p], link[p] / max(1.0, total[p]),
        )
    return x


def blocks(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Text of kept nodes by block in page order: references decoded, white space squeezed, empty blocks left out."""
    owner = np.zeros(len(nodes), np.int64)
    pieces: list[tuple[int, int, str]] = []
    for i, v in enumerate(nodes):
        owner[i] = owner[v.parent] if i and v.tag in INLINE else i
        if keep[i]:
            pieces += [(order, owner[i], text) for order, text in v.text]
    out, last, run = [], None, []
    # a nested block parts the text of the block around it
    for order, block, text in sorted(pieces):
        if block != last and run:
            out.append("".join(run))
            run = []
        last = block
        run.append(text)
    out.append("".join(run))
    clean = (" ".join(entities.unescape(t).split()) for t in out)
    return [t for t in clean if t]


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Best choice in which every kept node's ancestors are kept; elements that never hold text are left out."""
    gain = np.array(odds, float)
    barred = np.array([v.tag in NEVER or v.hidden for v in nodes])
    best = np.where(barred, -np.inf, gain)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


def main_labels(nodes: list[Node]) -> np.ndarray | None:
    """Which nodes are main text or hold it, on pages whose markup says so; None on others."""
    inside, outside = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, v in enumerate(nodes):
        if i:
            named = v.tag in NEVER or v.tag in ("nav", "aside", "footer", "header", "menu") or bool(v.words & BOILER_WORDS) and not v.words & CONTENT_WORDS
            outside[i] = outside[v.parent] or named
            inside[i] = (inside[v.parent] or v.tag in ("article", "main")) and not outside[i]
    if not inside.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        inside[nodes[i].parent] |= inside[i]
    return inside


def relayout(nodes: list[Node], labels: np.ndarray, seed: int, loan: list[str]) -> tuple[str, str] | None:
    """The page's main blocks in another layout, between boilerplate made of its own and ``loan``'s short texts."""
    rng = random.Random(seed)
    body = blocks(nodes, labels & np.array([v.tag not in NEVER for v in nodes]))
    other = [b for b in blocks(nodes, ~labels & np.array([v.tag not in NEVER for v in nodes])) if len(b) < 400] + loan
    if not body or not other:
        return None
    e = lambda t: entities.escape(t)
    few = lambda k: [e(rng.choice(other)[:160]) for _ in range(k)]
    name = lambda words: rng.choice([f' class="{w}"' for w in words] + [f' id="{w}"' for w in words] + [""] * (len(words) // 4))
    boiler, content = sorted(BOILER_WORDS), sorted(CONTENT_WORDS)
    links = lambda k: "".join(f'<li><a href="#">{t[:30]}</a></li>' for t in few(k))
    block = [
        lambda: f"<nav{name(['menu', 'nav', 'navbar'])}><ul>{links(rng.randint(3, 9))}</ul></nav>",
        lambda: f"<div{name(boiler)}><ul>{links(rng.randint(3, 9))}</ul></div>",
        lambda: f"<header{name(['header', 'masthead', 'topbar'])}><a href='#'>{few(1)[0]}</a><p>{few(1)[0]}</p></header>",
        lambda: f"<div{name(['ad', 'ads', 'banner', 'promo', 'sponsored'])}>{few(1)[0]}</div>",
        lambda: f"<aside{name(['sidebar', 'related', 'widget'])}><h3>{few(1)[0]}</h3><p>{few(1)[0]}</p><ul>{links(3)}</ul></aside>",
        lambda: f"<div class='{rng.choice(['sidebar', 'related', 'cookie-notice', 'gdpr consent', 'newsletter', 'social share', 'widget'])}'><p>{few(1)[0]}</p></div>",
        lambda: f"<form{name(['search', 'login', 'newsletter'])}><label>{few(1)[0]}</label><input><button>{few(1)[0]}</button></form>",
    ]
    tail = [
        lambda: f"<footer{name(['footer', 'foot', 'copyright'])}>&copy; {few(1)[0]} <a href='#'>{few(1)[0]}</a></footer>",
        lambda: f"<div class='{rng.choice(['footer', 'site-footer', 'copyright'])}'><p>{few(1)[0]}</p></div>",
        lambda: f"<{(t := rng.choice(['div', 'section', 'ol', 'ul']))} {rng.choice(['class', 'id'])}='{rng.choice(['comments', 'comment-list', 'replies', 'discussion', 'disqus'])}'><h3>{few(1)[0]}</h3>"
        + "".join(f"<{(c := 'li' if t in ('ol', 'ul') else 'div')} class='comment'><p>{e(rng.choice(other + body))}</p></{c}>" for _ in range(rng.randint(1, 4)))
        + f"</{t}>",
        *block,
    ]
    wrap = rng.choice(["article", "main", "div", "section", "div", "td"])
    inner = "".join(
        (f"<h2>{e(b)}</h2>" if k == 0 and len(b) < 120 else rng.choice([f"<p>{e(b)}</p>", f"<p><b>{e(b)}</b></p>", f"<p>{e(b)}<br></p>"]))
        + (rng.choice(block)() if rng.random() < 0.06 else "")
        for k, b in enumerate(body)
    )
    if rng.random() < 0.2:
        inner = inner.replace("<p>", "<div>").replace("</p>", "</div>")
    marked = f"<{wrap} data-main{name(content) if wrap in ('div', 'section', 'td') else ''}>{inner}</{wrap}>"
    outer = rng.choice(["{}", "<div id='wrap'>{}</div>", "<div class='container'><div class='row'>{}</div></div>", "<table><tr>{}</tr></table>"])
    head = f"<html><head><title>{few(1)[0]}</title></head><body>"
    before = "".join(rng.choice(block)() for _ in range(rng.randint(1, 4)))
    after = "".join(rng.choice(tail)() for _ in range(rng.randint(1, 4)))
    return head + before + outer.format(marked + (after if rng.random() < 0.5 else "")) + after + "</body></html>", "data-main"


def layout_labels(page: str, nodes: list[Node]) -> np.ndarray:
    """Labels of a page made by ``relayout``: the marked element and what it holds apart from named boilerplate."""
    opened = [m for m in TAG.finditer(page) if m[2] and not m[1]]
    inside = np.zeros(len(nodes), bool)
    marked = next((k for k, m in enumerate((m for m in opened), 1) if " data-main" in m[3]), None)
    # raw elements swallow tags inside them, so elements are matched by tag order only up to the marked one
    for i, v in enumerate(nodes):
        if i:
            named = v.tag in NEVER or v.tag in ("nav", "aside", "footer", "header", "menu") or bool(v.words & BOILER_WORDS)
            inside[i] = (inside[v.parent] or i == marked) and not named
    for i in range(len(nodes) - 1, 0, -1):
        inside[nodes[i].parent] |= inside[i]
    return inside


def training_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features and labels of the nodes of training pages, as they are and in ``LAYOUTS`` other layouts."""
    for b in batches:
        xs, ys = [], []
        loan: list[str] = ["Home", "About us", "All rights reserved.", "We use cookies to improve your visit.", "Sign up for our newsletter"]
        for seed, page in zip(b["seed"], b["html"]):
            nodes = parse(page)
            labels = main_labels(nodes)
            if labels is None:
                continue
            xs.append(node_features(nodes))
            ys.append(labels)
            for k in range(LAYOUTS):
                made = relayout(nodes, labels, hash((int(seed), k)), loan)
                if made:
                    again = parse(made[0])
                    xs.append(node_features(again))
                    ys.append(layout_labels(made[0], again))
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield pd.DataFrame({"x": list(x), "label": y.astype(float)})


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: one row per tree, children by place in it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t, w in enumerate(self.weight):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[t, at]
                at = np.where(f < 0, at, np.where(goes, self.left[t, at], self.right[t, at]))
            out += w * self.value[t, at]
        return 2 * out


def fit_trees(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Trees | None:
    """Boosted trees fitted by Spark on about ``fit_pages`` pages, chosen by a hash of page id and page.

    None if no chosen page names its parts; extraction then keeps everything that is not named boilerplate.
    """
    spark = pages.sparkSession
    total = pages.count()
    share = min(1.0, fit_pages / max(1, total))
    seeded = pages.select("html", F.xxhash64("page_id", "html", F.lit(23)).alias("seed"))
    # All pages are read in parallel; only the few chosen ones, written first, go into few tasks.
    chosen = stage(seeded.where(F.pmod("seed", F.lit(1 << 30)) < int(share * (1 << 30))), "pages")
    nodes = chosen.coalesce(8).mapInPandas(training_nodes, "x array<double>, label double").persist()
    kinds = nodes.select("label").distinct().count()
    if kinds < 2:
        nodes.unpersist()
        return None
    data = nodes.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=3, cacheNodeIds=False).fit(data)
    nodes.unpersist()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    size = 1 + max(r["id"] for r in rows)
    shape = (1 + max(r["treeID"] for r in rows), size)
    feature, left, right = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    threshold, value = np.zeros(shape), np.zeros(shape)
    for r in rows:
        t, i = r["treeID"], r["id"]
        value[t, i] = r["prediction"]
        if r["leftChild"] >= 0:
            feature[t, i], threshold[t, i] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
            left[t, i], right[t, i] = r["leftChild"], r["rightChild"]
    return Trees(feature, threshold, left, right, value, np.array(model.treeWeights))


def extract_page(page: str | None, nodes: list[Node], odds: np.ndarray | None) -> str:
    if odds is None:
        odds = np.array([-1.0 if v.words & BOILER_WORDS or v.tag in ("nav", "aside", "footer", "header", "menu") else 1.0 for v in nodes])
    return "\n".join(blocks(nodes, decode(nodes, odds)))


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give an empty text and 0. Repeated rows and null ids stay, and ids go through
    unchanged whatever their size; pages are read whole, however long and deeply nested; an empty table gives no rows;
    extra columns, of whatever name, are left out.
    """
    trees = fit_trees(pages, fit_pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                html = part.column("html").to_pylist()
                parsed = [parse(p) for p in html]
                odds: list[np.ndarray | None] = [None] * len(parsed)
                if trees is not None and parsed:
                    every = trees.odds(np.concatenate([node_features(n) for n in parsed]))
                    odds = np.split(every, np.cumsum([len(n) for n in parsed])[:-1])
                texts = [extract_page(p, n, o) for p, n, o in zip(html, parsed, odds)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)
