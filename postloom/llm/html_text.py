"""HTML extraction with a tree-structured graphical model (operator 4).

Each block-level element, and each inline one that carries a name or is hidden, is a node with a
hidden label, content or not.  Its features give it a
potential of its own, and a table of label pairs ties it to its parent.  Sum-product messages go
from the leaves to the root and back, which gives every node's exact content marginal; text
directly inside nodes above one half is the page's main text.

Potentials are smoothed log ratios of feature counts from labelled pages: the small set below,
and a bounded sample of the table's own pages that mark their article by an element.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 2000  # at most about so many of the table's own pages are used for training

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
#: what lies in these is not text of the page
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title")}
NAMED = re.compile(r"(?<![\w-])(class|id|role|data-label|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BARE = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


@dataclass
class Node:
    tag: str
    parent: int
    features: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    label: str = ""


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag in one pass; comments, declarations and raw elements have no name.

    A tag ends at the first > outside quotes; from the first tag whose quotes never close, at the
    first > of all.  A tag that never ends takes the rest of the page.
    """
    at, quotes = 0, True
    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
            continue
        head = NAME.match(page, at)
        if not head:
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                yield start, at, False, "", ""
            else:
                at += 1  # a bare < is text
            continue
        whole = ATTRIBUTES.match(page, head.end()) if quotes else None
        if whole:
            at = whole.end()
        else:
            quotes = False
            end = page.find(">", head.end())
            at = end + 1 if end >= 0 else len(page)
        name, attributes = head[2].lower(), page[head.end() : at - 1]
        if name in RAW and not head[1]:
            close = RAW[name].search(page, at)
            at = close.end() if close else len(page)
            name = ""
        yield start, at, bool(head[1]), name, attributes


def parse(page: str, own: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, and the text runs: (node, text); a run of node -1 is a break.

    Node 0 holds the page, node 1 is its body, there or not.  ``own``: a page of the module's set,
    whose data-label says what a part is; elsewhere that attribute may mean anything.
    """
    nodes, runs = [Node("#root", -1), Node("body", 0, ["tag=body"])], []
    stack, links, at = [0, 1], 0, 0
    open_: Counter = Counter()
    inline: dict[str, list[bool]] = {}  # of the open inline elements of each tag, which are nodes

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw)
            node = nodes[stack[-1]]
            runs.append((stack[-1], raw))
            n = len(raw.split())
            node.words += n
            if links:
                node.linked += n

    def opened(tag: str, names: list[str], label: str) -> None:
        nodes.append(Node(tag, stack[-1], [f"tag={tag}", *(f"name={n}" for n in names)], label=label))
        open_[tag] += 1
        stack.append(len(nodes) - 1)

    def closed(tag: str) -> None:
        if open_[tag]:
            while nodes[stack[-1]].tag != tag:
                open_[nodes[stack.pop()].tag] -= 1
            open_[nodes[stack.pop()].tag] -= 1

    for start, end, closing, tag, attributes in tags(page):
        text(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag in VOID:
                continue
            if closing:
                if inline.get(tag) and inline[tag].pop():
                    closed(tag)
            else:
                names, label = _names(attributes, own)
                inline.setdefault(tag, []).append(bool(names or label))
                if names or label:
                    opened(tag, names, label)
            continue
        runs.append((-1, ""))
        if tag == "body" and not closing:
            names, nodes[1].label = _names(attributes, own)
            nodes[1].features += [f"name={n}" for n in names]
        if tag in VOID or tag in ("html", "head", "body"):
            continue
        links = 0
        if closing:
            closed(tag)
            continue
        if tag in CLOSES_P and open_["p"] and nodes[block := _block(nodes, stack)].tag == "p":
            while stack[-1] != block:
                open_[nodes[stack.pop()].tag] -= 1
            closed("p")
        if tag in SAME_CLOSES and nodes[stack[-1]].tag in SAME_CLOSES[tag].split():
            open_[nodes[stack.pop()].tag] -= 1
        opened(tag, *_names(attributes, own))
    text(page[at:])
    return nodes, runs


def _block(nodes: list[Node], stack: list[int]) -> int:
    """The innermost open element that is not inline."""
    i = len(stack) - 1
    while nodes[stack[i]].tag in INLINE:
        i -= 1
    return stack[i]


def _names(attrs: str, own: bool = False) -> tuple[list[str], str]:
    """Lower-cased word parts of class, id and role, a sign of its own for what is hidden; the value of data-label in a page of the module's set."""
    names, label = [], ""
    if "=" in attrs:
        for key, a, b, c in NAMED.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "data-label":
                label = value if own else ""
            elif key == "style":
                names += ["-hidden"] * bool(INVISIBLE.search(value))
            elif key == "aria-hidden":
                names += ["-hidden"] * (value.lower() == "true")
            else:
                names += [x.lower() for x in LETTERS.findall(value)]
    if "idden" in attrs.lower() and BARE.search(QUOTED.sub('""', attrs)):
        names.append("-hidden")
    return sorted(set(names)), label


def _band(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


PARTS = frozenset("div section article main nav header footer aside form fieldset center td".split())


def add_shape(nodes: list[Node]) -> None:
    """Adds features of size and link share, over each node's whole subtree, of its own words, and
    for the body of how many of the page's words lie in no part of it."""
    words, linked = [n.words for n in nodes], [n.linked for n in nodes]
    loose = sum(n.words for n, apart in zip(nodes, _in_part(nodes), strict=True) if not apart)
    for i in range(len(nodes) - 1, 0, -1):
        words[nodes[i].parent] += words[i]
        linked[nodes[i].parent] += linked[i]
    for n, w, k in zip(nodes, words, linked, strict=True):
        share = _band(100 * k // w, (1, 30, 70)) if w else 4
        n.features += [f"links={share}", f"size={_band(w, (1, 5, 15, 50))}", f"own={_band(n.words, (1, 15, 50))}"]
    nodes[1].features.append(f"loose={_band(100 * loose // max(words[1], 1), (10, 30, 50))}")


def _in_part(nodes: list[Node]) -> list[bool]:
    """Whether each node lies in a part of the body, such as a div, or is one."""
    out = [False] * len(nodes)
    for i in range(2, len(nodes)):
        out[i] = nodes[i].tag in PARTS or out[nodes[i].parent]
    return out


@dataclass
class Model:
    """Log potentials; index 1 is content.

    ``pair``: of parent and child, one table for children without a known name and one for those
    with one, which more often are something else than their parent, such as an advert in an article.
    """

    weight: dict[str, float]
    pair: Sequence[Sequence[Sequence[float]]]

    def knows(self, node: Node) -> bool:
        return any(f.startswith("name=") and f in self.weight for f in node.features)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content."""
        n = len(nodes)
        own = [0.0] * n
        for i in range(1, n):
            own[i] = max(-12.0, min(12.0, sum(self.weight.get(f, 0.0) for f in nodes[i].features)))
        tables = [[math.exp(x) for row in table for x in row] for table in self.pair]
        edge = [tables[self.knows(node)] for node in nodes]
        up0, up1 = [1.0] * n, [math.exp(x) for x in own]  # own potential times the children's messages
        to0, to1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            p, (a00, a01, a10, a11) = nodes[i].parent, edge[i]
            m0, m1 = a00 * up0[i] + a01 * up1[i], a10 * up0[i] + a11 * up1[i]
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            up0[p] *= to0[i]
            up1[p] *= to1[i]
            s = up0[p] + up1[p]
            up0[p] /= s
            up1[p] /= s
        down0, down1 = [1.0] * n, [1.0] * n
        down1[0] = 0.0  # the root holds the page, it is not content
        out = [0.0] * n
        for i in range(1, n):
            p, (a00, a01, a10, a11) = nodes[i].parent, edge[i]
            b0, b1 = down0[p] * up0[p] / max(to0[i], 1e-300), down1[p] * up1[p] / max(to1[i], 1e-300)
            d0, d1 = b0 * a00 + b1 * a10, b0 * a01 + b1 * a11
            s = d0 + d1 or 1.0
            down0[i], down1[i] = d0 / s, d1 / s
            z0, z1 = down0[i] * up0[i], down1[i] * up1[i]
            out[i] = z1 / (z0 + z1) if z0 + z1 else 0.0
        return out


def labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks its parts (the module's set), or its article by an element; else None."""
    marked = any(n.label for n in nodes)
    if not marked and sum(n.tag == "article" for n in nodes) != 1:
        return None
    out = [0] * len(nodes)
    for i in range(1, len(nodes)):
        n = nodes[i]
        if n.label:
            out[i] = int(n.label == "content")
        elif not marked and n.tag == "article":
            out[i] = 1
        elif not marked and n.tag in ("nav", "aside", "footer", "form", "header"):
            out[i] = 0
        else:
            out[i] = out[n.parent]
    return out


def count_page(page: str, counts: Counter, own: bool = False) -> None:
    nodes, _ = parse(page, own)
    add_shape(nodes)
    content = labels(nodes)
    if content is None:
        return
    for i in range(1, len(nodes)):
        counts[f"pair={content[nodes[i].parent]}{'named' * any(f.startswith('name=') for f in nodes[i].features)}", content[i]] += 1
        counts["all", content[i]] += 1
        for f in set(nodes[i].features):
            counts[f, content[i]] += 1


def fitted(counts: dict[tuple[str, int], float], least: float = 0.05, share: float = 0.6) -> Model:
    """Smoothed log ratios: how much likelier a feature is with content than without.

    Features without a name repeat from node to node, so only a share of their log ratio counts.
    """
    n = [counts.get(("all", k), 0) + 1.0 for k in (0, 1)]
    weight = {}
    for f in {f for f, _ in counts}:
        if f != "all" and not f.startswith("pair="):
            c = [counts.get((f, k), 0) + least for k in (0, 1)]
            weight[f] = math.log(c[1] / n[1]) - math.log(c[0] / n[0])
            if not f.startswith("name=") and min(counts.get((f, k), 0) for k in (0, 1)) > 0:
                weight[f] *= share
    pair = []
    for kind in ("", "named"):
        seen = [[counts.get((f"pair={k}{kind}", j), 0) + 1.0 for j in (0, 1)] for k in (0, 1)]
        pair.append([[math.log(x / sum(c)) for x in c] for c in seen])
    return Model(weight, pair)


def main_text(page: str, model: Model) -> str:
    nodes, runs = parse(page)
    add_shape(nodes)
    keep = [p > 0.5 for p in model.marginals(nodes)]
    out: list[str] = []
    for node, text in runs:
        if node < 0:
            out.append(" ")
        else:
            out.append(text if keep[node] else " ")
    return " ".join("".join(out).split())


def trained(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """Model from the labelled set and about ``most`` of the pages at most, chosen by a hash of the whole row.

    Rows alike are chosen all or none, and each counts as one page at most.
    """
    total = pages.count()
    every = max(1, -(-total // most))
    sample = pages.filter(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(every)) == 0).filter("html is not null").select("html").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                count_page(page, counts)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["feature", "label", "n"])

    # the features are bounded by the sample
    rows = sample.select("html").mapInArrow(run, "feature string, label int, n bigint").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    counts: Counter = Counter()
    for page in LABELLED:
        count_page(page, counts, own=True)
    own = sum(counts["all", k] for k in (0, 1))
    seen = sum(r["n"] for r in rows if r["feature"] == "all")
    scale = min(1.0, 0.25 * own / seen) if seen else 0.0  # the table's pages, much alike, weigh a quarter of the labelled set
    out: dict = dict(counts)
    for r in rows:
        out[r["feature"], r["label"]] = out.get((r["feature"], r["label"]), 0) + r["n"] * scale
    return fitted(out)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty html gives an empty text, as does a page without content nodes.  Very long
    pages are read whole, in one pass.  Text that lies in no part of the body, with or without
    tags for head and body, is the body's own.  Repeated rows come back as often as they came in;
    empty tables are fine; further columns are left aside.
    """
    model = model or trained(pages)
    packed = json.dumps([model.weight, model.pair])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pair = json.loads(packed)
        own = Model(weight, pair)
        for b in batches:
            texts = [main_text(x, own) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


_WORDS = "the quick report says that people in town have seen the river rise again this spring, and that many of them now expect more rain before the month is out. "
_SHORT = "A few words here."
_MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "news", "sport", "contact", "about"))

#: pages with labelled parts: content inside data-label="content", all else not
LABELLED = (
    f'<body><header class="site-header" id="masthead"><div class="logo branding">Daily</div><nav class="main-menu navbar"><ul>{_MENU}</ul></nav></header>'
    f'<main id="main"><article class="post entry" data-label="content"><div class="entry-content article-body"><h1>Title of it</h1><p>{_WORDS}</p><p>{_SHORT}</p><h2>More</h2><p>{_WORDS * 2}</p><blockquote>{_WORDS}</blockquote><ul><li>{_SHORT}</li><li>{_WORDS}</li></ul></div></article></main>'
    f'<aside class="sidebar widget-area"><div class="widget related recommended"><h3>Related</h3><ul>{_MENU}</ul></div><div class="newsletter subscribe signup"><form><p>{_SHORT}</p></form></div></aside>'
    f'<section id="comments" class="comments comment-list reader"><h3>Comments</h3><div class="comment reply"><p>{_WORDS}</p></div><div class="comment"><p>{_SHORT}</p></div></section>'
    f'<footer class="site-footer" id="footer"><p>Copyright {_SHORT}</p><div class="social share"><ul>{_MENU}</ul></div></footer></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><div class="cookie-notice banner consent gdpr"><p>We use cookies. {_SHORT}</p></div><div class="ad advert advertisement">{_WORDS}</div><article data-label="content"><h1>Title of it</h1><p>{_WORDS}</p><p>{_WORDS * 3}</p><p>{_SHORT}</p></article><div class="ads sponsored promo"><p>{_SHORT}</p></div><footer>{_SHORT}</footer></body>',
    f'<body><div id="header" class="top"><div class="breadcrumb">{_SHORT}</div><div class="menu nav"><a href="/">home</a> <a href="/b">news</a></div></div><div id="container" class="wrapper"><div id="content" class="content story text" data-label="content"><h1>Title of it</h1><p>{_WORDS}</p><div class="section"><p>{_WORDS}</p><p>{_SHORT}</p><pre>{_SHORT}</pre></div><table><tr><td>{_SHORT}</td><td>{_WORDS}</td></tr></table></div><div id="sidebar" class="side right rail"><h3>Popular</h3><p>{_SHORT}</p><ul>{_MENU}</ul></div></div><div id="disqus_thread" class="responses discussion"><ol><li><p>{_WORDS}</p></li></ol></div><div id="bottom" class="legal copyright">{_SHORT}</div></body>',
    f'<body><header><h2>Site</h2><form class="search"><p>{_SHORT}</p></form></header><main data-label="content"><section><h1>Title of it</h1><p>{_WORDS * 2}</p></section><section><h2>Part</h2><p>{_WORDS}</p><dl><dt>{_SHORT}</dt><dd>{_WORDS}</dd></dl><figure><figcaption>{_SHORT}</figcaption></figure></section></main><div class="popup modal overlay notice alert"><p>{_WORDS}</p></div><form class="contact login" id="respond"><p>{_SHORT}</p><fieldset><p>{_WORDS}</p></fieldset></form><footer><nav><ul>{_MENU}</ul></nav><p>{_WORDS}</p></footer></body>',
    f'<body><div class="page"><div class="article post-body" data-label="content"><p>{_WORDS}</p><p>{_WORDS}</p><h3>Point</h3><p>{_SHORT}</p><ol><li>{_WORDS}</li></ol></div><div class="share social tags meta"><p>{_SHORT}</p></div><div class="author bio"><p>{_SHORT}</p></div><div class="pagination pager"><a href="/2">next</a></div><div class="comments-area comment"><div class="comment-body"><p>{_WORDS * 2}</p></div></div></div><aside><p>{_WORDS}</p></aside><div class="sponsor banner ad"><div>{_WORDS}</div></div><div class="disclaimer notice"><p>{_WORDS}</p></div></body>',
    f'<body><nav><div><p>{_SHORT}</p></div></nav><article data-label="content"><p>{_WORDS}</p><p>{_SHORT}</p><ul><li>{_WORDS}</li></ul><div><p>{_WORDS}</p></div></article><aside><div><p>{_WORDS * 2}</p><p>{_SHORT}</p></div><section><h3>{_SHORT}</h3><p>{_WORDS}</p></section></aside><form><div><p>{_WORDS}</p></div><fieldset><div><p>{_SHORT}</p></div></fieldset></form><section class="comments"><ol><li><div><p>{_WORDS}</p><p>{_WORDS}</p></div></li><li><p>{_SHORT}</p></li></ol></section><footer><div><p>{_WORDS}</p></div></footer></body>',
    f'<body><header><div><h1>Site</h1><p>{_WORDS}</p></div></header><div class="cookie"><div><p>{_WORDS}</p><p>{_SHORT}</p></div></div><div class="main"><article data-label="content"><h1>Title of it</h1><div><p>{_WORDS}</p><p>{_WORDS}</p><p>{_SHORT}</p></div></article><aside class="sidebar"><ul><li>{_WORDS}</li><li><p>{_SHORT}</p></li></ul><p>{_WORDS}</p></aside></div><div class="newsletter"><form><p>{_WORDS}</p><div>{_SHORT}</div></form></div><div id="comments"><ul><li><p>{_WORDS}</p></li><li><div>{_WORDS}</div></li></ul></div></body>',
    f'<body data-label="content"><h1>Title of it</h1><p>{_WORDS}</p><p>{_WORDS * 2}</p><ul><li>{_SHORT}</li><li>{_WORDS}</li></ul><p>{_SHORT}</p></body>',
    f'<body data-label="content"><p>{_WORDS}</p><p>{_SHORT}</p></body>',
    f'<body data-label="content">{_WORDS * 3}<br>{_WORDS}<b>{_SHORT}</b></body>',
    f'<body data-label="content">{_WORDS * 5}</body>',
    f'<body data-label="content"><nav data-label="no"><ul>{_MENU}</ul></nav><h1>Title of it</h1><p>{_WORDS * 2}</p><p>{_WORDS}</p><div class="ad" data-label="no">{_SHORT}</div><p>{_SHORT}</p><footer data-label="no"><p>{_SHORT}</p></footer></body>',
    f'<body data-label="content"><div class="menu" data-label="no"><a href="/">home</a> <a href="/b">news</a></div>{_WORDS * 2}<p>{_WORDS}</p><div class="comments" data-label="no"><p>{_WORDS}</p></div></body>',
    f'<body><div id="main" data-label="content"><p>{_WORDS}</p><p>{_WORDS * 2}</p></div><aside><div><p>{_WORDS}</p><p>{_WORDS}</p></div></aside><footer><div><p>{_WORDS}</p><p>{_SHORT}</p></div></footer></body>',
    f'<body><nav><div><ul>{_MENU}</ul><p>{_SHORT}</p></div></nav><div data-label="content"><h1>Title of it</h1><p>{_WORDS * 2}</p><p>{_WORDS}</p></div><aside><div><h3>{_SHORT}</h3><p>{_WORDS}</p><div><p>{_WORDS}</p></div></div></aside><section class="comments"><div><p>{_WORDS}</p></div><div><p>{_SHORT}</p><p>{_WORDS}</p></div></section></body>',
    f'<body><header><div><p>{_WORDS}</p></div></header><div class="story" data-label="content"><div><p>{_WORDS}</p><p>{_WORDS}</p></div></div><form><div><p>{_WORDS}</p><p>{_WORDS}</p></div></form><div class="sidebar"><div><p>{_WORDS}</p></div></div><div class="ad"><div><p>{_WORDS}</p></div></div></body>',
    f'<body><nav class="nav"><ul>{_MENU}</ul></nav><article data-label="content"><h1>Title of it</h1><p>{_WORDS} <a class="link external" href="/x">{_SHORT}</a> <span class="highlight term">river</span> {_SHORT}</p><p>{_WORDS} <a class="ref" href="/y">rain</a> <em class="stress">month</em></p><ul><li><a href="/1">{_WORDS}</a></li><li><a href="/2">{_WORDS}</a></li></ul><p><a href="/3">{_WORDS}</a></p><p>{_WORDS} <span class="ad advert sponsored" data-label="no">{_SHORT}</span></p><span class="ad promo" data-label="no">{_SHORT}</span></article><footer>{_SHORT}</footer></body>',
    f'<body><article data-label="content"><p>{_WORDS}</p><div hidden data-label="no">{_WORDS}</div><p>{_WORDS}</p><p style="display:none" data-label="no">{_SHORT}</p><div aria-hidden="true" data-label="no"><p>{_WORDS}</p></div><p>{_SHORT} <span hidden data-label="no">{_SHORT}</span></p><ol><li><a href="/1">{_SHORT}</a></li><li><a href="/2">{_SHORT} {_SHORT}</a></li></ol><p>{_WORDS}</p></article><div class="menu"><ul>{_MENU}</ul></div></body>',
    f'<body><div class="menu side"><a class="item link" href="/">home</a> <a class="item link" href="/b">news</a> <span class="badge label">new</span></div><main data-label="content"><p>{_WORDS} <a id="fn" href="/z">{_SHORT}</a></p><p><strong class="lead">{_WORDS}</strong></p><ul><li><a href="/1">{_WORDS}</a></li><li><a class="source" href="/2">{_SHORT}</a></li></ul></main><aside><ul><li><a class="item" href="/q">{_SHORT}</a></li></ul></aside></body>',
)
