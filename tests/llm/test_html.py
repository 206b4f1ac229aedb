from __future__ import annotations

from collections import Counter

from postloom.llm import html_text as H


def model():
    counts: Counter = Counter()
    for page in H.LABELLED:
        H.count_page(page, counts, own=True)
    return H.fitted(counts)


def test_labelled_pages_are_told_apart():
    m, right, total = model(), 0, 0
    for page in H.LABELLED:
        nodes, _ = H.parse(page, own=True)
        H.add_shape(nodes)
        want, got = H.labels(nodes), m.marginals(nodes)
        right += sum((g > 0.5) == bool(w) for g, w in zip(got[1:], want[1:], strict=True))
        total += len(nodes) - 1
    assert right / total > 0.95


def test_marginals_equal_enumeration():
    import itertools
    import math

    m = model()
    nodes, _ = H.parse("<div class=content><p>one two three</p><ul class=menu><li>x</li></ul></div><footer>c</footer>")
    H.add_shape(nodes)
    got, n = m.marginals(nodes), len(nodes)
    total, on = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n - 1):
        own = (0, *labels)
        w = math.exp(sum(max(-12, min(12, sum(m.weight.get(f, 0) for f in nodes[i].features))) * own[i] + m.pair[m.knows(nodes[i])][own[nodes[i].parent]][own[i]] for i in range(1, n)))
        total += w
        for i in range(1, n):
            on[i] += w * own[i]
    assert all(abs(got[i] - on[i] / total) < 1e-9 for i in range(1, n))


def test_text_of_a_page(spark):
    body = " ".join(f"word{i}" for i in range(60))
    page = f'<html><head><title>No</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p>{body}<br>after\n\n the&nbsp;break<p>next <b>bold</b>er</p></article><script>var a = "</p>";</script><footer>&copy; foot</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", page.replace("word1 ", "word1 " * 20000))]
    out = {r["page_id"]: r for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == f"Head & line {body} after the break next bolder"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == out[3]["text"] == ""
    assert out[5]["text"].count("word1 ") == 20000
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_the_usual_frame():
    m = model()
    one, two = (" ".join(f"{a}{i}" for i in range(80)) for a in "wv")
    pages = [
        f"<body>{one}<p>{two}",
        f"<body><p>{one}</p><p>{two}</p></body>",
        f"{one}<br>{two}",
        f"<html><head><title>not this</title><p>{one}</p>{two}",
        f'<body><nav><ul><li><a href="/">menu</a></li></ul></nav><p>{one}</p><p>{two}</p><footer>foot</footer></body>',
        f"<body></div>{one}</section><p>{two}</p></div></body>",
        f"<p>{one}</p><script>unclosed( < here",
        f"<body><div><div><p>{one}</p><p>{two}</p></div></div>",
        f'<body><div id="main"><p>{one}</p></div><aside><p>{two}</p></aside></body>',
    ]
    for i, page in enumerate(pages):
        assert H.main_text(page, m) == (one if i in (6, 8) else f"{one} {two}"), page


def test_broken_pages_take_linear_time():
    import time

    m = model()
    for part in ("<a ", '<a "', "<div>", "</p><div>", "<!--", "<script>", "<", "<a b='", "</div>", "&lt;"):
        began = time.time()
        H.main_text("<body>" + part * (1_000_000 // len(part)), m)
        assert time.time() - began < 20, part


def test_repeats_and_clashing_columns(spark):
    page = "<body><p>" + " ".join(f"w{i}" for i in range(60)) + "</p></body>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, None, None, None)]
    out = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert sorted((r["page_id"] or 0, len(r["text"].split())) for r in out) == [(0, 0), (1, 60), (1, 60)] and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def _held_out():
    """(page, words of its article): layouts that the model never saw, with words of their own for every part."""
    def text(part, n, seen=[0]):  # noqa: B006
        seen[0] += n
        return " ".join(f"{part}{i}" for i in range(seen[0] - n, seen[0]))

    good, bad = (lambda n: text("good", n)), (lambda n: text("bad", n))
    menu = lambda: "".join(f'<li><a href="/{i}">{bad(1)}</a></li>' for i in range(8))
    yield f'<div class="kopf zz"><ul>{menu()}</ul></div><div class="xq-17"><h2>{good(5)}</h2><p>{good(60)}</p><p>{good(40)}</p></div><div class="fuss"><ul>{menu()}</ul></div>'
    yield f'<table><tr><td><ul>{menu()}</ul></td><td><h1>{good(4)}</h1><p>{good(70)}</p><p>{good(50)}</p></td></tr></table>'
    yield f'<nav><ul>{menu()}</ul></nav><main><p>{good(50)} <span class="advert">{bad(6)}</span> {good(20)}</p><span class="ad-slot">{bad(9)}</span><p>{good(30)}</p></main><footer>{bad(12)}</footer>'
    yield f'<article><p>{good(40)}</p><table><tr><td data-label="Price">{good(8)}</td><td data-label="no">{good(8)}</td></tr></table><p>{good(40)}</p></article><aside><p>{bad(30)}</p></aside>'
    yield f'<div id="wrap"><div id="lede"><p>{good(60)}</p><ul><li><a href="/s">{good(30)}</a></li><li><a href="/t">{good(30)}</a></li></ul></div><div class="comment-thread"><div><p>{bad(40)}</p></div></div></div>'
    yield f'<div role="navigation"><a href="/">{bad(1)}</a> <a href="/x">{bad(1)}</a></div><div role="main"><section><p>{good(80)}</p></section><section><p>{good(30)}</p><blockquote>{good(20)}</blockquote></section></div><div class="cookie-consent">{bad(25)}</div>'
    yield f'<main><h1>{good(5)}</h1><p>{good(90)}</p><div style="display: none">{bad(30)}</div><p hidden>{bad(10)}</p><p>{good(20)} <em class="q">{good(3)}</em> {good(4)}</p></main><form><p>{bad(10)}</p></form>'
    yield f'<header><h2>{bad(3)}</h2></header><div><div><div><p>{good(45)}</p><p>{good(45)}</p></div></div></div><section class="sponsored-links"><p>{bad(20)}</p></section>'


def test_layouts_that_the_model_never_saw():
    m, found, hit, there = model(), 0, 0, 0
    for page in _held_out():
        got, want = H.main_text(f"<html><body>{page}</body></html>", m).split(), [w for w in page.replace("<", " ").replace(">", " ").split() if w.startswith("good")]
        found, there = found + len(got), there + len(want)
        hit += sum(w.startswith("good") for w in got)
    assert hit / found > 0.95 and hit / there > 0.85, (hit, found, there)


def test_inline_parts_and_foreign_marks():
    m, w = model(), " ".join(f"w{i}" for i in range(80))
    got = lambda page: H.main_text(f"<body>{page}</body>", m)
    assert got(f'<article><p>{w}</p><span class="ad advert">BUY NOW</span><p>{w}</p></article>') == f"{w} {w}"
    assert got(f'<article><p>{w} <span class="zork">stays</span>here</p></article>') == f"{w} stayshere"
    assert got(f'<article><p><b class="x">{w}<p>{w}</article><span class=ad>BUY') == f"{w} {w}"
    assert got(f'<article><p>{w}</p><table><tr><td data-label="Price">9 euro {w}</td></tr></table></article>') == f"{w} 9 euro {w}"
    assert got(f'<article><p>{w}</p><ul><li><a href="/x">{w}</a></li></ul></article>') == f"{w} {w}"
    assert got(f'<article><p>{w}</p><div hidden>no</div><div style="display:none">no</div><p title="hidden">{w}</p></article>') == f"{w} {w}"


def test_training_sample_follows_the_rows(spark):
    """Equal or missing page_ids do not put all pages into the sample, or none."""
    page = "<body><article><p>" + " ".join(f"w{i}" for i in range(60)) + " {}</p></article></body>"
    rows = spark.createDataFrame([(None, "u", page.format(i)) for i in range(400)], "page_id long, url string, html string")
    assert H.trained(rows, 40).weight != H.fitted(_own_counts()).weight
    assert 400 == H.extracted(rows).filter("n_chars > 100").count()


def _own_counts():
    counts: Counter = Counter()
    for page in H.LABELLED:
        H.count_page(page, counts, own=True)
    return counts
