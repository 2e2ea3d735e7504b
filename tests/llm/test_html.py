"""HTML extraction: the ratios decide, names alone don't, and work grows with the page."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

import pyarrow.parquet as pq
import pytest

from leafmill.llm import html_text

STORY = "The river rose, and the town, low on its bank, waited. Nobody slept; nobody spoke of it, not even then."


def story(k, n=6):
    return [f"{STORY} Part {k}, line {i}, goes on." for i in range(n)]


def article(*parts):
    return "<article>" + "".join(f"<p>{x}</p>" if x[0] != "<" else x for x in parts) + "</article>"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<p>About the <a class="share">share buttons</a> study.</p>', "About the share buttons study."),
        ('<p>So <span class="ad">buy <span>inner</span> leak</span>it ends.</p>', "So it ends."),
        ('<p>So <span style="display: none">not <b>seen</b></span>it ends.</p>', "So it ends."),
        ("<p>So <span class='ad'>never closed</p>", "So"),
        ("<p>So <span class='ad'/>it ends.</p>", "So it ends."),
        ('<section class="related-work"><h2>Related work</h2>%s</section>' % "".join(f"<p>{x}</p>" for x in story(8)), "\n".join(["Related work", *story(8)])),
        ('<div class="related"><a href=a>Other story</a></div>', None),
        ('<div class="share">Share this on X</div>', None),
        ('<div class="ad">Buy now, pay later, and smile.</div>', None),
        ('<section id="comments">%s</section>' % "".join(f"<p>{x}</p>" for x in story(9)), None),
        ("<aside>Beside it, this.</aside>", None),
        ("<ul><li>One</li><li>Two</li></ul>", "One\nTwo"),
        ("<h2>Short</h2>", "Short"),
    ],
)
def test_parts_of_an_article(part, kept):
    got = html_text.content(f"<body><nav><a href=x>Home</a></nav>{article(*story(1), part, *story(2))}<footer>Us, (c)</footer></body>")
    assert got == "\n".join([*story(1), *([kept] if kept else []), *story(2)])


LINKS = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12))


def unnamed(k):
    """A page that names no part: links, a story, and a line of rights, all in plain elements."""
    inner = "".join(f"<p>{x}</p>" for x in story(k, 5))
    return f"<body><div><ul>{LINKS}</ul></div><div><div>{inner}</div></div><div><i>All rights</i></div></body>", "\n".join(story(k, 5))


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * (x & y).total() / max(1, x.total() + y.total())


def test_ratios_decide(monkeypatch, sf):
    pages = pq.read_table(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet")["html"].to_pylist()[:600]
    plain = [unnamed(k) for k in range(20)]
    assert [html_text.content(x) for x, _ in plain] == [x for _, x in plain]
    before = [html_text.content(x) for x in pages]
    ratios = html_text.ratios
    # The names' priors alone, with constant ratios, change most pages ...
    monkeypatch.setattr(html_text, "ratios", lambda blocks: {x.path: x.weight for x in blocks})
    after = [html_text.content(x) for x in pages]
    assert sum(a != b for a, b in zip(before, after, strict=True)) > len(pages) / 3
    assert all(html_text.content(x) != y for x, y in plain)
    # ... and the ratios alone, without any name, nearly give the same text.
    monkeypatch.setattr(html_text, "ratios", lambda blocks: ratios([x._replace(weight=1.0) for x in blocks]))
    after = [html_text.content(x) for x in pages]
    assert sum(map(f1, before, after)) / len(pages) >= 0.95


def test_priors_are_bounded():
    assert html_text.MARKED <= 4 and html_text.WEAK >= 1 / 4 and html_text.STRONG >= 1 / 8 and html_text.LEAST >= 1 / 16


def test_ratios_by_hand():
    read = html_text.Page("<div><h1>Ab</h1><p>One, two.</p><p>Three!</p><ul><li>x</li></ul></div>")
    # text a block 2, 7.5, 1; signs a block 0, 1.5, 0, and one more; a neighbour counts 0.1
    text = [(2 + 0.75) / 1.1, (7.5 + 0.2 + 0.1) / 1.2, (1 + 0.75) / 1.1]
    signs = [(1 + 0.25) / 1.1, (2.5 + 0.1 + 0.1) / 1.2, (1 + 0.25) / 1.1]
    want = [(a / (a + html_text.HALF_TEXT)) ** 2 * b / (b + html_text.HALF_MARKS) for a, b in zip(text, signs, strict=True)]
    assert list(html_text.ratios(read.blocks).values()) == pytest.approx(want)


PROSE = "".join(f"<p>{x}</p>" for x in story(7))


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (article(*story(1), f'<section id="comments-on-method"><h2>Comments on method</h2>{PROSE}</section>'), [*story(1), "Comments on method", *story(7)]),
        (article(*story(1), "<object data=x>", *story(2)), [*story(1), *story(2)]),
        (article(*story(1), "<svg viewBox=0>", *story(2)), [*story(1), *story(2)]),
        (article(*story(1), "<noscript>", *story(2)), [*story(1), *story(2)]),
        (article(*story(1), "<svg><text>No</text></svg>", "<object><p>No</p></object>", *story(2)), [*story(1), *story(2)]),
        ("<article><div><p>A short lead.</p></div><div>%s</div></article>" % PROSE, ["A short lead.", *story(7)]),
        ("<main><div class=a><p>A short lead.</p></div><div class=b>%s</div></main>" % PROSE, ["A short lead.", *story(7)]),
        (article(*story(1), '<aside class="pullquote"><p>Not even then.</p></aside>', *story(2)), [*story(1), "Not even then.", *story(2)]),
        (article(*story(1)) + f'<section class="comment-list">{PROSE}</section>', story(1)),
        (article(*story(1)) + f'<div id="cookie-notice">{PROSE}</div>', story(1)),
        (f"<div><div>{''.join(f'<p>{x}</p>' for x in story(1))}</div><div class=comments>{PROSE}</div></div>", story(1)),
        (article("word " * 400, "<p>" + "more " * 300 + "</p>") + "<footer>&copy; host &middot; All, every. One; right.</footer>", [("word " * 400).strip(), ("more " * 300).strip()]),
    ],
)
def test_nothing_of_the_article_is_lost(page, kept):
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(9))
    got = html_text.content(f"<body><nav><ul>{links}</ul></nav>{page}<footer>Us, (c) 2020.</footer></body>")
    assert got == "\n".join(kept)


@pytest.mark.parametrize("unit", ["<div>", "<div class=a>x", "<p>word, ", "<span class=ad>x", "<ul><li>y", "<table><tr><td>z", "</div>", "<a href='", "&amp;"])
def test_work_grows_with_the_page(unit):
    took = []
    for n in (5_000, 20_000):
        page = f"<article><p>{STORY}</p></article>" + unit * n
        tracemalloc.start()
        began = time.process_time()
        html_text.content(page)
        took.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert took[1][1] < 8 * took[0][1] and took[1][0] < 12 * took[0][0] + 1
    assert took[1][1] < 200 * 20_000 * max(5, len(unit))


def test_a_large_nested_page():
    rng = random.Random(3)
    page = "".join(rng.choice(("<div>", "<div class=b>", f"<p>{STORY}", "</div>")) for _ in range(60_000))
    assert len(page) > 1_500_000
    tracemalloc.start()
    assert len(html_text.content(page)) > 400_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000


def test_clashing_columns_and_repeats(spark):
    rows = [(k % 2, None if k == 3 else "u", x, "c", "c", "c", "c") for k, x in enumerate([article(*story(1)), None, "", article(*story(1)), "  "])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, k0 string, k1 string, n_chars string")
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    text = "\n".join(story(1))
    assert got == sorted([(0, "u", text, len(text)), (1, "u", "", 0), (0, "u", "", 0), (1, "", text, len(text)), (0, "u", "", 0)])
    wide = html_text.extract(df, keep=("page_id", "k0", "k1")).columns
    assert wide == ["page_id", "k0", "k1", "text", "n_chars"]
