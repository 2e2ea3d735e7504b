"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags.  Each stretch of text belongs to a block, and each block to a root-to-leaf path of
block tags with their classes and ids.  For every path of the page the text length and the punctuation of all its blocks
are added up; the ratios text per block and punctuation per block are smoothed along the order in which paths first
occur, bent to shares of 1 (a paragraph of 2,000 characters is hardly more prose than one of 1,000) and fused by
multiplication, text twice.  Paths whose fused ratio reaches BAR of the page's best are content; those of parts that say
they are something else must be prose by their own ratio too (PROSE, STRONG_PROSE), so that no footer beats a tiny article.

What an element says of itself is a prior, bounded on both sides, that the fused ratio is multiplied by: a marked article
or main part MARKED, a menu, header, form or pager WEAK, as its text tells it from an article anyway, and a part that may
well be prose but isn't the article's (reader comments, notices, adverts, sidebars, footers, hidden parts) STRONG.  A name
with words that have nothing to do with layout ("comments-on-method", "related-work") is WEAK at most.  So names alone
take nothing out that has an article's ratios, save the prose that only its name tells apart.

The innermost element that holds HOLDS of the content's text is the article.  What stands in it belongs to it, short
headings, lists, tables and quotes too, except for parts with a name of their own, which stay only where at least half of
their text is content by its ratio.  If that element lies in a marked article, all of the marked article counts, so that
a short lead in a part of its own isn't lost.

Inline tags don't end a block; ``<br>`` is white space; an inline element that names itself an advert or is hidden counts
as a path of its own.  Character references are decoded, white space (including no-break spaces) inside a block becomes
one space, blocks are trimmed, empty ones fall away, and the others are joined by ``\n`` in page order.  A null or
empty page, or one without text, gives the empty string.  Work and memory grow in proportion to the page, however deep
it nests.  Each input row gives one row; equal rows give equal rows; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import read_table, ship_code

# HTML's own element classes.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "annotation math menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select canvas".split())
SWALLOWS = frozenset("script style textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Elements and names that say that a part is not the article.
WEAK_TAGS = frozenset("nav form button menu".split())
STRONG_TAGS = frozenset("footer aside dialog".split())
WEAK_ROLES = frozenset("navigation banner search form menu menubar toolbar".split())
STRONG_ROLES = frozenset("contentinfo complementary dialog alertdialog alert".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored taboola outbrain hidden".split())
STRONG_NAMES = ADVERTS | frozenset(
    "comment commentlist comments consent cookie cookiebar cookies copyright disclaimer disqus footer gdpr modal newsletter notice "
    "notices notification overlay paywall popup promo promoted promotion replies reply respond sidebar signup skyscraper subscribe "
    "subscription".split()
)
WEAK_NAMES = frozenset(
    "banner bottombar breadcrumb breadcrumbs header login masthead menu menus nav navbar navigation pager pagination recommendations "
    "recommended related share sharing skip social teaser teasers toolbar topbar widget widgets".split()
)
STRONG_BEGINNINGS = ("advert", "commentbox", "cookie", "newsletter", "noticebar", "sidebar", "sponsor")
#: Words that say where a part is or what it is made of, beside the name of what it is.
LAYOUT_WORDS = frozenset(
    "a all app area article articles author b bar block body bottom box btn button card col column container content desktop entry fixed "
    "footer form g global grid group head header hero holder inner item items js layer left link links list lists local main mobile module "
    "more my new news outer page panel part post posts primary right row secondary section shell side site slot small social sticky "
    "sub tab text the thread title top unit user users view wrap wrapper your zone".split()
)
KNOWN_NAMES = STRONG_NAMES | WEAK_NAMES | LAYOUT_WORDS
#: Names of an aside that belongs to the article.
QUOTES = frozenset("callout footnote footnotes note notes pullquote quote".split())
#: Words with which a name speaks of the layout around such a part: ``has-sidebar`` isn't a sidebar.
LAYOUT = frozenset("has layout no with".split())
#: Names that speak of a part's form rather than its matter: they say nothing inside a marked article.
FORMS = frozenset("banner header masthead widget widgets".split())
MAIN_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S
)
#: For what follows a tag whose quotes don't close: there a quote is a character like others.
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>|<[!?][^>]*>", re.S)
_BEGIN = re.compile(r"<!--|<[!?/]?[a-zA-Z]|<[!?]")
#: One attribute: its name whole, and its value with the quotes that end it.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[^\w\s]")
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
#: Weight of a neighbouring path in the smoothing, and the share of the best ratio that a content path reaches.
NEIGHBOUR, BAR = 0.1, 0.22
#: Text and punctuation a block at which their ratios are half of what they can be.
HALF_TEXT, HALF_MARKS = 240.0, 3.0
#: What a part that says it isn't the article must reach without its prior: some 110 characters and a few marks a block,
#: or 250 where its name is a strong one.
PROSE, STRONG_PROSE = 0.06, 0.2
#: What the ratios of paths are multiplied by, and the least product of several of these.
MARKED, WEAK, STRONG, LEAST = 2.0, 0.5, 0.125, 0.0625
#: The share of the content's text that the article's element holds, and elements that are a part of a text only.
HOLDS = 0.9
LEAVES = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())


class _Open(NamedTuple):
    """An open element: its path, weight and holder (the element that isn't a leaf around its text), whether in a marked part, and the part with a name of its own."""

    tag: str
    path: int
    weight: float
    holder: int
    main: bool
    part: int


class Block(NamedTuple):
    """A block, or a stretch of one: pieces that share ``block`` are one block of the text."""

    block: int
    path: int
    weight: float
    holder: int
    part: int
    text: str


def _attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(rest):
        if key:
            out.setdefault(key.lower(), "".join(values))
    return out


def _weight(tag: str, had: dict[str, str], main: bool) -> float:
    """What an element says of itself; ``main`` says that it stands in a marked article."""
    if "hidden" in had or had.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(had.get("style", "")):
        return STRONG
    role = had.get("role", "").strip().lower()
    weight = 1.0
    if tag in WEAK_TAGS or role in WEAK_ROLES or tag == "header" and not main:
        weight = WEAK
    names = list(_named(had))
    if role in STRONG_ROLES or tag in STRONG_TAGS and not (tag == "aside" and any(x & QUOTES for x in names)):
        weight = STRONG
    for words in names:
        strong = words & STRONG_NAMES or any(x.startswith(STRONG_BEGINNINGS) for x in words)
        weak = words & WEAK_NAMES - (FORMS if main else frozenset())
        if strong:
            named = any(not (x.startswith(STRONG_BEGINNINGS) or x.isdigit()) for x in words - KNOWN_NAMES)
            weight = min(weight, WEAK if named else STRONG)
        elif weak:
            weight = min(weight, WEAK)
    return weight


def _named(had: dict[str, str]) -> Iterator[set[str]]:
    """The words of each class and id that doesn't speak of the layout."""
    for name in f"{had.get('class', '')} {had.get('id', '')}".split():
        words = {x.lower() for x in _NAME.findall(name)}
        if not words & LAYOUT:
            yield words


def _is_advert(had: dict[str, str]) -> bool:
    """Whether an inline element is an advert or hidden."""
    return "hidden" in had or bool(_UNSEEN.search(had.get("style", ""))) or any(x & ADVERTS for x in _named(had))


class Page:
    """The blocks of a page and how its elements lie in one another (``around``: each one's holder before it; ``marked``:
    whether it is marked as the article)."""

    def __init__(self, page: str) -> None:
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.around = [0]
        self.marked = [False]
        self._read(page)

    def _path(self, before: int, name: str) -> int:
        return self.paths.setdefault((before, name), len(self.paths) + 1)

    def _read(self, page: str) -> None:
        stack = [_Open("", 0, 1.0, 0, False, 0)]
        open_tags: Counter[str] = Counter()
        held: list[str] = []
        inline = ("", "")  # the tag and name of an open inline advert, and how many such tags are open
        depth = 0
        token, last = _TOKEN, page.rfind(">")
        number, parts, block = 0, 0, 0
        endless: set[str] = set()
        at, end = 0, len(page)

        def stretch() -> None:
            if held:
                text = _SPACE.sub(" ", html.unescape("".join(held)))
                held.clear()
                if text.strip():
                    top = stack[-1]
                    if depth:
                        self.blocks.append(Block(block, self._path(top.path, inline[1]), STRONG, top.holder, -1, text))
                    else:
                        self.blocks.append(Block(block, top.path, top.weight, top.holder, top.part, text))
                elif text:
                    held.append(" ")

        def close_block() -> None:
            nonlocal block, depth
            stretch()
            held.clear()
            block, depth = block + 1, 0

        def drop(tags, stop) -> None:
            """End open elements down to the last of ``tags`` that no element of ``stop`` hides."""
            if not any(open_tags[x] for x in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    close_block()
                    open_tags.subtract(x.tag for x in stack[k:])
                    del stack[k:]
                    return
                if stack[k].tag in stop:
                    return

        while at < end:
            begin = _BEGIN.search(page, at)
            if not begin or begin.start() > last:
                held.append(page[at:])
                break
            found = token.match(page, begin.start())
            if not found and token is _TOKEN and begin[0][-1].isalpha():
                token = _UNQUOTED
                found = token.match(page, begin.start())
            if not found:
                held.append(page[at : begin.start() + 1])
                at = begin.start() + 1
                continue
            if found.start() > at:
                held.append(page[at : found.start()])
            at = found.end()
            if found["tag"] is None:
                continue
            tag = found["tag"].lower()
            if found["close"]:
                if depth and tag == inline[0]:
                    if depth == 1:
                        stretch()
                    depth -= 1
                elif tag == "p" or tag not in INLINE and tag not in VOID:
                    drop((tag,), () if tag != "p" else ("article", "section", "div", "td"))
                continue
            if tag == "br":
                held.append(" ")
                continue
            rest = found["rest"]
            if tag == "svg" and rest.rstrip().endswith("/"):  # closed by itself
                close_block()
                continue
            if tag in RAW:
                close = None if tag in endless else _ENDS[tag].search(page, at)
                if not close:
                    endless.add(tag)
                if close or tag in SWALLOWS:
                    close_block()
                    at = close.end() if close else end
                # Others that never end are a slip: what follows is the page.
                continue
            if tag in INLINE:
                if tag in VOID or rest.rstrip().endswith("/"):
                    continue
                if depth:
                    depth += tag == inline[0]
                elif rest and not rest.isspace() and _is_advert(had := _attributes(rest)):
                    stretch()
                    inline, depth = (tag, f"{tag}.{had.get('class', '')}"), 1
                continue
            close_block()
            if tag in CLOSES_P:
                drop(("p",), ("button", "table", "td", "th", "article", "section", "div", "aside", "li"))
            if tag in SIBLINGS:
                drop(*SIBLINGS[tag])
            if tag in VOID:
                continue
            top = stack[-1]
            had = _attributes(rest) if rest and not rest.isspace() else {}
            marked = tag in MAIN_TAGS or "main" in had.get("role", "").lower().split()
            weight = 1.0 if tag in ("html", "body") else _weight(tag, had, top.main)
            part = top.part
            if weight < 1:
                parts += 1
                part = parts
            if marked and not top.main:
                weight *= MARKED
            holder = top.holder
            if tag not in LEAVES:
                number += 1
                self.around.append(holder)
                self.marked.append(marked)
                holder = number
            path = self._path(top.path, f"{tag}.{had.get('class', '')}#{had.get('id', '')}")
            stack.append(_Open(tag, path, max(top.weight * weight, LEAST), holder, top.main or marked, part))
            open_tags[tag] += 1
        close_block()


def ratios(blocks: list[Block]) -> dict[int, float]:
    """The smoothed and fused ratio of every path, in page order."""
    totals: dict[int, list[float]] = {}
    for x in blocks:
        total = totals.setdefault(x.path, [0.0, 0.0, 0.0, x.weight])
        total[0] += len(x.text.strip())
        total[1] += len(_PUNCTUATION.findall(x.text))
        total[2] += 1
    length, marks, n, weight = np.array(list(totals.values())).T
    fused = _bent(_smooth(length / n), HALF_TEXT) ** 2 * _bent(_smooth(marks / n + 1), HALF_MARKS) * weight
    return dict(zip(totals, fused.tolist(), strict=True))


def _bent(x: np.ndarray, half: float) -> np.ndarray:
    return x / (x + half)


def _smooth(x: np.ndarray) -> np.ndarray:
    """Each value averaged with its neighbours on either side."""
    total, share = x.copy(), np.ones(len(x))
    total[1:] += NEIGHBOUR * x[:-1]
    total[:-1] += NEIGHBOUR * x[1:]
    share[1:] += NEIGHBOUR
    share[:-1] += NEIGHBOUR
    return total / share


def content(page: str) -> str:
    """The main text of one page."""
    read = Page(page)
    if not read.blocks:
        return ""
    fused = ratios(read.blocks)
    bar = BAR * max(fused.values())
    chosen = [fused[x.path] >= (bar if x.part == 0 else max(bar, x.weight * (PROSE if x.weight >= WEAK else STRONG_PROSE))) for x in read.blocks]
    inside = _inside_article(read, chosen)
    total, good = Counter(), Counter()
    for x, c in zip(read.blocks, chosen, strict=True):
        total[x.part] += len(x.text)
        good[x.part] += len(x.text) * c
    lines: dict[int, list[str]] = {}
    for x, c in zip(read.blocks, chosen, strict=True):
        own = c if x.part < 0 else x.part == 0 or 2 * good[x.part] >= total[x.part]
        if own and (c or inside[x.holder]):
            lines.setdefault(x.block, []).append(x.text)
    return "\n".join(text for x in lines.values() if (text := _SPACE.sub(" ", "".join(x)).strip()))


def _inside_article(read: Page, chosen: list[bool]) -> list[bool]:
    """Which elements are the innermost one that holds most of the content, or stand in it."""
    held = [0] * len(read.around)
    for x, c in zip(read.blocks, chosen, strict=True):
        held[x.holder] += len(x.text) * c
    for e in range(len(held) - 1, 0, -1):  # those further in have higher numbers
        held[read.around[e]] += held[e]
    # Elements with more than half of the text lie one in another.
    article = max(e for e, n in enumerate(held) if n >= HOLDS * held[0])
    around = article
    while around:
        article = around if read.marked[around] else article
        around = read.around[around]
    inside = [False] * len(held)
    for e, before in enumerate(read.around):
        inside[e] = e == article or e > article and inside[before]
    return inside


def extract(pages: DataFrame, html_: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` (main text) and ``n_chars`` (its code points)."""
    ship_code(pages.sparkSession)
    slim = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [content(x or "") for x in batch.column("html").to_pylist()]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string())], names=[*batch.schema.names[: len(keep)], "text"]
            )

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    out = slim.mapInArrow(run, f"{kinds}text string")
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text",
        F.length("text").cast("long").alias("n_chars"),
    )


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
