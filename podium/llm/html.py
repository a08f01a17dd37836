"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  A block is described by its own
word count and link density, by those of its neighbours, and by what its
containers are called; a decision tree, grown here on a small labelled table of
pages, tells article text from the rest.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|object|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-z][^>]*>"
    r"|<[!?][^>]*>",
    re.I | re.S,
)
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that a new one of the group ends, as far as the tags they may lie in.
_ENDED_BY = {
    **{t: (frozenset({"p"}), frozenset()) for t in _BREAKS - {"html", "body"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    **{t: (frozenset({"dt", "dd", "p"}), frozenset({"dl"})) for t in ("dt", "dd")},
    **{t: (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})) for t in ("td", "th")},
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
}
_OUTSIDE = frozenset("aside dialog fieldset footer head menu nav title".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words that class names, ids and roles are made of.
_COMMENTS = frozenset("comment comments disqus replies reply respond discussion responses".split())
_NOISE = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social follow related recommended recommendations "
    "newsletter subscribe subscription signup login search footer header masthead topbar toolbar pager pagination tags legal copyright skip contentinfo complementary dialog".split()
)
_CONTENT = frozenset("article content contents post posts entry story main body text".split())
#: A name with one of these says how the page is laid out, not what the element is.
_LAYOUT = frozenset("no with without has have is layout wrapper wrap wrappers container containers page site grid row rows col column columns left right full width".split())

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "outside", "noise", "article", "content", "paragraph", "title", "heading", "item", "header")


@lru_cache(maxsize=4096)
def _meaning(names: str) -> str:
    """``comments``, ``noise``, ``content`` or nothing, from an element's class names, id and role.

    A name of content words alone outweighs other names of the same element.
    """
    found = set()
    for name in names.split():
        parts = {p.lower() for p in _PART.findall(name)}
        if parts & _LAYOUT:
            continue
        if parts & _NOISE:
            found.add("comments" if parts & _COMMENTS else "noise")
        elif parts and parts & _CONTENT:
            found.add("content")
    if "content" in found:
        return "content"
    return "comments" if "comments" in found else "noise" if found else ""


class _Container:
    """An element that blocks lie in."""

    __slots__ = ("tag", "above", "meaning", "hidden", "main", "article", "h1", "blocks", "words", "linked")

    def __init__(self, tag: str, above: "_Container | None", attributes: str) -> None:
        self.tag, self.above, self.hidden = tag, above, False
        self.main = self.article = self.h1 = False
        self.blocks = self.words = self.linked = 0
        names = []
        if attributes and tag not in ("html", "body"):
            for kind, *values in _ATTRIBUTE.findall(attributes):
                kind, value = kind.lower(), "".join(values)
                if kind == "style":
                    self.hidden |= bool(_HIDDEN.search(value))
                elif kind == "hidden" or kind == "aria-hidden":
                    self.hidden |= value.lower() != "false" and (kind == "hidden" or value.lower() == "true")
                else:
                    names.append(value)
        self.meaning = _meaning(" ".join(names)) if names else ""

    def chain(self):
        at = self
        while at is not None:
            yield at
            at = at.above

    def outside(self, plain: float) -> bool:
        """Whether the element's tag puts it outside the article; a form around the article does not."""
        return self.hidden or self.tag in _OUTSIDE or (self.tag == "form" and not self.h1 and not self.holds(plain))

    def noise(self, plain: float) -> bool:
        return self.meaning == "comments" or (self.meaning == "noise" and not self.holds(plain))

    def holds(self, plain: float) -> bool:
        """Whether the element is the page's frame, whatever it is called: the article lies in it, or most plain text."""
        return self.main or (self.article and self.h1) or (self.blocks > 3 and self.words - self.linked > max(100, 0.5 * plain))


def blocks(html: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of each block with text, in page order.

    Character references are decoded, white space is one space, tags within a
    block leave nothing; a line break is white space.
    """
    html = html or ""
    found: list[tuple[str, int, int, _Container]] = []
    inner = _Container("html", None, "")
    text: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        nonlocal text, linked
        words = unescape("".join(text)).split() if text else []
        if words:
            n_links = min(len(words), len(unescape("".join(linked)).split())) if linked else 0
            found.append((" ".join(words), len(words), n_links, inner))
            for c in inner.chain():
                c.blocks, c.words, c.linked = c.blocks + 1, c.words + len(words), c.linked + n_links
                c.h1 |= inner.tag == "h1"
        text, linked = [], []

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in ("select", "button", "textarea", "iframe", "object"):
                text.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1
            if linked:
                linked.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag in _BREAKS:
            flush()
            if m[2]:
                for c in inner.chain():
                    if c.tag == tag and c.above is not None:
                        inner = c.above
                        break
                continue
            ends, within = _ENDED_BY.get(tag, (frozenset(), frozenset()))
            if tag == "body":
                ends = frozenset({"head", "title"})
            last = None
            for c in inner.chain():
                if c.tag in within or c.above is None:
                    break
                if c.tag in ends:
                    last = c
                elif not within and c.tag not in _HEADINGS:
                    break
            if last is not None:
                inner = last.above
            if tag != "hr":
                inner = _Container(tag, inner, m[4])
                if tag in ("main", "article") and inner.meaning not in ("noise", "comments"):
                    for c in inner.above.chain():
                        c.main |= tag == "main"
                        c.article |= tag == "article"
    if at < len(html):
        text.append(html[at:])
    flush()
    plain = float(sum(n - k for _, n, k, _ in found))
    out: list[tuple[str, list[float]]] = []
    states: dict[int, list[float]] = {}
    for words, n, n_links, c in found:
        state = states.get(id(c))
        if state is None:
            up = list(c.chain())
            tags = [x.tag for x in up]
            inside = "article" in tags or "main" in tags
            state = states[id(c)] = [
                float(any(x.outside(plain) for x in up)), float(any(x.noise(plain) for x in up)), float(inside), float(any(x.meaning == "content" for x in up)),
                float(c.tag in ("p", "pre", "blockquote", "dd")), float(c.tag == "h1"), float(c.tag in _HEADINGS), float(c.tag in ("li", "td", "th", "dt", "option")), float("header" in tags and not inside),
            ]
        out.append((words, [float(n), n_links / n, 0.0, 0.0, 0.0, 0.0, *state]))
    for i, (_, f) in enumerate(out):
        if i:
            f[2], f[3] = out[i - 1][1][0], out[i - 1][1][1]
        if i + 1 < len(out):
            f[4], f[5] = out[i + 1][1][0], out[i + 1][1][1]
    return out


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _links(*sizes: int) -> str:
    return "".join(f"<li><a href=1>{_w(n)}</a></li>" for n in sizes)


def _labelled() -> list[tuple[str, str]]:
    """The labelled table: pages, and for each of their blocks 1 if it is article text.

    Titles and paragraphs are of all lengths and stand next to anything, so that
    lengths alone tell nothing where the containers do.
    """
    table = []
    titles, bodies = (1, 2, 3, 9, 30), ((1,), (2, 1), (300, 5, 90), (40, 700, 1, 1), (4, 4, 30, 1200, 1, 90), (12, 250))
    for i, title in enumerate(titles):
        for j, body in enumerate(bodies):
            a, b = (1, 3, 20, 120, 400)[(i + j) % 5], (2, 9, 60, 300)[(i * 2 + j) % 4]
            text = f"<h1>{_w(title)}</h1>" + "".join(f"<p>{_w(n)}</p>" for n in body)
            marks = "1" * (len(body) + 1)
            menu, foot = f"<nav><ul>{_links(a % 7 + 1, b % 5 + 1)}</ul></nav>", f"<footer>{_w(b)}</footer>"
            table += [
                # marked up by meaning
                (f"<head><title>{_w(title)}</title></head><body>{menu}<article>{text}</article>{foot}", "000" + marks + "0"),
                (f"<header><p>{_w(a)}</p></header><main>{text}</main><aside><h3>{_w(title)}</h3><p>{_w(b)}</p></aside>", "0" + marks + "00"),
                (f"<article>{text}<p><a href=1>{_w(b)}</a></p><footer>{_w(a)}</footer></article><form><p>{_w(b)}</p></form>", marks + "100"),
                (f"<article><header>{text}</header></article><section class=comments><p>{_w(a)}</p><p>{_w(b)}</p></section>", marks + "00"),
                (f"<article><ul><li>{_w(a)}</li><li>{_w(b)}</li></ul>{text}</article><footer><a href=1>{_w(a)}</a> <a href=2>{_w(b)}</a></footer>", "11" + marks + "0"),
                (f"{menu}<article>{text}<h2>{_w(title)}</h2><ul>{_links(a % 7 + 1, b % 5 + 1, 4)}</ul><p>{_w(b)}</p></article>", "00"[: menu.count("<li>")] + marks + "11111"),
                # by names
                (f"<div class=ad>{_w(a)}</div><div id=main-content>{text}</div><div class=comment-list><p>{_w(b)}</p><p>{_w(a)}</p></div>", "0" + marks + "00"),
                (f"<p class=cookie-notice>{_w(b)}</p><div class='post no-sidebar'>{text}</div><div id=sidebar><p>{_w(a)}</p><ul>{_links(2, 5)}</ul></div>", "0" + marks + "000"),
                # by links and neighbours alone
                (f"<ul>{_links(a % 9 + 1, b % 9 + 1)}</ul>{text}<div><a href=1>{_w(b)}</a> <a href=2>{_w(a)}</a></div>", "00" + marks + "0"),
                (f"<table><tr><td><a href=1>{_w(a)}</a><br><a href=2>{_w(b)}</a></td><td>{text}</td></tr></table>", "0" + marks),
                (f"<div>{text}</div><h3>{_w(title)}</h3><ul>{_links(a % 9 + 1, b % 7 + 1, 2)}</ul>", marks + "0000"),
                (f"<div><h1>{_w(title)}</h1><div><a href=1>{_w(a % 7 + 1)}</a></div><p>{_w(b)}</p><p>{_w(a)}</p></div>", "1011"),
                (text, marks),
            ]
    for n in (1, 3, 40, 900):
        table += [(_w(n), "1"), (f"<p>{_w(n)}</p>", "1"), (f"<div>{_w(n)}</div><div>{_w(3)}</div>", "11"), (f"<h1>{_w(n)}</h1><p>{_w(2)}</p><ul><li>{_w(n)}</li><li>{_w(4)}</li></ul>", "1111"), (f"<table><tr><td>{_w(n)}</td><td>{_w(2)}</td></tr></table>", "11")]
        table += [(f"<div>{_w(n)} {_w(60)} <a href=1>{_w(8)}</a></div><div><a href=2>{_w(2)}</a></div>", "10")]
    return table


def _gini(n: int, k: int) -> float:
    return 2 * k * (n - k) / n if n else 0.0


def grow(rows: list[list[float]], labels: list[int], depth: int = 8, least: int = 2):
    """A decision tree: 0 or 1, or (feature, threshold, tree up to it, tree above)."""
    n, k = len(labels), sum(labels)
    if not depth or k in (0, n):
        return int(2 * k > n)
    best = None
    for f in reversed(range(len(FEATURES))):  # of equal splits, one by where the block stands
        order = sorted(range(n), key=lambda i: rows[i][f])
        left = 0
        for at, i in enumerate(order[:-1], 1):
            left += labels[i]
            low, high = rows[i][f], rows[order[at]][f]
            if low < high and least <= at <= n - least:
                cost = _gini(at, left) + _gini(n - at, k - left)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, (low + high) / 2)
    if best is None or best[0] >= _gini(n, k) - 1e-12:
        return int(2 * k > n)
    _, f, t = best
    sides = [[i for i in range(n) if (rows[i][f] > t) == above] for above in (False, True)]
    return (f, t, *(grow([rows[i] for i in s], [labels[i] for i in s], depth - 1, least) for s in sides))


@lru_cache(maxsize=1)
def tree():
    """The tree of the labelled table."""
    rows, labels = [], []
    for html, marks in _labelled():
        found = blocks(html)
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks but {len(marks)} labels: {[t[:20] for t, _ in found]}")
        rows += [f for _, f in found]
        labels += map(int, marks)
    return grow(rows, labels)


def is_text(features: list[float], node) -> bool:
    while not isinstance(node, int):
        node = node[3] if features[node[0]] > node[1] else node[2]
    return bool(node)


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    node = tree()
    return " ".join(t for t, f in blocks(html) if is_text(f, node))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page's whole html.

    Null or empty html, or html without article text, gives an empty text; null
    ids and urls and repeated rows are kept; an empty table gives no rows.
    Other columns are not read.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def each(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.mapInArrow(each, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
