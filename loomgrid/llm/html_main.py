"""Main text of web pages, by gradient-boosted trees over the nodes of the document tree.

Each element gets features of its own (tag, attribute tokens), of its subtree (text, link and tag density), of its
place (depth, ancestors) and of its siblings. Boosted trees estimate whether its subtree holds main text. The
choice is hierarchical: an element can be kept only if its parent is, and the most likely choice of that kind is
found by dynamic programming, so no kept text lies in a dropped region.

No labelled pages are at hand, so the trees are trained on pages that this module writes itself, from a grammar
of page layouts with many namings, in which it knows the main text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.boosting import Trees, boost

PAGES = 800
#: Pages whose elements are judged together.
TOGETHER = 128
SEED = 23
#: Elements without an end tag, elements that start a block of text, elements whose content isn't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OPAQUE = frozenset("script style noscript template iframe object svg canvas video audio head title select textarea button option datalist annotation annotation-xml".split())
#: Fixed value: what an open head may hold; anything else ends it.
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
#: An open element that ends when one of these starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "p": BLOCKS}
_ENDED_BY = {tag: frozenset(old for old, new in ENDS.items() if tag in new) for tag in set().union(*ENDS.values())}
_SCOPES = frozenset("ul ol dl table td th article section main aside nav div body header footer blockquote form".split())
_TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form a b span".split()
#: Words in class, id and role that tell what a region is for. Fixed values.
GROUPS = (
    "article content post entry story text main body prose markdown maincontent articlebody",
    "nav menu navbar breadcrumb breadcrumbs topbar navigation pagination pager toc tabs",
    "header masthead banner branding logo site-header hero",
    "footer copyright colophon legal bottom credits",
    "sidebar side aside widget rail secondary",
    "ad ads advert advertisement sponsor sponsored promo adsbygoogle dfp outbrain taboola",
    "comment comments disqus reply replies respond discussion feedback",
    "share social sharing follow tweet facebook",
    "related recommended more popular trending teaser teasers links also",
    "cookie notice consent gdpr alert popup modal overlay subscribe newsletter signup",
    "form search login register input",
    "meta byline author date tags tag category info",
)
_GROUPS = tuple(frozenset(g.split()) for g in GROUPS)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass(eq=False)
class Node:
    tag: str
    marks: str
    parent: Node | None
    depth: int
    #: The nearest block element around it.
    above: Node | None = None
    parts: list = field(default_factory=list)
    hidden: bool = False


class _Builder(HTMLParser):
    """A tree of a page, with the ends that browsers imply; never fails, whatever the markup.

    ``open`` holds the open elements from the outside in, and their places by tag, so that no start or end looks
    through all of them: a page costs its length, however deep its elements lie.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "", None, 0)
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    @property
    def at(self) -> Node:
        return self.open[-1] if self.open else self.root

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of this tag, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _push(self, node: Node) -> None:
        place = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.tag, []).append(place)
        if node.tag in _SCOPES:
            self.scopes.append(place)
        if node.tag in BLOCKS:
            self.blocks.append(place)

    def _end(self, place: int) -> None:
        """Ends the open element at ``place`` and all that is open in it."""
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in _SCOPES:
                self.scopes.pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def _imply_ends(self, tag: str) -> None:
        """Ends the open elements that can't hold ``tag``: a paragraph, and the innermost item or cell of the same list or table."""
        ended = _ENDED_BY.get(tag)
        if ended:
            item = max((self._last(t) for t in ended if t != "p"), default=-1)
            scope = self.scopes[-1] if self.scopes else -1
            if item >= 0 and item >= scope:
                self._end(item)
            elif "p" in ended and self._last("p") > scope:
                places = self.places["p"]
                self._end(places[bisect_right(places, scope)])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            self.root.marks += " " + " ".join(given.get(k, "") for k in ("class", "id"))
            if tag == "html":
                return
        if self.at.tag == "head" and tag not in HEAD:
            self._end(len(self.open) - 1)
        elif tag == "body" and self._last("head") >= 0:
            self._end(self._last("head"))
        self._imply_ends(tag)
        marks = " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
        around = self.at
        new = Node(tag, marks, around, min(around.depth + (tag in BLOCKS), 200), around if around.tag in BLOCKS else around.above)
        new.hidden = tag in OPAQUE or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        around.parts.append(new)
        if tag not in VOID:
            self._push(new)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self._last(tag)
        if place >= 0 and (tag in BLOCKS or not self.blocks or self.blocks[-1] < place):
            self._end(place)

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._end(len(self.open) - 1)
        self.at.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The end of what starts with <![ at ``i``: for all but CDATA, the next >, as in browsers; HTMLParser refuses some of it."""
        if self.rawdata[i : i + 9].upper() == "<![CDATA[":
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data: str) -> None:
        pass


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def nodes_of(root: Node) -> list[Node]:
    """The block elements that aren't hidden, each after its parent, in page order; inline and unknown elements count with the block around them, and blocks within them stand for themselves."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in BLOCKS:
            out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.hidden)
    return out


def _measure(nodes: list[Node]) -> dict[int, list[float]]:
    """For each element: characters, words, characters in links, elements, blocks, sentence ends, list items, commas."""
    found: dict[int, list[float]] = {}
    for node in reversed(nodes):
        chars = words = linked = elements = ends = items = commas = 0
        blocks, stack = 1, [(x, False) for x in node.parts]
        while stack:
            part, in_link = stack.pop()
            if isinstance(part, str):
                own = part.split()
                size = sum(map(len, own))
                chars += size
                words += len(own)
                linked += size * in_link
                ends += part.count(". ") + part.count(".")
                commas += part.count(",")
            elif part.hidden:
                elements += 1
            elif (below := found.get(id(part))) is not None:
                chars += below[0]
                words += below[1]
                linked += below[0] if in_link else below[2]
                elements += below[3] + 1
                blocks += below[4]
                ends += below[5]
                items += below[6] + (part.tag == "li")
                commas += below[7]
            else:
                elements += 1
                stack.extend((x, in_link or part.tag == "a") for x in part.parts)
        found[id(node)] = [chars, words, linked, elements, blocks, ends, items, commas]
    return found


_ABOVE = ("nav", "header", "footer", "aside", "article", "main", "form", "li", "table")
_NAMED = frozenset(_ABOVE[:7])
_TAG_ROWS = {t: [float(t == x) for x in _TAGS] for t in _TAGS}
_NO_TAG = [0.0] * len(_TAGS)


@lru_cache(maxsize=65_536)
def _groups(tag: str, marks: str) -> tuple[float, ...]:
    words = set(_TOKEN.findall(_CAMEL.sub(r"\1 \2", marks).lower()))
    if tag:
        words.add(tag)
    return tuple(float(bool(words & g)) for g in _GROUPS)


def node_rows(nodes: list[Node]) -> list[list[float]]:
    """The features of the elements of a page, a row for each."""
    measured, place = _measure(nodes), {id(n): k for k, n in enumerate(nodes)}
    page = max(measured[id(nodes[0])][0], 1)
    log = math.log1p
    groups = [_groups(n.tag if n.tag in _NAMED else "", n.marks) for n in nodes]
    sizes = [measured[id(n)] for n in nodes]
    above: list[tuple[float, ...]] = [(0.0,) * len(_GROUPS)] * len(nodes)
    tags: list[tuple[float, ...]] = [(0.0,) * len(_ABOVE)] * len(nodes)
    children: dict[int, list[int]] = {}
    for k, node in enumerate(nodes):
        up = node.above
        if up is not None:
            p = place[id(up)]
            above[k] = tuple(map(max, above[p], groups[p]))
            tags[k] = tuple(1.0 if t == up.tag else old for t, old in zip(_ABOVE, tags[p])) if up.tag in _ABOVE else tags[p]
            children.setdefault(p, []).append(k)
    rows: list[list[float]] = [[]] * len(nodes)
    none = [0.0] * 8
    for own in [[0], *children.values()]:
        most, n = max(max(sizes[k][0] for k in own), 1), len(own)
        alike = Counter(nodes[k].tag for k in own)
        for i, k in enumerate(own):
            node, m = nodes[k], sizes[k]
            a, b = sizes[own[i - 1]] if i else none, sizes[own[i + 1]] if i + 1 < n else none
            chars, words = max(m[0], 1), max(m[1], 1)
            rows[k] = [
                *_TAG_ROWS.get(node.tag, _NO_TAG), *groups[k], *above[k], *tags[k],
                node.depth, log(m[0]), log(m[1]), m[2] / chars, m[0] / (m[3] + 1), log(m[4]), m[5] / words, m[6], m[7] / words, m[0] / words, m[0] / page,
                i, n, i / n, alike[node.tag] / n, m[0] / most, k / len(nodes),
                log(a[0]), a[2] / max(a[0], 1), log(b[0]), b[2] / max(b[0], 1),
            ]
    return rows


def node_features(nodes: list[Node]) -> np.ndarray:
    return np.array(node_rows(nodes), float)


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The most likely choice in which every kept element has a kept parent; the root may always be kept."""
    place = {id(n): k for k, n in enumerate(nodes)}
    p = np.clip(p, 1e-6, 1 - 1e-6)
    drop, keep, parent = np.log(1 - p).tolist(), np.log(p).tolist(), [-1] * len(nodes)
    keep[0] = 0.0
    for k in range(len(nodes) - 1, 0, -1):
        parent[k] = place[id(nodes[k].above)]
        drop[parent[k]] += drop[k]
        keep[parent[k]] += max(keep[k], drop[k])
    out = [True] * len(nodes)
    for k in range(1, len(nodes)):
        out[k] = out[parent[k]] and keep[k] > drop[k]
    return out


def blocks_of(root: Node, kept: set[int]) -> list[str]:
    """The text of the kept elements by blocks, in page order, white space within a block as one space."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            now.append(part)
        elif part.tag == "br":
            now.append(" ")
        elif not part.hidden and (part.tag not in BLOCKS or id(part) in kept):
            if part.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(part.parts))
        elif part.tag in BLOCKS:
            flush()
    flush()
    return out


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees judge the elements of all pages at once."""
    parsed = [nodes_of(parse(html or "")) for html in pages]
    if not parsed:
        return []
    p = trees.probability(np.array([row for nodes in parsed for row in node_rows(nodes)], float))
    out, at = [], 0
    for nodes in parsed:
        choice = decode(nodes, p[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(blocks_of(nodes[0], {id(n) for n, good in zip(nodes, choice) if good})))
    return out


def main_text(html: str | None, trees: Trees) -> str:
    return main_texts([html], trees)[0]


# The pages to learn from.


class _Writer:
    """Writes one page at a time; ``marked`` elements carry the attribute that tells main text from the rest."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def any(self, items: str | list) -> str:
        items = items.split() if isinstance(items, str) else items
        return items[self.rng.integers(len(items))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = ["".join(self.any("ba re lo ti sha nen dor mi ku est an the") for _ in range(self.rng.integers(1, 4))) for _ in range(n)]
        for k in range(int(self.rng.integers(4, 14)), n, 13):
            words[k] += self.any([",", ".", ".", "!", "?"])
        return " ".join(words).capitalize()

    def attrs(self, group: int, p: float = 0.85) -> str:
        if not self.chance(p):
            return ""
        word = self.any(GROUPS[group])
        shape = self.any(["{}", "{}-box", "site-{}", "{}_wrap", "js-{} col", "page {}"])
        return f' {self.any(["class", "class", "id"])}="{shape.format(word)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def region(self, tag: str, group: int, inner: str) -> str:
        own = self.any([tag, tag, "div", "section"])
        return f"<{own}{self.attrs(group, 1.0 if own != tag else 0.4)}>{inner}</{own}>"

    def noise(self) -> str:
        kind = self.rng.integers(12)
        if kind == 0:
            return self.region("nav", 1, f"<ul>{self.links(int(self.rng.integers(2, 9)))}</ul>")
        if kind == 1:
            return self.region("aside", 4, f"<h3>{self.words(1, 4)}</h3><p>{self.words(4, 40)}</p><ul>{self.links(int(self.rng.integers(0, 6)))}</ul>")
        if kind in (2, 3):
            text = self.words(3, 30)
            return f'<div{self.attrs(5, 1)}>{self.any([text, f"<p>{text}</p>", f"<a href=/x>{text}</a>"])}</div>'
        if kind == 4:
            return self.region("section", 6, f"<h3>{self.any('Comments Replies Discussion')}</h3>" + "".join(f"<{t}{self.attrs(6)}><p>{self.words(4, 60)}</p><span>{self.words(1, 2)}</span></{t}>" for t in ["li" if self.chance(0.3) else "div"] * int(self.rng.integers(1, 7))))
        if kind == 5:
            return f"<div{self.attrs(7, 1)}>{self.words(1, 3)} <a href=/s>{self.words(1, 1)}</a> <a href=/t>{self.words(1, 1)}</a></div>"
        if kind == 6:
            return self.region("aside", 8, f"<h4>{self.words(1, 3)}</h4><ul>{self.links(int(self.rng.integers(2, 7)))}</ul>")
        if kind in (7, 8):
            return f"<{(t := self.any('div aside section'))}{self.attrs(9, 1)}><p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button></{t}>"
        if kind == 9:
            return f'<form{self.attrs(10, 0.5)}><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(0, 12)}</p><button>Go</button></form>'
        if kind == 10:
            return f"<script>var a = \"{self.words(1, 9)}\";</script><style>p {{margin: 0}}</style>"
        return f"<div{self.attrs(11, 1)}>{self.words(1, 5)}</div>"

    def paragraph(self) -> str:
        kind = self.rng.random()
        text = self.words(1, 12) if self.chance(0.25) else self.words(10, 120)
        if self.chance(0.2):
            text = f"<b>{text}</b>" if self.chance(0.5) else f"{text} <a href=/y>{self.words(1, 3)}</a> {self.words(2, 20)}"
        if kind < 0.72:
            return f"<p data-main>{text}</p>" if self.chance(0.85) else f"<p data-main><b>{text}<br>"
        if kind < 0.8:
            return f"<{(h := self.any('h2 h3 h4'))} data-main>{self.words(1, 8)}</{h}>"
        if kind < 0.87:
            return f"<{(t := self.any('ul ol'))} data-main>" + "".join(f"<li data-main>{self.words(2, 25)}</li>" for _ in range(self.rng.integers(1, 8))) + f"</{t}>"
        if kind < 0.91:
            return f"<blockquote data-main><p data-main>{text}</p></blockquote>"
        if kind < 0.94:
            return f"<pre data-main>{text}</pre>"
        if kind < 0.97:
            return "<table data-main>" + "".join(f"<tr data-main><td data-main>{self.words(1, 4)}</td><td data-main>{self.words(1, 9)}</td></tr>" for _ in range(self.rng.integers(1, 6))) + "</table>"
        return f"<div data-main>{text}</div>"

    def page(self) -> str:
        most = 14 if self.chance(0.7) else 3
        body = [self.paragraph() for _ in range(int(self.rng.integers(0 if self.chance(0.1) else 1, most)))]
        for _ in range(int(self.rng.integers(0, 4)) if self.chance(0.6) else 0):
            body.insert(int(self.rng.integers(len(body) + 1)), self.noise())
        if self.chance(0.75):
            body.insert(0, f"<h1 data-main>{self.words(2, 12)}</h1>")
            if self.chance(0.25):
                body[0] = f"<header data-main>{body[0]}</header>"
        if self.chance(0.05):  # a fragment: text without any region around it
            return "".join(body[:1] if self.chance(0.3) else body)
        tag = self.any("article article article main div div section")
        article = f"<{tag} data-main{self.attrs(0, 0.3 if tag in ('article', 'main') else 1)}>{''.join(body)}</{tag}>"
        while self.chance(0.35):
            article = f"<{(t := self.any('main div div section'))} data-main{self.attrs(0, 0.4)}>{''.join(self.noise() for _ in range(self.rng.integers(0, 2)))}{article}{''.join(self.noise() for _ in range(self.rng.integers(0, 3)))}</{t}>"
        top = [self.region("header", 2, f"<a href=/>{self.words(1, 3)}</a>" + (f"<nav><ul>{self.links(4)}</ul></nav>" if self.chance(0.5) else f"<p>{self.words(1, 8)}</p>"))] if self.chance(0.5) else []
        top += [f"<nav><ul>{self.links(int(self.rng.integers(3, 9)))}</ul></nav>"] if self.chance(0.6) else []
        top += [self.noise() for _ in range(self.rng.integers(0, 4))]
        end = [self.noise() for _ in range(self.rng.integers(0, 4))]
        end += [self.region("footer", 3, self.any([f"&copy; {self.words(1, 20)}", f"<p>{self.words(1, 25)}</p>", f"<ul>{self.links(4)}</ul>", f"<p>{self.words(1, 9)}</p><ul>{self.links(3)}</ul>"]))] if self.chance(0.85) else []
        head = f"<head><title>{self.words(2, 9)}</title><style>p {{}}</style><script>track(0);</script></head>"
        return f"<!DOCTYPE html><html>{head}<body data-main>{''.join(top)}{article}{''.join(end)}" + ("</body></html>" if self.chance(0.7) else "")


def written_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose elements with main text have the attribute data-main."""
    writer = _Writer(seed)
    return (writer.page() for _ in range(pages))


class _Marked(_Builder):
    def __init__(self):
        super().__init__()
        self.main: set[int] = {id(self.root)}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        before = self.at
        super().handle_starttag(tag, [a for a in attrs if a[0] != "data-main"])
        if any(k == "data-main" for k, _ in attrs) and self.at is not before:
            self.main.add(id(self.at))


@lru_cache(maxsize=4)
def trained_trees(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees trained on :func:`written_pages`; the same arguments give the same trees."""
    rows, label = [], []
    for html in written_pages(pages, seed):
        builder = _Marked()
        builder.feed(html)
        builder.close()
        nodes = nodes_of(builder.root)
        rows.append(node_features(nodes))
        label += [id(n) in builder.main for n in nodes]
    return boost(np.concatenate(rows), np.array(label, float))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    Null and empty html, and pages without main text, give an empty text. Any markup is read to its end, however
    broken or long. Repeated rows and null ids give a row each. An empty table gives no rows. Other columns
    aren't read.
    """
    known = pages.sparkSession.sparkContext.broadcast(trees or trained_trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            texts = [t for at in range(0, len(pages), TOGETHER) for t in main_texts(pages[at : at + TOGETHER], known.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
