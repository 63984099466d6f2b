"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the HTML standard says of elements, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
FURNITURE = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object svg"
    " canvas audio video menu dialog map math datalist".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that say what is no part of a text, those that say where on a page something is, and which of
#: the latter go with `header` when it is the page's own. A name of words of both kinds names furniture; one with a word of
#: its own beside them, such as related-work, only hints at it.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner"
    " banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers foot cookie cookies consent gdpr notice"
    " notices alert alerts popup popups modal overlay newsletter subscribe signup login share sharing social related recommend recommended"
    " recommendations comment comments commentlist commentform respond disqus replies reply pagination pager widget widgets search skip copyright toolbar".split()
)
HEADER_WORDS = frozenset("header masthead topbar pageheader siteheader".split())
LAYOUT_WORDS = frozenset(
    "area section list box block wrap wrapper container content inner outer panel row column col item items group bar link links button buttons icon"
    " icons post posts article articles page site main top bottom left right side middle center primary secondary global form thread count feed unit"
    " slot zone field text body title label image img div info success warning error danger large small".split()
)
PAGE_WORDS = frozenset("site page global top main wrap wrapper container inner bar row left right".split())
#: Ids of sections inside an article that don't stand for a heading's words.
READERS = frozenset("comment comments commentlist commentform respond disqus replies sidebar newsletter".split())
CONTAINERS = frozenset(("article", "main"))
#: Parts of an article that are never its region.
PARTS = frozenset(
    "p li span ul ol dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address h1 h2 h3 h4 h5 h6 summary legend".split()
)
#: A start tag that closes an open element of these kinds (its end tag may be left out).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Start tags that close an open p, and elements whose inside doesn't reach a p around them.
CLOSES_P = BLOCK - frozenset("body caption html legend tbody td tfoot th thead tr".split())
P_SCOPE = frozenset("button caption html marquee object table td template th".split())


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 1
    node: int = 0  # the element in which its text begins
    linked: int = 0  # characters within links


@dataclass
class Node:
    """An element by its parent's number, which is less than its own, with what it takes over from its parents."""

    parent: int
    tag: str
    furniture: bool = False  # by its kind or that of an element around
    boxed: bool = False  # within an article or main that isn't furniture by name
    named: int = 0  # the nearest element, itself included, that is furniture by name, or a form
    hinted: int = 0  # the nearest one whose name hints at it


@lru_cache(maxsize=1 << 14)
def named_by(names: str, header: bool) -> tuple[int, bool]:
    """Whether a class or id names furniture (2), hints at it (1) or neither (0), and whether it is what readers leave.

    Names are told apart by blanks, their words by hyphens, underscores and capitals. header: the page's header counts.
    """
    found, readers = 0, False
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
        others = [w for w in words if w not in FURNITURE_WORDS and not w.isdigit()]
        if "".join(words) in FURNITURE_WORDS or (len(others) < len([w for w in words if not w.isdigit()]) and all(w in LAYOUT_WORDS or w in HEADER_WORDS for w in others)):
            found = 2
        elif header and ("".join(words) in HEADER_WORDS or any(w in HEADER_WORDS for w in words) and all(w in HEADER_WORDS or w in PAGE_WORDS or w.isdigit() for w in words)):
            found = 2
        elif len(others) < len(words) and any(w in FURNITURE_WORDS for w in words) and not words[0] in ("no", "has", "with", "without", "is"):
            found = max(found, 1)
        readers |= any(w in READERS for w in words)
    return found, readers


class Lines(HTMLParser):
    """Collects one line for each run of text between block tags, with its tags and its element. Every tag takes a step or few,
    however deep elements lie in one another and whether they are closed or not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = [Line()]
        self.nodes: list[Node] = [Node(0, "")]
        self.open: list[int] = [0]
        self.opened: Counter[str] = Counter()  # how many elements of a kind are open
        self.over = False

    def close(self) -> None:
        self.over = True
        super().close()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment that no one closes goes on to the page's end."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.over else end

    def _new(self) -> None:
        last = self.lines[-1]
        if last.text or last.tags > 1:
            self.lines.append(Line())

    def _close(self, place: int) -> None:
        for n in self.open[place:]:
            self.opened[self.nodes[n].tag] -= 1
        del self.open[place:]

    def _close_last(self, tag: str, scope: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of a kind, and those in it; not beyond an element of `scope`."""
        if not self.opened[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            kind = self.nodes[self.open[i]].tag
            if kind == tag:
                return self._close(i)
            if kind in scope:
                return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._new()
        self.lines[-1].tags += 1
        if tag in CLOSES_P:
            self._close_last("p", P_SCOPE)
        if tag in CLOSES and self.nodes[self.open[-1]].tag in CLOSES[tag]:
            self._close(len(self.open) - 1)
        if tag == "br":
            self.lines[-1].text.append(" ")
        if tag in VOID:
            return
        given, up, number = dict(attrs), self.nodes[self.open[-1]], len(self.nodes)
        name = self._name(tag, given, up)
        boxed = up.boxed or tag in CONTAINERS and name < 2
        self.nodes.append(Node(self.open[-1], tag, up.furniture or self._furniture(tag, given), boxed, number if name == 2 else up.named, number if name == 1 else up.hinted))
        self.open.append(number)
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path"):
            self.handle_endtag(tag)

    def _outside(self) -> bool:
        return not any(self.opened[name] for name in CONTAINERS)

    def _name(self, tag: str, attrs: dict[str, str | None], up: Node) -> int:
        """2 for furniture by name, 1 for a hint. Ids of headings, paragraphs and the like are anchors, named by their words; so
        may be those of sections in an article, unless they are what readers leave."""
        if tag in ("html", "body"):
            return 0
        if tag == "form":
            return 2
        found = named_by(attrs.get("class") or "", self._outside())[0]
        own = attrs.get("id") or ""
        if own and found < 2 and tag not in PARTS:
            by_id, readers = named_by(own, self._outside())
            found = max(found, 1 if by_id == 2 and up.boxed and tag == "section" and not readers else by_id)
        return found

    def _furniture(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in FURNITURE:
            return tag != "form"
        if tag == "header" and self._outside():
            return True
        if tag in ("html", "body"):
            return False
        if (attrs.get("role") or "").lower() in FURNITURE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I))

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        self._close_last(tag)
        if tag in BLOCK:
            self._new()

    def handle_data(self, data: str) -> None:
        line, own = self.lines[-1], self.nodes[self.open[-1]]
        before = self.nodes[line.node]
        if line.text and (before.furniture, before.named, before.hinted) != (own.furniture, own.named, own.hinted) and data.strip():
            if any(t.strip() for t in line.text):
                self.lines.append(line := Line())
            else:
                line.text.clear()
        if not line.text or not any(t.strip() for t in line.text):
            line.node, line.linked = self.open[-1], 0
        line.text.append(data)
        if self.opened["a"]:
            line.linked += len(data.strip())


@dataclass
class Page:
    """The lines that have text, each with its element and whether it is furniture, and the tree of elements."""

    texts: list[str]
    tags: np.ndarray
    linked: np.ndarray
    at: np.ndarray
    furniture: np.ndarray
    nodes: list[Node]

    def within(self, weights: np.ndarray) -> np.ndarray:
        """The sum of each element's lines, those in elements inside it included."""
        sums = np.bincount(self.at, weights, len(self.nodes)).tolist()
        for n in range(len(self.nodes) - 1, 0, -1):
            sums[self.nodes[n].parent] += sums[n]
        return np.array(sums)

    def inside(self, chosen: np.ndarray) -> np.ndarray:
        """Whether each line lies in one of the chosen elements."""
        under = chosen.tolist()
        for n in range(1, len(self.nodes)):
            under[n] = under[n] or under[self.nodes[n].parent]
        return np.array(under)[self.at]


def parse(html: str, sigma: float = 1.0) -> Page:
    parser = Lines()
    parser.feed(html)
    parser.close()
    nodes = parser.nodes
    lines = [(text, x) for x in parser.lines if (text := " ".join("".join(x.text).split()))]
    at = np.array([x.node for _, x in lines], np.int64)
    furniture = np.array([nodes[x.node].furniture for _, x in lines], bool)
    page = Page([t for t, _ in lines], np.array([x.tags for _, x in lines], float), np.array([x.linked for _, x in lines]), at, furniture, nodes)
    if any(node.named or node.hinted for node in nodes) and not furniture.all():
        _by_name(page, sigma)
    return page


def _content(page: Page, sigma: float) -> np.ndarray:
    """Whether each line is in the upper cluster of the smoothed ratios of text to tags."""
    lengths = np.where(page.furniture, 0, [len(t) for t in page.texts]).astype(float)
    seen = lengths > 0
    scores = smoothed(lengths / page.tags, sigma)
    return seen & (scores >= threshold(scores[seen])) if seen.any() else seen


def _by_name(page: Page, sigma: float) -> None:
    """Marks the lines of elements that are furniture by name, of whatever length.

    A name isn't furniture's where a page has nothing else: if all prose of its articles and mains, or without these all of
    the page's, is inside named elements, the least nested one with the most of it, and those around it, are the page's
    layout. Prose are lines of the upper ratio cluster, and paragraphs and the like of five words, that aren't mostly links.
    A hint counts where more than half of an element's text are links, or where it has no prose and is no heading,
    paragraph or the like itself.
    """
    nodes, n = page.nodes, len(page.nodes)
    lengths = np.where(page.furniture, 0, [len(t) for t in page.texts]).astype(float)
    part = np.array([node.tag in PARTS for node in nodes])
    wordy = np.array([t.count(" ") >= 4 for t in page.texts])
    prose = (lengths > 0) & (page.linked <= 0.5 * lengths) & (_content(page, sigma) | part[page.at] & wordy)
    if not prose.any():
        prose = lengths > 0
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[nodes[i].parent] + (nodes[i].named == i)
    of_line = np.array(depth)[page.at]
    boxed = np.array([node.boxed for node in nodes])[page.at]
    asked = prose & boxed if (prose & boxed).any() else prose
    layout: set[int] = set()
    if of_line[asked].min() > 0:
        first = asked & (of_line == of_line[asked].min())
        nearest = np.array([node.named for node in nodes])[page.at]
        up = int(np.bincount(nearest[first], lengths[first]).argmax())
        while up:
            layout.add(up)
            up = nodes[nodes[up].parent].named
    named = np.array([i > 0 and node.named == i and i not in layout for i, node in enumerate(nodes)])
    linked, whole, told = page.within(page.linked), page.within(lengths), page.within(np.where(prose, lengths, 0))
    hinted = np.array([i > 0 and node.hinted == i for i, node in enumerate(nodes)])
    hinted &= (linked > 0.5 * whole) | (told == 0) & ~part
    page.furniture = page.furniture | page.inside(named | hinted)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the weights that fall on lines."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """The border of two clusters of the values: the middle of their means, repeated until it stays. Values whose clusters lie
    near each other, the lower mean above half of the higher one, are one cluster, and the border is below them."""
    border = float(values.mean())
    for _ in range(rounds):
        high, low = values[values > border], values[values <= border]
        if not len(high) or not len(low):
            return float(values.min())
        moved = (float(high.mean()) + float(low.mean())) / 2
        if abs(moved - border) < 1e-9:
            break
        border = moved
    high, low = values[values > border], values[values <= border]
    return border if len(high) and len(low) and 2 * low.mean() < high.mean() else float(values.min())


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks, joined by line feeds.

    Ratios of text to tags are smoothed over the lines and parted in two clusters. The article is in the outermost
    <article> and <main> elements with content lines, where these hold half of the content or more, else in the innermost
    block that holds all content lines and isn't only a part of an article, such as a list or a table. Page furniture goes
    first: by element, by role, and by name as evidence (see _by_name). Lines of the lower cluster go if links
    make up most of them; in <article> and <main> only before or behind all its content lines, and only if they are
    links as a whole. Elsewhere they also go if they stand before or behind all content lines and are no paragraph,
    heading, item or cell.
    """
    page = parse(html or "", sigma)
    lengths = np.where(page.furniture, 0, [len(t) for t in page.texts]).astype(float)
    if not lengths.any():
        return ""
    seen = lengths > 0
    content = _content(page, sigma)
    total = float(lengths[content].sum())
    nodes = page.nodes
    outer = [0] * len(nodes)  # the outermost article or main around each element, itself included
    for n in range(1, len(nodes)):
        outer[n] = outer[nodes[n].parent] or (n if nodes[n].tag in CONTAINERS else 0)
    boxes = np.bincount(np.array(outer)[page.at[content]], lengths[content], len(nodes))
    boxes[0] = 0
    if boxes.sum() >= 0.5 * total:
        box = np.array(outer)[page.at]
        place = np.arange(len(content))
        first, last = np.full(len(nodes), len(content)), np.full(len(nodes), -1)
        np.minimum.at(first, box[content], place[content])
        np.maximum.at(last, box[content], place[content])
        edge = (place < first[box]) | (place > last[box])
        links = page.linked >= np.array([len(t.replace(" ", "")) for t in page.texts])
        kept = seen & page.inside(boxes > 0) & ~(edge & links)
    else:
        weights = page.within(np.where(content, lengths, 0))
        whole = [n for n in range(1, len(nodes)) if weights[n] >= total and nodes[n].tag in BLOCK and nodes[n].tag not in PARTS]
        region = np.zeros(len(nodes), bool)
        region[whole[-1] if whole else 0] = True
        places = np.flatnonzero(content)
        beside = np.ones(len(content), bool)
        beside[places[0] : places[-1] + 1] = False
        part = page.inside(np.array([node.tag in PARTS and node.tag != "span" for node in nodes]))
        menu = page.linked > 0.5 * np.maximum(lengths, 1)
        kept = seen & page.inside(region) & (content | ~(menu | beside & ~part))
    return "\n".join(t for t, k in zip(page.texts, kept.tolist(), strict=True) if k)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); other columns are ignored.

    A null or empty html, or one without text, gives an empty text and 0 characters. Each repeated row gives a row.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma) for h in batch.column(2).to_pylist()]
            parts = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(parts, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
