"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of tags from the root to it. Per distinct path, in
order of first appearance, the text length and the punctuation of its blocks are averaged, smoothed over
neighbouring paths and fused; paths over a threshold are content. The innermost element that holds all content,
headings next to it included, is the article, and its blocks are the text, but for those that are mostly links and whose path is
not content; content blocks beside an article element are text as well. Elements that never hold content (menus, controls, scripts and so on) are
left out by their tag. Forms, dialogs and elements with a whole name in class, id or role that says they surround an article weigh
against themselves only: such an element stays if it lies in an article element and its own ratios are like those of the text around it, or
if no article element lies outside of such elements and it holds one, or most of the page's text. Readers' comments and adverts go
by name, as no ratio tells them from an article.

Defined results: null, empty or textless html gives the empty text; unclosed or stray tags and references are
read as browsers do in the simple cases and never fail; white space within a block, no-break spaces included,
becomes one space; pages that repeat are extracted alike; a null page_id or url is kept; pages of any length and depth are read whole, in time
and memory in proportion to them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>"[^"]*"|'[^']*'|[^"'>])*+)>|<(?P<odd>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>?|(?P<text>[^<]+|<)""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'][^"']*+["']?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCT = re.compile(r"""[.,;:!?¿¡…。，；：！？"“”„«»()]""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUTSIDE = frozenset("head script style title noscript template nav footer aside button select option input textarea iframe svg math canvas object audio video menu menuitem xmp noembed noframes applet".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option optgroup select head title".split()
)
ARTICLE = frozenset(("article", "main"))
#: Elements that surround an article, or hold it as they may hold a whole page.
AROUND_TAGS = frozenset("form fieldset label dialog".split())
#: An open element of the value is closed by a start tag of the key.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
#: Elements out of which nothing inside them closes what is outside.
FENCE = frozenset("table td th ul ol dl body html article section main div button form nav aside header footer blockquote".split())
#: Words of class, id or role that name what surrounds an article.
AROUND = frozenset(
    """ad ads adv advert adverts advertisement adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead topbar toolbar
    cookie cookies consent gdpr notice notices alert popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies
    pager pagination skip widget widgets copyright legal contentinfo complementary search hidden""".split()
)
#: Words that may stand beside them in one name.
BESIDE = frozenset("site left right top bottom main primary secondary global container wrapper box bar list item items body links inner block post posts article entry section".split())
#: Those words that name what readers or advertisers wrote, whose text no ratio tells from the article's.
REMARKS = frozenset("comment comments disqus respond reply replies ad ads adv advert adverts advertisement sponsor sponsored".split())
SHARE = 0.3
MOST = 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    """An open or closed element; path numbers its distinct path of tags, block is the innermost block element at or above it."""

    __slots__ = ("around", "block", "depth", "named", "number", "parent", "path", "tag")

    def __init__(self, number: int, tag: str, parent: Element | None, path: int, around: bool, named: str = ""):
        self.number, self.tag, self.parent, self.path, self.around, self.named = number, tag, parent, path, around, named
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or parent is None else parent.block


Block = tuple[Element, str, int]


def surrounds(tag: str, attrs: str, within: bool) -> bool:
    """Whether an element, by its tag or by being hidden, is no part of an article; within: it lies in an article element."""
    if tag in OUTSIDE or (tag == "header" and not within):
        return True
    if tag in ("html", "body") or not attrs:
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def named(tag: str, attrs: str, within: bool) -> str:
    """'remarks' or 'around' if a whole name in class, id or role says that the element surrounds an article, else ''.

    A name says so if each of its words is one of AROUND or BESIDE and one of them of AROUND: 'cookie-notice' does, 'has-sidebar' doesn't.
    """
    if tag in ("html", "body"):
        return ""
    found = "around" if tag in AROUND_TAGS else ""
    for name, *values in ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for token in next((v for v in values if v), "").split():
                words = {w.lower() for w in PART.findall(token)}
                told = words & AROUND or ("header" in words and not within)
                if told and words <= AROUND | BESIDE | {"header"}:
                    if words & REMARKS:
                        return "remarks"
                    found = "around" if tag not in ARTICLE else found
    return found


def sums(elements: list[Element], blocks: list[Block]) -> list[int]:
    """Characters of the blocks in each element. An element's number is greater than its parent's."""
    out = [0] * len(elements)
    for e, text, _ in blocks:
        out[e.number] += len(text)
    for e in reversed(elements[1:]):
        out[e.parent.number] += out[e.number]
    return out


def inside(elements: list[Element], told) -> list[bool]:
    """For each element, whether told(e) holds for it or for one that it lies in."""
    out: list[bool] = []
    for e in elements:
        out.append(told(e) or (e.parent is not None and out[e.parent.number]))
    return out


def readable(elements: list[Element], found: list[Block], within: list[bool]) -> list[bool]:
    """For each element, whether ratios take it for part of an article although its name says otherwise.

    It lies in an article element and has a heading or several blocks of text, less than half of it in links, and its text and punctuation
    a block, fused, come to SHARE of the best among paths outside of all named elements.
    """
    told = inside(elements, lambda e: bool(e.named))
    free = [b for b in found if not told[b[0].number]]
    out = [False] * len(elements)
    if not free:
        return out
    own, marks = ratios(free)
    least = SHARE * fused_ratios(own, marks).max()
    n, heads = len(elements), [False] * len(elements)
    chars, linked, blocks, points = [0] * n, [0] * n, [0] * n, [0] * n
    for e, text, links in found:
        blocks[e.number] += e.tag not in HEADINGS
        heads[e.number] |= e.tag in HEADINGS
        chars[e.number] += len(text)
        linked[e.number] += links
        points[e.number] += len(PUNCT.findall(text))
    for e in reversed(elements[1:]):
        up = e.parent.number
        heads[up] |= heads[e.number]
        for x in (chars, linked, blocks, points):
            x[up] += x[e.number]
    for e in elements:
        i = e.number
        if e.named == "around" and within[i] and blocks[i] and (heads[i] or blocks[i] > 1) and 2 * linked[i] < chars[i]:
            out[i] = ((chars[i] - linked[i]) / blocks[i] * (points[i] / blocks[i] + 0.1)) ** 0.5 >= least
    return out


def unnamed(elements: list[Element], found: list[Block]) -> list[Block]:
    """The blocks without those in elements that surround the article by name, but for elements that hold it or read like it.

    Where no article element lies outside of all named ones, those that hold one or most of the text stay. All blocks, if none is left.
    """
    if not any(e.named for e in elements):
        return found
    chars = sums(elements, found)
    own = lambda e: e.tag in ARTICLE and e.named != "remarks"
    holds = [own(e) and chars[e.number] > 0 for e in elements]
    for e in reversed(elements[1:]):
        holds[e.parent.number] |= holds[e.number]
    within, told = inside(elements, own), inside(elements, lambda e: bool(e.named))
    free = any(within[e.number] and not told[e.number] for e, _, _ in found)
    half = chars[0] / 2
    read = readable(elements, found, within)
    gone = inside(elements, lambda e: bool(e.named) and not read[e.number] and not (e.named == "around" and not free and (chars[e.number] > half or holds[e.number])))
    return [b for b in found if not gone[b[0].number]] or found


def blocks_of(page: str) -> tuple[list[Element], list[Block]]:
    """All elements, and (element, text, characters in links) of every block outside what surrounds articles, in page order."""
    root = Element(0, "#", None, 0, False)
    paths: dict[tuple[int, str], int] = {}
    elements = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    stack, out, buffer = [root], [], []
    links, within, linked = 0, 0, 0
    at = root

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text and not at.around:
                out.append((at, text, linked))
            buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, within
        e = stack.pop()
        places[e.tag].pop()
        links -= e.tag == "a"
        within -= e.tag in ARTICLE

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, fences) -> bool:
        """Close the innermost open element of tags with all in it, unless a fence is open inside it."""
        i = last(tags)
        if not i or last(fences) > i:
            return False
        while len(stack) > i:
            pop()
        return True

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.match(page, pos)
        pos = m.end()
        kind = m.lastgroup
        if kind in ("text", "cdata"):
            if stack[-1].around:
                continue
            if not buffer:
                at = stack[-1].block
            piece = html.unescape(m[kind]) if kind == "text" and "&" in m[kind] else m[kind]
            buffer.append(piece)
            linked += len(piece) if links > 0 else 0
        elif kind in ("attrs", "rest"):
            tag = (m["open"] or m["odd"]).lower()
            attrs = m[kind]
            if tag == "br":
                buffer.append(" ") if buffer else None
                continue
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            ends = CLOSES.get(tag, ())
            if tag in BLOCK and tag != "p":
                ends = (*ends, "p")
            elif tag == "p":
                ends = ("p",)
            elif tag == "a":
                ends = ("a",)
            while ends and close(ends, FENCE.difference(ends)):
                pass
            parent = stack[-1]
            path = paths.setdefault((parent.path, tag), len(paths) + 1)
            e = Element(len(elements), tag, parent, path, parent.around or surrounds(tag, attrs, within > 0), named(tag, attrs, within > 0))
            if not attrs.rstrip().endswith("/") or tag in BLOCK:
                elements.append(e)
                stack.append(e)
                places.setdefault(tag, []).append(len(stack) - 1)
                links += tag == "a"
                within += tag in ARTICLE
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else size
                pop()
        elif kind == "close":
            tag = m["close"].lower()
            if tag in BLOCK:
                flush()
            close((tag,), () if tag in BLOCK else FENCE.difference((tag,)))
    flush()
    return elements, out


def ratios(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Text outside links, and punctuation, a block of each distinct path, in order of appearance."""
    order: dict[int, list[int]] = {}
    for i, (e, _, _) in enumerate(found):
        order.setdefault(e.path, []).append(i)
    own = np.array([len(t) - min(n, len(t)) for _, t, n in found], float)
    marks = np.array([len(PUNCT.findall(t)) * (1 if n < len(t) / 2 else 0) for _, t, n in found], float)
    return np.array([own[v].mean() for v in order.values()]), np.array([marks[v].mean() for v in order.values()])


def fused_ratios(lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Geometric mean of smoothed text and punctuation ratios of paths in order of appearance."""
    kernel = np.array([0.15, 0.7, 0.15])

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")

    return np.sqrt(smooth(lengths) * smooth(marks + 0.1))


def main_text(page: str | None) -> str:
    elements, found = blocks_of(page or "")
    found = unnamed(elements, found)
    if not found:
        return ""
    paths = list(dict.fromkeys(e.path for e, _, _ in found))
    score = fused_ratios(*ratios(found))
    top = score.max()
    content = {p for p, s in zip(paths, score, strict=True) if s >= SHARE * top}
    held = sums(elements, [b for b in found if b[0].path in content])
    whole = held[0]
    # an article element with nearly all content, or else the innermost element with all of it
    innermost = max((e for e in elements if held[e.number] >= MOST * whole), key=lambda e: e.depth)
    own_element = innermost
    while own_element is not None and own_element.tag not in ARTICLE:
        own_element = own_element.parent
    article = own_element or max((e for e in elements if held[e.number] >= whole), key=lambda e: e.depth)
    # a block of text that is an element of its own has its parent as article
    if own_element is None and article.tag not in ("div", "section", "td", "body", "#") and article.parent is not None:
        article = article.parent
    in_article = inside(elements, lambda e: e is article)
    chosen = [in_article[e.number] for e, _, _ in found]
    if own_element is None:
        # headings next to it, and what stands between
        beside, heading = inside(elements, lambda e: e is article.parent), inside(elements, lambda e: e.tag in HEADINGS)
        first = start = chosen.index(True)
        for i in range(first - 1, -1, -1):
            e, text, linked = found[i]
            if linked >= len(text) / 2 or not beside[e.number]:
                break
            if heading[e.number]:
                start = i
        chosen[start:first] = [True] * (first - start)
    elif article.parent is not None:
        # content next to the article element: blocks of the same parent that read like it and aren't links
        for i, (e, text, linked) in enumerate(found):
            if e.parent is article.parent and e.path in content and 2 * linked < len(text):
                chosen[i] = True
    out = [text for (e, text, linked), x in zip(found, chosen, strict=True) if x and (e.path in content or linked < len(text) / 2)]
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").transform(common.small_batches).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
