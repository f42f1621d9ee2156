"""Main text of web pages by line-block distribution.

Markup is stripped to lines: each block element gives one line, white space inside it becomes one
blank. Navigation, headers, footers, side columns, notices, adverts, forms, scripts, styles and
comment sections are left out; an element that only its class or id marks so is kept if it frames the article or, on a page without one, most of
the page's text, and inside an article if its name is not a known one as a whole and it is no list of links. Lines of different
containers (divisions, sections, articles) stand apart by empty lines, and so do lines on either side of what was left out. Over the
lines, text lengths are summed in sliding windows; links count for nothing. A surge is where the sum rises from nothing, a dive
where it falls back to nothing or a line holds links only; between them lies a segment. The segments whose densest window
reaches a set part of the page's densest one choose the main text: each brings the container it lies in, whole, with its short
paragraphs, headings and lists, raised to the article around it, or to the parent of several like sections. Paragraphs that lie
in no container bring the paragraphs beside them.

Defined results: a null or empty page, or one without text, gives an empty string. Of a page with links only the lines of
its articles count. Unclosed boilerplate ends
at the next heading, section or article, or with the page. Character references are decoded once.
Rows that repeat get equal results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW_LINES = 3
DENSE_PART = 0.3  # of the densest window
LINK_PART = 0.5  # of an element's text, from which on it is a list of links
MOST_PART = 0.6  # of the text of a page without an article: an element with more is no boilerplate, whatever its name
ENOUGH = 300  # characters in a window that are dense on any page

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>"
    r"|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)",
    re.S,
)
_RAW = {"script", "style", "textarea", "xmp", "noembed", "title"}
_GONE = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "iframe", "svg",
    "math", "canvas", "object", "button", "select", "textarea", "dialog", "menu", "audio", "video", "map", "label",
    "fieldset", "datalist", "header",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
_IMPLIED = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # end at their next sibling
_MAIN = {"article", "main"}
_CONTAINERS = {"body", "html", "div", "section", "article", "main", "center"}
_BARRIERS = _CONTAINERS | {"ul", "ol", "dl", "table", "select"}  # an element's implied end does not reach across these
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_RESUME = {"article", "main", "section", "h1", "h2", "h3"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_MARKED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored",
    "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter",
    "subscribe", "subscription", "signup", "login", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "comment", "comments", "commentlist", "disqus",
    "respond", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "popup", "modal",
    "overlay", "paywall", "widget", "toolbar", "copyright", "disclaimer", "search", "skip", "toc",
}
_IN_ARTICLE = _MARKED - {"header", "masthead", "banner", "search", "skip"}  # of a class or id inside an article, with
_WITH = {"area", "bar", "block", "box", "btn", "button", "buttons", "container", "form", "inner", "item", "items", "link", "links", "list",
         "panel", "post", "posts", "section", "wrap", "wrapper"}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_CLOSERS = {n: re.compile(rf"</{n}\s*>|</{n}\b[^>]*>", re.I) for n in _RAW}


def _boilerplate(name: str, attrs: str, whole: bool) -> bool:
    """Whether an element's class, id, role or state says that it is no part of the article; ``whole``: only names known as a whole say so."""
    if name in ("body", "html") or not attrs:
        return False
    for match in _ATTR.finditer(attrs):
        kind = match[1].lower()
        value = next((v for v in match.groups()[1:] if v is not None), "")
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True
        if kind == "role" and value.lower() in _ROLES:
            return True
        if kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if kind in ("class", "id"):
            for one in value.split():
                parts = {part.lower() for part in _PART.findall(one)}
                if parts & _IN_ARTICLE and parts <= _MARKED | _WITH if whole else parts & _MARKED:
                    return True
    return False


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds are text, open and close. Raw elements come without content."""
    out, at = [], 0
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            out.append(("text", page[at:], ""))
            return out
        if match.start() > at:
            out.append(("text", page[at : match.start()], ""))
        at = match.end()
        if match["cdata"]:
            out.append(("raw", match["cdata"], ""))
        if match["name"]:
            name = match["name"].lower()
            out.append(("close" if match["close"] else "open", name, match["attrs"] or ""))
            if name in _RAW and not match["close"] and not (match["attrs"] or "").endswith("/"):
                end = _CLOSERS[name].search(page, at)
                if end is None and name == "title":
                    continue
                out.append(("close", name, ""))
                at = end.end() if end else len(page)


def _ends(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each opened element the token that ends it, where there is one."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in _VOID:
            if name in _IMPLIED and (stack := opened.get(name)):
                ends.setdefault(stack.pop(), i)
            opened.setdefault(name, []).append(i)
        elif kind == "close" and (stack := opened.get(name)):
            ends[stack.pop()] = i
    return ends


def _sums(tokens: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of text outside head, scripts and menus, those of them in links, and articles opened, before each token."""
    chars, linked, mains = (np.zeros(len(tokens) + 1, np.int64) for _ in range(3))
    quiet, links = None, 0
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name in _GONE and name != "header" and quiet is None:
            quiet = name
        elif kind == "close" and name == quiet:
            quiet = None
        if name == "a" and kind in ("open", "close"):
            links = max(0, links + (1 if kind == "open" else -1))
        size = len(name.strip()) if kind == "text" and quiet is None else 0
        chars[i + 1], linked[i + 1] = chars[i] + size, linked[i] + (size if links else 0)
        mains[i + 1] = mains[i] + (kind == "open" and name in _MAIN)
    return chars, linked, mains


class Element(NamedTuple):
    name: str
    parent: int
    sign: str  # name and class, alike for elements of one kind


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    path: tuple[int, ...]  # the elements around it, its own block last
    container: int
    apart: bool  # something was left out before it


class _Tree:
    """The open block elements."""

    def __init__(self) -> None:
        self.elements = [Element("html", -1, "html")]
        self.open = [0]

    def push(self, name: str, attrs: str) -> None:
        if name in _IMPLIED:
            self.pop(name, _BARRIERS)
        found = next((m for m in _ATTR.finditer(attrs) if m[1].lower() == "class"), None)
        sign = f"{name} {next((v for v in found.groups()[1:] if v), '')}" if found else name
        self.elements.append(Element(name, self.open[-1], sign))
        self.open.append(len(self.elements) - 1)

    def pop(self, name: str, until: frozenset[str] | set[str] = frozenset()) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]].name == name:
                del self.open[depth:]
                return
            if self.elements[self.open[depth]].name in until:
                return

    def container(self) -> int:
        """The nearest container around the innermost element."""
        return next((e for e in reversed(self.open[:-1]) if self.elements[e].name in _CONTAINERS), 0)


def lines_of(page: str) -> tuple[list[Line], list[Element]]:
    """The lines of a page that no tag or name excludes, and the elements they lie in."""
    tokens = _tokens(page)
    ends = _ends(tokens)
    text_before, links_before, mains_before = _sums(tokens)
    tree, lines, parts = _Tree(), [], []
    plain = links = mains = 0
    apart = False

    def close_line() -> None:
        nonlocal plain, apart
        if parts:
            if text := _SPACE.sub(" ", "".join(parts)).strip():
                lines.append(Line(text, min(plain, len(text)), tuple(tree.open), tree.container(), apart))
                apart = False
            parts.clear()
            plain = 0

    i = 0
    while i < len(tokens):
        kind, name, attrs = tokens[i]
        if kind in ("text", "raw"):
            text = entities.unescape(name) if kind == "text" else name
            parts.append(text)
            plain += 0 if links else len(text.strip())
        elif kind == "open":
            end = ends.get(i)
            stop = len(tokens) if end is None else end
            if name in _GONE:
                off = not (name == "header" and mains)  # an article's own header holds its heading
            else:
                size = text_before[stop] - text_before[i]
                listed = links_before[stop] - links_before[i] > LINK_PART * size
                whole = mains > 0 and not listed
                off = name not in _VOID and not attrs.endswith("/") and not (mains and name in _HEADINGS)
                off = off and _boilerplate(name, attrs, whole)
                if off and end is not None and name not in _MAIN and mains_before[stop] > mains_before[i + 1]:
                    off = False  # a frame around the article, named after what stands beside it
                if off and end is not None and (name in _MAIN or not mains_before[-1]) and size > MOST_PART * text_before[-1]:
                    off = False
            if off:
                if name not in _INLINE:
                    close_line()
                    apart = apart or not mains
                if end is None:
                    end = next((j for j in range(i + 1, len(tokens)) if tokens[j][0] == "open" and tokens[j][1] in _RESUME), len(tokens))
                    i = end
                elif tokens[end][0] == "open":  # its next sibling
                    i = end
                else:
                    i = end + 1
                continue
            if name == "a":
                links += 1
            elif name not in _INLINE:
                close_line()
                if name not in _VOID:
                    tree.push(name, attrs)
                    mains += name in _MAIN
        elif name == "a":
            links = max(0, links - 1)
        elif name not in _INLINE:
            close_line()
            tree.pop(name)
            mains = max(0, mains - (name in _MAIN))
            links = 0
        i += 1
    close_line()
    return lines, tree.elements


def segments(lengths: np.ndarray, window: int, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """(surge, dive, densest window sum) of each stretch with text; a stretch also ends at a cut."""
    padded = np.concatenate([lengths, np.zeros(window, np.int64)])
    sums = np.convolve(padded, np.ones(window, np.int64))[window - 1 : window - 1 + len(lengths)]  # of line i and the next ones
    out, start = [], None
    for i in range(len(lengths) + 1):
        ended = i == len(lengths) or sums[i] == 0 or cuts[i]
        if start is not None and ended:
            own = lengths[start:i]
            out.append((start, i, int(np.convolve(own, np.ones(window, np.int64)).max())))
            start = None
        if start is None and i < len(lengths) and lengths[i] > 0:
            start = i
    return out


def _frame(own: list[int], lines: list[Line], elements: list[Element]) -> set[int]:
    """The lines that a dense stretch of lines brings with it: those of its container."""
    shared = lines[own[0]].path if len(own) > 1 else lines[own[0]].path[:-1]
    for i in own[1:]:
        same = 0
        for x, y in zip(shared, lines[i].path):
            if x != y:
                break
            same += 1
        shared = shared[:same]
    frame = next((e for e in shared if elements[e].name in _MAIN), None)
    if frame is None:
        frame = next((e for e in reversed(shared) if elements[e].name in _CONTAINERS), 0)
        around = elements[frame].parent
        alike = {e for line in lines for e in line.path if e != frame and elements[e].parent == around and elements[e].sign == elements[frame].sign}
        if alike and elements[around].name not in ("body", "html"):
            frame = around
    if elements[frame].name in ("body", "html"):
        beside = {i for i, line in enumerate(lines) if line.container == frame and line.plain and elements[line.path[-1]].name not in _CONTAINERS}
        return beside | set(own)
    return {i for i, line in enumerate(lines) if frame in line.path}


def main_text(page: str | None, window: int = WINDOW_LINES, dense_part: float = DENSE_PART) -> str:
    lines, elements = lines_of(page or "")
    lengths: list[int] = []
    owner: list[int] = []  # the line at each place, -1 in the gaps between containers
    for i, line in enumerate(lines):
        if i and (line.apart or line.container != lines[i - 1].container):
            lengths += [0] * window
            owner += [-1] * window
        lengths.append(line.plain)
        owner.append(i)
    links = np.array([i >= 0 and not lines[i].plain for i in owner], bool)
    found = segments(np.array(lengths, np.int64), window, links) if lines else []
    top = max((peak for _, _, peak in found), default=0)
    kept: set[int] = set()
    if not found:
        kept = {i for i, line in enumerate(lines) if any(elements[e].name in _MAIN for e in line.path)}
    for start, end, peak in sorted(found, key=lambda f: -f[2]):
        own = [i for i in owner[start:end] if i >= 0]
        if peak >= min(top * dense_part, ENOUGH) and not kept.issuperset(own):
            kept |= _frame(own, lines, elements)
    return " ".join(lines[i].text for i in sorted(kept))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(pages[key].alias("id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["id", "url", "text", "n_chars"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": key, "url": url})
