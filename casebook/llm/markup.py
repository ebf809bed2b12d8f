"""One pass over raw HTML: text blocks with what encloses them, title and links.

Malformed pages are read leniently: unclosed elements end with the element
around them, stray end tags are ignored, and an unfinished tag or comment at the
end of a page is text or is dropped as in browsers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names by their role.
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
})
CHROME = frozenset({"nav", "footer", "aside", "form", "header", "head", "menu", "dialog", "button", "select", "svg", "object", "audio", "video", "canvas", "search"})
CONTENT = frozenset({"article", "main"})
CHROME_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar"})
CHROME_WORDS = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "menu",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "cookie",
    "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "comment", "comments", "disqus", "widget", "pagination", "pager", "toolbar",
})
TITLE_WORDS = frozenset({"header", "banner"})  # inside an article these enclose its title
NEVER_BY_WORD = frozenset({"html", "body", "main"})

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPANS = {"<!--": "-->", "<![CDATA[": "]]>"}  # what is skipped whole, to the page's end if it is not closed
_SPAN_OPEN = {close: len(start) for start, close in _SPANS.items()}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
FOREIGN_WORDS = frozenset({  # may outweigh the article, yet never hold it
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "cookie", "cookies", "consent",
    "comment", "comments", "disqus",
})

OUTSIDE, INSIDE = 0, 1


@dataclass
class Page:
    title: str = ""
    language: str = ""
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (OUTSIDE or INSIDE an article, text), chrome left out
    lines: list[str] = field(default_factory=list)  # all visible text blocks, chrome included
    links: list[tuple[str, str]] = field(default_factory=list)  # (address, text)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def squeeze(text: str) -> str:
    return " ".join(unescape(text).split())


HARD, SOFT = -1, -2  # chrome; chrome by a name only, unless it holds most of the page


def _chrome(tag: str, source: str, in_article: bool) -> int:
    """HARD, SOFT or 0.  Forms and words of class or id are SOFT: whole pages stand in such elements too."""
    if tag in CHROME and tag != "form" and not (tag == "header" and in_article):
        return HARD
    soft = SOFT if tag == "form" else 0
    if not source.strip():
        return soft
    given = attributes(source)
    if "hidden" in given or given.get("role", "").lower() in CHROME_ROLES or _HIDDEN.search(given.get("style", "")):
        return HARD
    if tag in NEVER_BY_WORD:
        return 0
    hits = set(f"{given.get('class', '')} {given.get('id', '')}".lower().split()) & CHROME_WORDS
    if hits & FOREIGN_WORDS:
        return HARD
    return SOFT if (hits - TITLE_WORDS if in_article else hits) else soft


def _is_content(tag: str, source: str) -> bool:
    if tag in CONTENT:
        return True
    given = attributes(source) if source.strip() else {}
    return given.get("role", "").lower() in CONTENT or given.get("itemprop") == "articleBody"


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, int]] = []  # (tag, HARD or SOFT chrome, 1 content, 0 neither)
        self.soft: list[int] = []  # open SOFT elements, by number
        self.parent: list[int] = []  # of every SOFT element: the SOFT element around it, or -1
        self.alone: list[bool] = []  # it stands in no content markup
        self.holds: list[bool] = []  # content markup starts in it (marked at the innermost element only)
        self.found: list[tuple[int, str, int]] = []  # (kind, text, innermost SOFT element around it, or -1)
        self.open: Counter[str] = Counter()
        self.kinds: Counter[int] = Counter()
        self.run: list[str] = []
        self.link: list[str] | None = None
        self.link_address = ""

    def text(self, piece: str) -> None:
        if piece:
            self.run.append(piece)
            if self.link is not None:
                self.link.append(piece)

    def flush(self) -> None:
        if self.run:
            if text := squeeze("".join(self.run)):
                self.page.lines.append(text)
                if not self.kinds[HARD]:
                    self.found.append((INSIDE if self.kinds[1] else OUTSIDE, text, self.soft[-1] if self.soft else -1))
            self.run = []

    def _pop(self) -> None:
        tag, kind = self.stack.pop()
        self.open[tag] -= 1
        self.kinds[kind] -= 1
        if kind == SOFT:
            self.soft.pop()

    def decide(self) -> None:
        """Fill the page's blocks: a SOFT element is chrome unless it holds over half of the text, or of the text in content markup."""
        total, held = [0, 0], [[0, 0] for _ in self.parent]
        for kind, text, inner in self.found:
            for sums in (total, held[inner]) if inner >= 0 else (total,):
                sums[0] += len(text)
                sums[1] += len(text) * (kind == INSIDE)
        for i in range(len(self.parent) - 1, -1, -1):  # an element has a higher number than those around it
            if (up := self.parent[i]) >= 0:
                held[up][0] += held[i][0]
                held[up][1] += held[i][1]
                self.holds[up] |= self.holds[i]
        chrome: list[bool] = []
        for i, own in enumerate(held):
            most = any(2 * part > whole for part, whole in zip(own, total, strict=True))
            up = self.parent[i]
            chrome.append(not (self.alone[i] or self.holds[i]) or not most or up >= 0 and chrome[up])
        self.page.blocks = [(kind, text) for kind, text, inner in self.found if inner < 0 or not chrome[inner]]

    def start(self, tag: str, source: str) -> None:
        chrome = _chrome(tag, source, bool(self.kinds[1]))
        if tag in BLOCK or chrome:
            self.flush()
            if tag in BLOCK and self.stack and self.stack[-1][0] == "p":
                self._pop()
        if tag == "html" and not self.page.language:
            self.page.language = attributes(source).get("lang", "")
        if tag == "a":
            self.end_link()
            if address := attributes(source).get("href"):
                self.link, self.link_address = [], address
        if tag in VOID or source.endswith("/") and tag not in BLOCK:
            return
        kind = chrome or int(_is_content(tag, source))
        if kind == SOFT:
            self.parent.append(self.soft[-1] if self.soft else -1)
            self.soft.append(len(self.alone))
            self.alone.append(not self.kinds[1])
            self.holds.append(False)
        elif kind == 1 and self.soft:
            self.holds[self.soft[-1]] = True
        if kind or tag in ("div", "section", "p"):
            self.stack.append((tag, kind))
            self.open[tag] += 1
            self.kinds[kind] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.end_link()
        if tag in BLOCK or self.open[tag]:
            self.flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def end_link(self) -> None:
        if self.link is not None:
            self.page.links.append((self.link_address, squeeze("".join(self.link))))
            self.link = None


class _TagEnds:
    """Where the tags of one page end: at the first `>` outside quotes, else at the first `>`.

    Each look takes the time of the tag itself.  The first tag that has no end outside
    quotes is scanned to the end of the page; from then on ends come from one pass from
    the right over all quotes and `>`.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.stops: list[int] = []
        self.ends: list[int] = []  # end of a tag whose next stop is this one; -1: none outside quotes
        self.scanned = False

    def end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose name ends at `at`; there is a `>` at or behind it."""
        if not self.scanned:
            if found := _TO_END.match(self.html, at):
                return found.end() - 1
            self._scan()
        i = bisect_left(self.stops, at)
        end = self.ends[i] if i < len(self.stops) else -1
        return end if end >= 0 else self.html.find(">", at)

    def _scan(self) -> None:
        self.scanned = True
        self.stops = [m.start() for m in _STOP.finditer(self.html)]
        self.ends = [-1] * len(self.stops)
        behind: dict[str, int] = {}  # end of a tag that is outside quotes behind the next quote of this kind
        following = -1
        for i in range(len(self.stops) - 1, -1, -1):
            sign = self.html[self.stops[i]]
            own = self.stops[i] if sign == ">" else behind.get(sign, -1)
            if sign != ">":
                behind[sign] = following
            self.ends[i] = following = own


def _raw_end(html: str, tag: str, at: int) -> tuple[int, int]:
    """Start and end of the end tag of a raw element; the page's end if there is none."""
    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
    end = html.find(">", found.end()) if found else -1
    return (found.start(), end + 1) if found and end >= 0 else (len(html), len(html))


def read_page(html: str) -> Page:
    """Time is linear in the page's size, whatever is broken in it."""
    reader, at = _Reader(), 0
    size, ends = len(html), _TagEnds(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            reader.text(html[at:])
            break
        reader.text(html[at:start])
        if closing := next((c for o, c in _SPANS.items() if html.startswith(o, start)), None):
            end = html.find(closing, start + _SPAN_OPEN[closing])
            at = size if end < 0 else end + len(closing)
            continue
        name = _NAME.match(html, start) if start < ends.last else None
        if name is None:
            if start < ends.last and html[start + 1] in "!?/":
                at = html.find(">", start + 2) + 1
            else:
                reader.text("<")
                at = start + 1
            continue
        end = ends.end(name.end())
        tag, source, at = name[2].lower(), html[name.end() : end], end + 1
        if name[1]:
            reader.end(tag)
        elif tag in RAW and not source.endswith("/"):
            if tag in BLOCK:
                reader.flush()
            inside, after = _raw_end(html, tag, at)
            if tag == "title" and not reader.page.title:
                reader.page.title = squeeze(html[at:inside])
            at = after
        else:
            reader.start(tag, source)
    reader.end_link()
    reader.flush()
    reader.decide()
    return reader.page


def shared_lines(own: list[str], other: list[str]) -> list[bool]:
    """Which of `own` lie on a longest common subsequence with `other`.

    Bit-parallel over `other`: one step per own line on an integer with a bit
    per other line; the states are walked back to find the matched lines.
    """
    flags = [False] * len(own)
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        flags[head] = True
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        flags[-1 - tail] = True
        tail += 1
    mine, theirs = own[head : len(own) - tail], other[head : len(other) - tail]
    places: dict[str, int] = {}
    for j, line in enumerate(theirs):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(theirs)) - 1
    state, states = full, []  # bit j is 0 where the length grows at column j
    for line in mine:
        states.append(state)
        match = state & places.get(line, 0)
        state = ((state + match) | (state - match)) & full
    j = len(theirs)
    after = state
    for i in range(len(mine) - 1, -1, -1):
        before = states[i]
        mask = (1 << j) - 1
        length, shorter = (~after & mask).bit_count(), (~before & mask).bit_count()
        if length > shorter:  # line i is matched, at its last place where the length still grows
            grown = places[mine[i]] & mask
            while grown:
                k = grown.bit_length() - 1
                below = (1 << k) - 1
                if (~before & below).bit_count() + 1 == length:
                    break
                grown &= below
            flags[head + i] = True
            j = k
        after = before
    return flags
