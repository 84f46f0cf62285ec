"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block of the page; text of scripts, styles and parts that markup names as
menu, header, footer, sidebar, notice, advert, form or reader comment weighs nothing and is never kept. A name is a
whole class, id or role; where a part named so, other than adverts, consent and reader comments, holds most of the
page's text, the name doesn't count. Elements end where HTML closes them without an end tag. The
lengths of the other lines, without link texts, are summed over windows of ``LINES`` lines. The text surges
where these sums first reach ``SURGE`` characters and dives where they last do; on a page that never reaches
them, at the first and last line that weighs anything. The lines between are the main text. Neighbouring lines
of the same container that are mostly not links move the ends outwards. If the surge lies in an article or main element, it moves to that element's first line, and a dive in
one to its last line, so that short paragraphs at the ends stay; no line between is dropped for lying outside.

Defined cases: a null page is empty; a page without text has the empty text; unclosed and surplus tags are
allowed; repeated rows and ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES, SURGE = 3, 86

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EVENT = re.compile(r"[>\"']")
#: Elements whose content is not markup, and how they end.
_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe)\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "svg", "iframe")}
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# What parts of a page are called that are not its text.
_APART = set(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu topbar masthead header "
    "footer sidebar aside widget comment comments respond replies discussion cookie cookies consent notice notices alert popup modal newsletter "
    "subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination pager login signup search form "
    "contentinfo complementary".split()
)
# Those that stand for nothing else, however long such a part is.
_SURELY_APART = set(
    "ad ads adv advert adverts advertisement sponsor sponsored comment comments respond replies discussion cookie cookies consent".split()
)
_APART_TAGS = set("head nav footer aside form menu dialog select button textarea label fieldset".split())
_HOLDERS = {"article", "main"}
#: What lines are put in without leaving the container around it.
_GROUPS = set("h1 h2 h3 h4 h5 h6 hgroup ul ol dl table thead tbody tfoot blockquote pre address figure figcaption center p li td th tr dd dt option".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr br".split()
)
#: By the tag that opens: pairs of the open elements it closes and those it doesn't look beyond.
_PARAGRAPH = (("p",), ("td", "th", "caption", "table", "button", "object"))
_LISTS = ("ul", "ol", "menu", "dl", "table", "td", "th", "section", "article", "main", "nav", "aside", "form", "blockquote")
_ROWS = ("table",)
_CLOSES = {
    tag: (_PARAGRAPH,)
    for tag in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
} | {
    "li": (_PARAGRAPH, (("li",), _LISTS)), "dd": (_PARAGRAPH, (("dd", "dt"), _LISTS)), "dt": (_PARAGRAPH, (("dd", "dt"), _LISTS)),
    "td": ((("td", "th"), _ROWS),), "th": ((("td", "th"), _ROWS),), "tr": ((("tr",), _ROWS), (("td", "th"), _ROWS)),
    "option": ((("option",), ("select", "datalist")),),
} | {tag: ((("thead", "tbody", "tfoot"), _ROWS), (("tr",), _ROWS), (("td", "th"), _ROWS)) for tag in ("thead", "tbody", "tfoot")}
_EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())


#: What an element is by its tag and names: text, named furniture unless it holds most of the text, furniture.
_KEPT, _NAMED_APART, _IS_APART = 0, 1, 2


def _apart(tag: str, attributes: str, inside_text: bool) -> int:
    if tag in _APART_TAGS or tag == "header" and not inside_text:
        return _IS_APART
    if tag in ("body", "html", "article", "main"):
        return _KEPT
    out = _KEPT
    for found in _NAMED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(filter(None, re.split(r"[-_]+", name)))
            # A compound counts if it is made of such names alone: cookie-banner does, article-header doesn't.
            if words and words <= _APART:
                out = max(out, _IS_APART if words & _SURELY_APART else _NAMED_APART)
    return out


class Line(NamedTuple):
    """A block's text; ``holder`` numbers article and main elements, ``container`` all that hold blocks; 0 is outside."""

    text: str
    weight: int
    holder: int
    container: int
    apart: bool


class _TagEnds:
    """Where tags of a page end: at the first ``>`` outside quotes, or with the page.

    What follows a quote is found once and kept, and places are asked for in order, so a page takes linear time.
    """

    def __init__(self, page: str):
        self.page, self.next, self.known = page, -1, {}

    def __call__(self, at: int) -> tuple[int, int] | None:
        """Ends of the attributes that begin at ``at`` and of their tag; None if the page ends within a quote."""
        page, known = self.page, self.known
        if self.next < at:
            self.next = self._event(at)
        event, passed = self.next, []
        while event not in known:
            if event == len(page):
                known[event] = event, event
            elif page[event] == ">":
                known[event] = event, event + 1
            else:
                passed.append(event)
                closed = page.find(page[event], event + 1)
                if closed < 0:
                    known[event] = None
                else:
                    event = self._event(closed + 1)
        for x in passed:
            known[x] = known[event]
        return known[event]

    def _event(self, at: int) -> int:
        found = _EVENT.search(self.page, at)
        return found.start() if found else len(self.page)


def _markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``(start, end, closing, tag, attributes)``; comments, declarations and raw elements have no tag."""
    ends = _TagEnds(page)
    at = page.find("<")
    while at >= 0:
        end, closing, tag, attributes = -1, False, "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif raw := _RAW.match(page, at):
            found = _RAW_END[raw[1].lower()].search(page, raw.end())
            end = found.end() if found else len(page)
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2) + 1 or len(page)
        elif (name := _NAME.match(page, at)) and (found := ends(name.end())):
            closing, tag, attributes, end = bool(name[1]), name[2].lower(), page[name.end() : found[0]], found[1]
        if end >= 0:
            yield at, end, closing, tag, attributes
        at = page.find("<", max(at + 1, end))


class _Open(NamedTuple):
    """An open element: holder, container and named element are the innermost around it or itself, 0 for none."""

    tag: str
    kind: int
    holder: int
    container: int
    named: int


class _Stack:
    """The open elements, with their places by tag, so that no step looks through all of them."""

    def __init__(self):
        self.open: list[_Open] = [_Open("", _KEPT, 0, 0, 0)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.apart = self.opened = 0
        #: By the number of a named element, the one around it.
        self.outer: dict[int, int] = {}

    def top(self) -> _Open:
        return self.open[-1]

    def push(self, tag: str, attributes: str) -> None:
        above = self.open[-1]
        kind = _apart(tag, attributes, above.holder > 0)
        self.opened += 1
        number = self.opened
        if kind == _NAMED_APART:
            self.outer[number] = above.named
        self.places[tag].append(len(self.open))
        self.apart += kind == _IS_APART
        self.open.append(_Open(
            tag, kind, number if tag in _HOLDERS else above.holder, above.container if tag in _GROUPS else number, number if kind == _NAMED_APART else above.named
        ))

    def cut(self, at: int) -> None:
        """Ends the element at place ``at`` and all within it."""
        while len(self.open) > at:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            self.apart -= gone.kind == _IS_APART

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of ``tags``, 0 for none."""
        at = 0
        for tag in tags:
            if (places := self.places.get(tag)) and places[-1] > at:
                at = places[-1]
        return at

    def end_implied(self, tag: str) -> None:
        """Ends what HTML closes where ``tag`` opens."""
        for closed, bounds in _CLOSES.get(tag, ()):
            at = self.last(closed)
            if at and at > self.last(bounds):
                self.cut(at)


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    stack = _Stack()
    # The innermost named element around each line, and the text that each of them holds.
    within: list[int] = []
    held: Counter[int] = Counter()
    parts: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack.top()
            weight = 0 if stack.apart else max(0, len(text) - linked)
            out.append(Line(text, weight, top.holder, top.container, stack.apart > 0))
            within.append(top.named)
            held[top.named] += weight
        parts.clear()
        linked = 0

    at = 0
    for start, end, closing, tag, attributes in _markup(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        if closing:
            if opened := stack.last((tag,)):
                stack.cut(opened)
            continue
        stack.end_implied(tag)
        if tag not in _EMPTY:
            stack.push(tag, attributes)
    if at < len(page):
        parts.append(page[at:])
    close()
    # Named elements are numbered as they open, so inner ones come after those around them.
    for number in sorted(stack.outer, reverse=True):
        held[stack.outer[number]] += held[number]
    # A name is overruled where the text is: by most of what isn't furniture for sure, if that makes a surge. An
    # element holds at least what those within it hold, so the innermost name tells.
    least = max(SURGE, sum(x.weight for x in out) // 2 + 1)
    return [x._replace(weight=0, apart=True) if n and held[n] < least else x for x, n in zip(out, within, strict=True)]


def _extended(lines: list[Line], at: int, step: int) -> int:
    """The last of the lines from ``at`` on, apart ones aside, that share its container and are mostly not links."""
    container, end = lines[at].container, at
    while 0 <= (at := at + step) < len(lines):
        if not lines[at].apart:
            if lines[at].container != container or 2 * lines[at].weight <= len(lines[at].text):
                break
            end = at
    return end


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    weights = np.array([x.weight for x in lines], dtype=np.int64)
    if not len(weights):
        return ""
    sums = np.convolve(weights, np.ones(LINES, dtype=np.int64))
    # Window sums that begin and that end at each line.
    ahead, behind = sums[LINES - 1 :], sums[: len(weights)]
    high = np.flatnonzero((weights > 0) & (np.maximum(ahead, behind) >= SURGE))
    if not len(high):
        high = np.flatnonzero(weights)
    if not len(high):
        high = np.flatnonzero([not x.apart for x in lines])
    if not len(high):
        return ""
    surge, dive = _extended(lines, int(high[0]), -1), _extended(lines, int(high[-1]), 1)
    first, last = lines[surge].holder, lines[dive].holder
    if first:
        surge = next(i for i, x in enumerate(lines) if x.holder == first)
    if last:
        dive = next(i for i in range(len(lines) - 1, -1, -1) if lines[i].holder == last)
    return "\n".join(x.text for x in lines[surge : dive + 1] if not x.apart)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
