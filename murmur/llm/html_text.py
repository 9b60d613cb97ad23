"""Main-text extraction by line-block distribution.

A page becomes a list of lines, one per block element, after markup, scripts,
styles and regions that declare themselves as no article (menus, headers,
footers, side bars, notices, adverts, forms, reader comments) are stripped; a
stripped region leaves a gap of empty lines. The text lengths of ``WINDOW``
successive lines are summed at every line; lines that are mostly links count
nothing. Text begins where that sum surges over zero and ends where it dives to
zero again. Runs whose sums reach ``SURGE`` characters are text (the one with
the highest sum if none does).

``article`` and ``main`` do not decide, they widen: where a run of text lies in
the innermost kind of container that the page has, all lines of that kind are
kept, short paragraphs, link lists and what a stripped advert cut off too, and
lines outside are not. A container without such a run is passed over.

Outside articles a class or id word such as ``comments`` or ``sidebar`` is
enough to strip a region. Inside an article a name strips only if it says
nothing else (``comment-list``, not ``alert-level``); any other region named so
is judged by the distribution: it stays if its own sums reach ``SURGE`` and not
more than half of its text is links.

Defined results: null or empty html, or a page without text, gives ``""``;
repeated pages give repeated rows; a page of any length is read whole, in time
linear in its length, however its tags and quotes are left open; only the html
column is read, so other columns may have any name.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

_TAG = re.compile(
    r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<attrs2>[^>]*+)>)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_RAW_END = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {  # an open element that a start tag ends, and where the search stops
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
_SCOPE = frozenset("article main section div body html td th li blockquote table nav aside footer header form button "
                   "ul ol dl details figure fieldset dialog".split())
_DROP = frozenset("head nav footer aside form menu dialog svg math select button object canvas audio video datalist "
                  "applet map fieldset".split())
_NAMED = frozenset("div section ul ol dl table p li article aside span details figure header center tbody tr td".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo "
    "promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus respond reply replies discussion widget widgets toolbar pagination pager copyright form search paywall "
    "banner".split())
_HEADER_HINTS = frozenset(("header", "topbar"))
_CONTAINER_HINTS = frozenset("ad ads advert sponsored promo comment comments reply replies related teaser".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                   "toolbar tablist status".split())
_NOT_BEFORE = frozenset(("with", "has", "no", "without", "non", "in"))
# Words of a name that say nothing about its content.
_PLAIN = frozenset("list box wrap wrapper container section area block bar button buttons link links item items post posts "
                   "article articles slot unit inner outer panel module content group row col column title heading thread body "
                   "top bottom left right main page site inline text entry section id js".split())
# Hints that name parts of articles too.
_VAGUE = frozenset("discussion notice notices response respond search form alert header footer social share signup login "
                   "navigation".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _hinted(value: str, hints: frozenset[str]) -> bool:
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if any(w in hints and not (i and words[i - 1] in _NOT_BEFORE) for i, w in enumerate(words)):
            return True
    return False


def _only_hints(value: str, hints: frozenset[str]) -> bool:
    """Does one of the names say what ``hints`` say, unmistakably, and nothing else?"""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        own = [w for w in words if not w.isdigit() and w not in _PLAIN]
        if own and all(w in hints for w in own) and any(w not in _VAGUE for w in own):
            return True
    return False


def _boilerplate(name: str, attrs: str, in_article: bool) -> int:
    """2: the element declares itself as no text; 1: its name alone suggests so, inside an article; 0: neither."""
    if name in _DROP or (name == "header" and not in_article):
        return 2
    if not attrs.strip() or name in ("html", "body"):
        return 0
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return 2
    if any(r in _ROLES for r in a.get("role", "").lower().split()):
        return 2
    named = f"{a.get('class', '')} {a.get('id', '')}"
    if name in ("article", "main"):
        return 2 if _hinted(named, _CONTAINER_HINTS) else 0
    if name not in _NAMED:
        return 0
    if not in_article:
        return 2 if _hinted(named, _HINTS) or _hinted(named, _HEADER_HINTS) else 0
    return (2 if _only_hints(named, _HINTS) else 1) if _hinted(named, _HINTS) else 0


class _Lines:
    """Lines of a page: (text, characters in links, 2 in an article, 1 in main, else 0, number of its suspect region)."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int]] = []
        self._parts: list[str] = []
        self._links = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if linked:
            self._links += len("".join(text.split()))

    def end(self, where: int, region: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self.rows.append((text, self._links, where, region))
            self._parts, self._links = [], 0

    def gap(self) -> None:
        self.rows.extend([("", 0, 0, 0)] * WINDOW)


class _Open:
    """The open elements, (name, dropped, container level, inside a link, suspect region), and where each name is."""

    def __init__(self, out: _Lines):
        self.out = out
        self.rows: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, 0)]
        self._at: dict[str, list[int]] = {}
        self._blocks, self._scopes = [0], [0]

    def top(self) -> tuple[str, bool, int, bool, int]:
        return self.rows[-1]

    def push(self, row: tuple[str, bool, int, bool, int]) -> None:
        k = len(self.rows)
        self.rows.append(row)
        self._at.setdefault(row[0], []).append(k)
        if row[0] not in _INLINE:
            self._blocks.append(k)
        if row[0] in _SCOPE:
            self._scopes.append(k)

    def last(self, *names: str) -> int:
        """Where the innermost open element of these names is; 0 if none is open."""
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def last_block(self) -> int:
        return self._blocks[-1]

    def last_scope(self) -> int:
        return self._scopes[-1]

    def pop_to(self, k: int) -> None:
        while len(self.rows) > k:
            name, dropped, level, _, region = self.rows[-1]
            if name not in _INLINE:
                self.out.end(level, region)
            self.rows.pop()
            at = len(self.rows)
            self._at[name].pop()
            for marks in (self._blocks, self._scopes):
                if marks[-1] == at:
                    marks.pop()
            if dropped and not self.rows[-1][1]:
                self.out.gap()


def _tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(begin, end, match) of every tag, comment and declaration; the match is None for all but tags and CDATA texts.

    An element without markup (a script) ends with its close tag. Every scan ends at something that is known to come, or
    takes all up to it, so the whole is linear.
    """
    at, last, last_data = 0, page.rfind(">"), page.rfind("]]>")
    while (at := page.find("<" if at < last else "<!--", at)) >= 0:
        m, end = None, at + 1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None
        elif page.startswith("<![CDATA[", at) and at + 9 <= last_data:
            m = _DATA.match(page, at)
            end = m.end()
            yield at, end, m
        elif page.startswith(("<!", "<?"), at) and at < last:
            end = page.find(">", at) + 1
            yield at, end, None
        elif at < last and (m := _TAG.match(page, at)):
            end, name = m.end(), m["name"].lower()
            if name in _RAW and not m["close"]:
                close = _RAW_END[name].search(page, end)
                end = close.end() if close else len(page)
            yield at, end, m
        at = end


_DATA = re.compile(r"<!\[CDATA\[(?P<cdata>.*?)\]\]>", re.S)


def page_lines(page: str) -> list[tuple[str, int, int, int]]:
    """The lines, in one pass over the markup."""
    out = _Lines()
    stack = _Open(out)
    at, regions = 0, 0

    def text_to(end: int) -> None:
        _, dropped, _, linked, _ = stack.top()
        if end > at and not dropped:
            out.add(_html.unescape(page[at:end]), linked)

    for begin, end, m in _tokens(page):
        text_to(begin)
        at = end
        if m is None:
            continue
        _, dropped, level, linked, region = stack.top()
        if m.re is _DATA:
            if m["cdata"] and not dropped:
                out.add(m["cdata"], linked)
            continue
        name, attrs = m["name"].lower(), m["attrs"] if m["attrs"] is not None else m["attrs2"]
        if m["close"]:
            k = stack.last(name)
            if k and (name not in _INLINE or k >= stack.last_block()):
                stack.pop_to(k)
            elif name == "br" and not dropped:
                out.add(" ", False)
            continue
        if name in _RAW:
            continue
        if name == "br":
            if not dropped:
                out.add(" ", False)
            continue
        block = name not in _INLINE
        if block and name not in _VOID:
            if stack.last("p") > stack.last_scope():  # a block ends an open paragraph
                stack.pop_to(stack.last("p"))
            if name in _CLOSES:
                ends, stop = _CLOSES[name]
                k = stack.last(*ends.split())
                if k > stack.last(*stop):
                    stack.pop_to(k)
        _, dropped, level, linked, region = stack.top()
        if block and name != "img" and name != "wbr":
            out.end(level, region)
        if name in _VOID or attrs.rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in ("article", "main") and dropped and stack.top()[0] == "form":
            dropped = False  # a page that wraps everything in one form
        says = 2 if dropped else _boilerplate(name, attrs, level == 2)
        if says and not dropped:
            out.end(level, region)
            if says == 2:
                out.gap()
            elif not region:
                regions += 1
                region = regions
        if name == "article" or "articleBody" in attrs:
            level = 2
        elif name == "main" and level == 0:
            level = 1
        stack.push((name, says == 2, level, linked or name == "a", region))
    text_to(len(page))
    stack.pop_to(1)
    out.end(0, 0)
    return out.rows


def _runs(weights: list[int]) -> Iterator[tuple[int, int, int]]:
    """(surge, dive, peak) of the windowed sums: over zero until a sum of zero."""
    begin, peak = None, 0
    for i in range(len(weights)):
        s = sum(weights[i:i + WINDOW])
        if begin is None:
            if s > 0:
                begin, peak = i, s
        elif s == 0:
            yield begin, i, peak
            begin = None
        else:
            peak = max(peak, s)
    if begin is not None:
        yield begin, len(weights), peak


def _weights(rows: list[tuple[str, int, int, int]]) -> list[int]:
    return [len(text) if 2 * links <= len(text) else 0 for text, links, _, _ in rows]


def _judged(rows: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The lines without the suspect regions that do not read as text."""
    regions: dict[int, list[tuple[str, int, int, int]]] = {}
    for row in rows:
        if row[3]:
            regions.setdefault(row[3], []).append(row)
    gone = {k for k, own in regions.items()
            if 2 * sum(r[1] for r in own) > sum(len(r[0]) for r in own)
            or max((peak for _, _, peak in _runs(_weights(own))), default=0) < SURGE}
    return [("", 0, 0, 0) if r[3] in gone else r for r in rows] if gone else rows


def main_text(page: str | None) -> str:
    """The main text of one page: its kept lines in page order, joined by a line feed."""
    if not page:
        return ""
    rows = _judged(page_lines(page))
    weights = _weights(rows)
    found = list(_runs(weights))
    kept = [r for r in found if r[2] >= SURGE] or sorted(found, key=lambda r: (-r[2], r[0]))[:1]
    lines = [i for a, b, _ in kept for i in range(a, b) if weights[i]]
    top = max((rows[i][2] for i in lines), default=0)
    if top:
        lines = [i for i, (text, _, where, _) in enumerate(rows) if text and where >= top]
    elif not lines:
        # Nothing but links: the text of the innermost container, if the page has one.
        top = max((where for text, _, where, _ in rows if text), default=0)
        lines = [i for i, (text, _, where, _) in enumerate(rows) if top and text and where >= top]
    return "\n".join(rows[i][0] for i in lines)


def extracted(html_col: Column) -> Column:
    """The main text of an html column (Arrow batches; a page is parsed on its own)."""
    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p) for p in batch], dtype=object)
    return run(html_col)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text",
                      n_chars_col: str = "n_chars") -> DataFrame:
    """``pages`` without its html, with the main text and its length in code points."""
    kept = [c for c in pages.columns if c not in (html_col, text_col, n_chars_col)]
    out = pages.select(*[pages[f"`{c}`"] for c in kept], extracted(pages[f"`{html_col}`"]).alias(text_col))
    return out.withColumn(n_chars_col, F.length(F.col(text_col)).cast("long"))
