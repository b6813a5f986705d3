"""Pages to structured content, one parse a page, in a UDF of a page at a time.

A page is read once, from start to end, into a flat list of its pieces of text and
of the elements that matter; an element is a span of pieces, so no tree is built or
walked and time and memory grow with the page, whatever is left open in it.  The
structure follows the input as written: an element stays open until its end tag or
that of an ancestor, an end tag without an open element counts for nothing.  The text
of a heading, link, ``pre`` or ``code`` ends at the latest where the next of its kind
starts, as in a browser; only pages with such elements left open differ by it.  Text of
scripts, styles, templates and comments counts for nothing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAGE
from .text import FURNITURE
from .urls import NO_PAGE

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MUTE = frozenset("script style template".split())
_FURNITURE = re.compile(FURNITURE)
_NO_PAGE = re.compile(NO_PAGE)
_AUTHORITY = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)")
#: Where the main content is looked for, in this order.
MAIN = ["main", "role=main", ".main-content", ".content", ".documentation", "article", ".markdown-body"]

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_KEY = re.compile(r"=?[^\s/>=]*+")
_IS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


def tokens(page: str) -> Iterator[tuple]:
    """("text", str), ("start", tag, attributes, closed at once) and ("end", tag) in
    page order.  Every character is passed a bounded number of times: names and bare
    values never give back what they matched, and quotes are searched only where one
    more is known to follow.  A tag that the page ends within is left out."""
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while at < size:
        i = page.find("<", at)
        if i < 0 or i > last[">"]:
            yield "text", unescape(page[at:])
            return
        if i > at:
            yield "text", unescape(page[at:i])
        follows = page[i + 1 : i + 2]
        if follows == "/":
            m, stop = _NAME.match(page, i + 2), page.find(">", i + 2)
            if m:
                yield "end", m[0].lower()
            at = stop + 1
        elif follows in ("!", "?"):
            comment = page.startswith("<!--", i)
            stop = page.find("-->", i + 4) if comment else page.find(">", i)
            if stop < 0:
                return
            at = stop + (3 if comment else 1)
        elif m := _NAME.match(page, i + 1):
            attrs: dict[str, str] = {}
            at = m.end()
            while True:
                at = _GAP.match(page, at).end()
                if at >= size:
                    return
                if page[at] == ">":
                    break
                key = _KEY.match(page, at)
                at, value = key.end(), ""
                if given := _IS.match(page, at):
                    at = given.end()
                    quote = page[at : at + 1]
                    if quote in ("'", '"') and at < last[quote]:
                        stop = page.find(quote, at + 1)
                        value, at = page[at + 1 : stop], stop + 1
                    else:
                        bare = _BARE.match(page, at)
                        value, at = bare[0], bare.end()
                attrs[key[0].lower()] = unescape(value)
            tag, closed = m[0].lower(), page[at - 1] == "/"
            at += 1
            yield "start", tag, attrs, closed
            if tag in _RAW_END and not closed:
                end = _RAW_END[tag].search(page, at)
                if not end:
                    return
                at = end.start()
        else:
            yield "text", "<"
            at = i + 1


class _Element:
    """An element by its place: ``first`` and ``last`` of the pieces of text that it
    holds, and the place of the first element after it."""

    __slots__ = ("tag", "attrs", "first", "last", "after")

    def __init__(self, tag: str, attrs: dict, first: int):
        self.tag, self.attrs, self.first, self.last, self.after = tag, attrs, first, None, None


def _kind(tag: str) -> str | None:
    """The group of elements that don't hold each other's text."""
    return "h" if re.fullmatch("h[1-6]", tag) else tag if tag in ("a", "code", "pre") else None


class Page:
    """The pieces of visible text of a page and its elements in page order."""

    def __init__(self, html: str):
        self.pieces: list[str] = []
        self.elements: list[_Element] = []
        stack: list[_Element] = []
        open_tags: Counter = Counter()
        latest: dict[str, _Element] = {}
        for kind, *more in tokens(html):
            if kind == "text":
                if not any(open_tags[t] for t in _MUTE):
                    self.pieces.append(more[0])
            elif kind == "start":
                tag, attrs, closed = more
                e = _Element(tag, attrs, len(self.pieces))
                self.elements.append(e)
                if group := _kind(tag):
                    if (before := latest.get(group)) is not None and before.last is None:
                        before.last = len(self.pieces)
                    latest[group] = e
                if tag in _VOID or closed:
                    e.last, e.after = e.first, len(self.elements)
                else:
                    stack.append(e)
                    open_tags[tag] += 1
            elif open_tags[more[0]]:
                while True:
                    e = stack.pop()
                    open_tags[e.tag] -= 1
                    self._end(e)
                    if e.tag == more[0]:
                        break
        for e in stack:
            self._end(e)

    def _end(self, e: _Element) -> None:
        e.after = len(self.elements)
        if e.last is None:
            e.last = len(self.pieces)

    def text(self, e: _Element) -> str:
        return clean("".join(self.pieces[e.first : e.last]))

    def within(self, place: int) -> list[_Element]:
        return self.elements[place + 1 : self.elements[place].after]


def clean(text: str) -> str:
    return _FURNITURE.sub("", re.sub(r"\s+", " ", text.strip()))


def _fits(e: _Element, where: str) -> bool:
    if where.startswith("."):
        return where[1:] in e.attrs.get("class", "").split()
    return e.attrs.get("role") == "main" if where == "role=main" else e.tag == where


def _internal(url: str, base: str) -> bool:
    a, b = _AUTHORITY.match(url), _AUTHORITY.match(base)
    return (a and a[1]) == (b and b[1]) and not _NO_PAGE.search(url.lower()) and "#" not in url


def _links(page: Page, elements: list[_Element], url: str, base: str) -> list[dict]:
    out = []
    for e in elements:
        if e.tag == "a" and "href" in e.attrs:
            try:
                full = urljoin(url, e.attrs["href"])
            except ValueError:
                continue
            if _internal(full, base):
                out.append({"text": page.text(e), "url": full})
    return out


def read_page(html: str | None, url: str | None, base: str | None) -> dict:
    """Title, main content, headings, code and same-site links of a page, and the
    same-site links of the whole page."""
    out = {"url": url, "title": "", "content": "", "sections": [], "code_blocks": [], "links": []}
    if not html:
        return out | {"all_links": []}
    page = Page(html)
    firsts: dict[str, int] = {}
    for k, e in enumerate(page.elements):
        for w in ("title", "h1", "body", *MAIN):
            if w not in firsts and _fits(e, w):
                firsts[w] = k
    named = firsts.get("title", firsts.get("h1"))
    if named is not None:
        out["title"] = page.text(page.elements[named])
    scope = next((firsts[w] for w in [*MAIN, "body"] if w in firsts), None)
    url, base = url or "", base or url or ""
    if scope is not None:
        inside = page.within(scope)
        out["content"] = page.text(page.elements[scope])
        for e in inside:
            kind = _kind(e.tag)
            if kind == "h" and len(t := page.text(e)) > 3:
                out["sections"].append({"level": int(e.tag[1]), "text": t})
            elif kind in ("code", "pre") and len(t := page.text(e)) > 10:
                out["code_blocks"].append(t)
        out["links"] = _links(page, inside, url, base)
    return out | {"all_links": [x["url"] for x in _links(page, page.elements, url, base)]}


_RESULT = T.StructType([*PAGE.fields, T.StructField("all_links", T.ArrayType(T.StringType()))])


@F.udf(_RESULT, useArrow=False)
def extract_page(html: str | None, url: str | None, base: str | None) -> dict:
    """A page at a time: an Arrow batch would hold the parts of 10,000 pages at once."""
    return read_page(html, url, base)
