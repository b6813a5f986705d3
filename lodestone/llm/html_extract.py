"""Main text of web pages by equivalence classes of tokens over same-host pages.

Tokens of a page are its elements, named by their path of tags and classes, and
its text blocks at their path, of any length (by hash).  A token's *occurrence
vector* is its count on each page of its host.  It is kept as sums of a hash of
the page times the count, so vectors add up in partial aggregates and equal sums
mean equal vectors.  An ``article`` or ``main`` starts a path of its own, so that
what was left open around it doesn't change its name.

1. Tokens of a host with equal vectors are one class.  A class is *valid* if it
   stands on at least ``support`` of the host's pages, two at least, and either
   has several tokens or stands on every page.  Texts on so many pages are template
   too, if they are all that their element holds, or else if they stand on at least
   ``least`` pages: a line may return on two of three pages by chance.
2. The valid classes nest by path into the host's template: elements that occur
   once on each of their pages are its frame, the others stand in the frame's
   slots.  A *slot* is what an element of the template holds outside of the
   template's elements below.
3. From the top, the frame is descended as long as an element holds next to no
   varying text itself and one of those below holds its main headings and a fair
   part of the varying text, or, without headings, most of that.  Where this ends
   is the *container* of the main text.
4. Of the slots inside the container those go that repeat their text from page to
   page while the container does not, and those that are lists of links.  What is
   left, without the template's texts, is extracted in page order.

Last resort, where a template can't tell: blocks in menus, headers outside the
article, footers, sidebars, notices, adverts, forms and reader comments, told by
tag, role or a word of class or id (``words``), are left out; and pages of a host
without a template, such as a lone page, take their article or main element.
Scripts, styles and hidden elements never count.  Character references are decoded,
white space inside a block is one space, blocks are joined by a line feed.  Nothing
else is dropped or cut.

Statistics are aggregated before any shuffle, a host with a third of all pages
included; a page's text is never grouped by host.  The tokens of a template stand
on at least ``support`` of the pages, so it is at most 1 / ``support`` as large as
a page.  Templates are one row a host; they are broadcast while
measured to be under ``broadcast_bytes``, else joined by host.

Elements deeper than ``DEEP`` levels share a path by name.  A page is read in linear
time, whatever is left open, crossed or unquoted in it.

Defined cases: null or empty html gives an empty text; a null or bad url is the
host ''; unclosed, crossed and truncated tags are read as far as they go; a page
of any length is read to its end; pages without the host's container are read as
lone pages; a host of copies, where more than half of the text would be template,
has none; repeated rows each get their text; other columns are
not read, so their names can't clash; an empty table gives no rows."""

from __future__ import annotations

import dataclasses
import functools
import html as _html
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard, id_array, id_text
from .url_filter import url_host

_OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:\-]*)|([!?/]))")
_STOP = re.compile("[\"'<>]")
#: Levels of elements that have a path of their own; those below share the path of
#: the last one and add their own name.  It bounds paths, not what is read.
DEEP = 64
_ATTR = re.compile(r"([A-Za-z\-:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Tag names of the HTML standard by their part here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_OUT = frozenset("nav aside footer form script style noscript template iframe button select option textarea svg head title dialog menu object canvas audio video map datalist noembed noframes".split())
#: Of these the ones whose text is never shown as such.
_NEVER = frozenset("script style noscript template iframe option textarea svg head title object canvas audio video map datalist noembed noframes".split())
_SECTION = frozenset("article main".split())
_DIGITS = re.compile(r"\d+")
#: Words of class, id or role that mark what is no main text.
_OUT_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "notice notices notification alert cookie cookies consent gdpr disclaimer popup modal overlay comment comments commentlist disqus reply replies respond discussion responses "
    "share sharing social related recommended recommendations newsletter subscribe signup login search searchbox widget pagination pager toolbar complementary contentinfo "
    "skip masthead topbar bottombar".split()
)
_HEAD_WORDS = frozenset("header banner masthead".split())
_MAIN_WORDS = frozenset("article main post entry story".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


_TELLING = re.compile("class|id|role|style|aria", re.I)
_NO_WORDS: set[str] = set()


class _Node:
    __slots__ = ("tag", "path", "gone", "out", "inside", "comment", "heading", "section", "level", "base")

    def __init__(self, tag, path, gone, out, inside, comment, heading, section, level, base):
        self.tag, self.path, self.gone, self.out, self.inside, self.comment, self.heading = tag, path, gone, out, inside, comment, heading
        self.section, self.level, self.base = section, level, base


class _Open:
    """The open elements: a stack that knows where each tag and where the last block
    stands in it, so that no end tag searches it."""

    def __init__(self, root: _Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag not in _INLINE:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        found = self.places.get(tag)
        # an inline end tag closes no block
        if found and not (tag in _INLINE and self.blocks and self.blocks[-1] > found[-1]):
            self.cut(found[-1])


def _next(page: str, at: int, last: int) -> tuple[int, int, str, str, str] | None:
    """(start, end, slash, tag, attributes) of the next piece of markup, the tag empty
    where it counts for nothing; ``last`` is the place of the page's last ``>``.
    Quoted values may hold any sign; a tag whose quotes don't match ends at its first
    ``>``."""
    while m := _OPEN.search(page, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = page.find("-->", at)
            return start, len(page) if end < 0 else end + 3, "", "", ""
        if last < at:
            continue
        if m[4]:
            return start, page.find(">", at) + 1, "", "", ""
        p, name, end = at, at, -1
        while s := _STOP.search(page, p):
            if s[0] in "<>":
                end = s.start() if s[0] == ">" else -1
                break
            p = page.find(s[0], s.end()) + 1
            if not p:
                break
        if end < 0:
            end = page.find(">", name)
            if m[2]:
                return start, end + 1, "", "", ""
        return start, end + 1, m[2], m[3].lower(), page[name:end]
    return None


@functools.lru_cache(4096)
def _marks(attrs: str) -> tuple[str, set[str], bool]:
    """Path suffix, words of class, id and role, and whether it is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    said = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = {w for w in _SPLIT.split(_CAMEL.sub(" ", said).lower()) if w}
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs))
    name = found.get("class", "").split()[:1]
    suffix = ("." + _DIGITS.sub("0", name[0]) if name else "") + ("#" + _DIGITS.sub("0", found["id"]) if found.get("id") else "")
    return suffix, words, hidden


class Block:
    """A text block: its element's path, text, whether it is the main heading,
    whether it counts for the template and whether it is eligible as main text."""

    __slots__ = ("path", "text", "heading", "counts", "eligible")

    def __init__(self, path, text, heading, counts, eligible):
        self.path, self.text, self.heading, self.counts, self.eligible = path, text, heading, counts, eligible


def parse(page: str, words: bool = True) -> tuple[dict[str, list], list[Block]]:
    """Elements {path: [times, rank as a section]} and blocks in page order."""
    elements: dict[str, list] = {}
    blocks: list[Block] = []
    home = _Node("", "", False, False, False, False, False, None, 0, "")
    home.section = home
    opened = _Open(home)
    stack = opened.stack
    held: list[str] = []

    def flush():
        nonlocal held
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held = []
            if text:
                blocks.append(Block(home.path, text, home.heading, not home.gone, not home.out))

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        found = _next(page, at, last)
        stop = found[0] if found else size
        if stop > at:
            if not held:
                home = stack[-1]
            held.append(page[at:stop])
        if not found:
            break
        _, at, closing, tag, attrs = found
        if not tag:
            continue
        if closing:
            if tag not in _INLINE:
                flush()
            opened.end(tag)
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        top = stack[-1]
        if tag == "p" and top.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag in ("li", "tr", "td", "th", "dt", "dd", "option") and top.tag == tag:
            opened.cut(len(stack) - 1)
            top = stack[-1]
        suffix, marks, hidden = _marks(attrs) if attrs and _TELLING.search(attrs) else ("", _NO_WORDS, False)
        if not words:
            marks = _NO_WORDS
        outer = tag in _SECTION
        section = outer or "main" in marks and tag not in _INLINE
        comment = top.comment or bool(marks & _COMMENT_WORDS)
        inside = top.inside or section
        never = hidden or tag in _NEVER
        bad = never or tag in _OUT or bool(marks & _OUT_WORDS) or ((tag == "header" or marks & _HEAD_WORDS) and not inside)
        if section and not comment and not marks & _OUT_WORDS:
            gone = out = hidden  # an article ends what was left open around it
        else:
            gone, out = top.gone or never, top.out or bad or comment
        up = top.section if outer else top
        path = f"{up.path if up.level < DEEP else up.base}/{tag}{suffix}"
        node = _Node(tag, path, gone, out, inside and not out, comment, top.heading or tag == "h1", top.section, up.level + 1, path if up.level < DEEP else up.base)
        if outer:
            node.section = node
        opened.push(node)
        rank = 3 if tag == "article" else 2 if tag == "main" else 1 if section or marks & _MAIN_WORDS else 0
        e = elements.setdefault(node.path, [0, 0 if out else rank])
        e[0] += 1
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return elements, blocks


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def _within(path: str, root: str) -> bool:
    return not root or path == root or path.startswith(root + "/")


def _alone(elements: dict[str, list], blocks: list[Block]) -> str | None:
    """The article or main element of a page without a template: if it holds the
    main headings and some of the text, or a fair part of the text."""
    ok = [b for b in blocks if b.eligible]
    chars, heads, best = sum(len(b.text) for b in ok), sum(b.heading for b in ok), None
    # each block counts for the few sections above it
    held: dict[str, list[int]] = {p: [0, 0] for p, (_, rank) in elements.items() if rank}
    for b in ok if held else []:
        p = b.path
        while p:
            if p in held:
                held[p][0] += len(b.text)
                held[p][1] += b.heading
            p = p.rpartition("/")[0]
    for path, (n, h) in held.items():
        if n and (n >= 0.3 * chars or heads and h >= heads and n >= 0.05 * chars):
            best = max(best or (False, 0, 0, 0, ""), (h >= heads, elements[path][1], n, -path.count("/"), path))
    return best[-1] if best else None


@dataclasses.dataclass(frozen=True)
class Template:
    """Of a host: the container's path, paths of slots that are no main text, and
    the keys of the template's texts."""

    container: str | None = None
    without: tuple[str, ...] = ()
    texts: frozenset[int] = frozenset()


def extract(page: str | None, template: Template | None = None, words: bool = True) -> str:
    """The main text of a page, given its host's template."""
    if not page:
        return ""
    elements, blocks = parse(page, words)
    template = template or Template()
    without, texts = template.without, template.texts
    ok = [b for b in blocks if b.eligible]
    taken = [b for b in ok if template.container is not None and _within(b.path, template.container)]
    if not taken:
        root = _alone(elements, blocks)
        taken = [b for b in ok if root is None or _within(b.path, root)]
    taken = [b for b in taken if not any(_within(b.path, x) for x in without)]
    return "\n".join(b.text for b in taken if not texts or _key("t", b.path, b.text) not in texts)


_STATS = "host string, token long, path string, element boolean, pages long, times long, chars long, headings long, v1 long, v2 long"
_HALF = (1 << 30) - 1


def _count(words: bool):
    """Statistics of the tokens of each batch, already summed by host."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            sums: dict[tuple, list] = {}
            for key, host, page in zip(pdf["__id"].tolist(), pdf["__host"].tolist(), pdf["__html"].tolist()):
                elements, blocks = parse(page or "", words)
                if not elements and not blocks:
                    continue
                h = _key(host, str(key)) & (1 << 60) - 1
                rows: dict[tuple, list] = {("", True): [1, 0, 0]}
                for p, e in elements.items():
                    rows[p, True] = [e[0], 0, 0]
                for b in blocks:
                    if b.counts:
                        # an element has the characters of the text right in it
                        e = rows.setdefault((b.path, True), [1, 0, 0])
                        e[1] += len(b.text)
                        e[2] += len(b.text) * b.heading
                        t = rows.setdefault((b.path, b.text), [0, 0, 0])
                        t[0] += 1
                        t[1] += len(b.text)
                for (path, text), (times, chars, heads) in rows.items():
                    token = _key("e", path) if text is True else _key("t", path, text)
                    s = sums.setdefault((host, token), [path, text is True, 0, 0, 0, 0, 0, 0])
                    s[2] += 1
                    s[3] += times
                    s[4] += chars
                    s[5] += heads
                    s[6] += (h & _HALF) * times
                    s[7] += (h >> 30) * times
            yield pd.DataFrame([[host, t, *s] for (host, t), s in sums.items()], columns=[c.split()[0] for c in _STATS.split(", ")])

    return run


def choose(slots: list[tuple[str, bool, int, int, int, int, float]]) -> tuple[str | None, list[str]]:
    """(container, slots left out of it) of a template.  ``slots``: (path, in the
    frame, varying characters, of these repeated, in links and in main headings,
    blocks a page), each of what the path's element holds outside of those below."""
    by = {s[0]: s for s in slots}
    frame = sorted((s[0] for s in slots if s[1]), key=lambda p: p.count("/"))
    below: dict[str, list[str]] = {}
    for p in frame:
        if p:
            below.setdefault(max((q for q in frame if q != p and _within(p, q)), key=len), []).append(p)
    body, heads = {}, {}
    for p in frame:
        own = [s for s in slots if _within(s[0], p)]
        heads[p] = sum(s[5] for s in own)
        body[p] = sum(s[2] for s in own) - heads[p]
    at = ""
    while body[at] > 0 and by[at][2] - by[at][5] <= 0.1 * body[at]:
        if heads[at]:
            fits = [p for p in below.get(at, []) if heads[p] >= 0.9 * heads[at] and body[p] >= 0.2 * body[at]]
        else:
            fits = [p for p in below.get(at, []) if body[p] >= 0.5 * body[at]]
        if not fits:
            break
        at = max(fits, key=lambda p: (body[p], p))
    if not at:
        return None, []
    share = by[at][3] / max(1, by[at][2])
    without = []
    for path, _, chars, again, links, head, blocks in slots:
        if path != at and _within(path, at) and chars and not head:
            if again >= 0.5 * chars and again >= 3 * share * chars or links >= 0.8 * chars and blocks > 1:
                without.append(path)
    return at, sorted(without)


def deduce_templates(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     support: float = 0.5, least: int = 5, words: bool = True) -> DataFrame:
    """(host, container, without, texts) of every host with a template."""
    rows = pages.select(F.col(id_col).cast("string").alias("__id"), F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("__host"), F.col(html_col).alias("__html"))
    stats = rows.mapInPandas(_count(words), _STATS).groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("element").alias("element"),
        *[F.sum(c).alias(c) for c in ("pages", "times", "chars", "headings", "v1", "v2")],
    )
    # a text on a single page is in no valid class
    stats = cut(stats.where("element OR pages > 1"), "token-vectors")
    whole = stats.where("element AND path = ''").select("host", F.col("pages").alias("n"), F.col("v1").alias("every1"), F.col("v2").alias("every2")).where("n > 1")
    enough = F.greatest(F.lit(2), F.ceil(F.col("n") * support))
    # classes: equal vectors; they are counted by partial sums before the shuffle
    common = stats.join(whole, "host").where(F.col("pages") >= enough)
    classes = common.groupBy("host", "v1", "v2").agg(F.count("*").alias("tokens"))
    common = common.join(classes, ["host", "v1", "v2"])
    valid = common.where("element AND (tokens > 1 OR v1 = every1 AND v2 = every2)")
    template = valid.select("host", "path", F.expr("times = pages").alias("frame"))
    frequent = common.where("NOT element").select("host", "token", "path", "chars", "pages")
    whole_text = stats.where("element").select("host", "path", F.col("chars").alias("all"))
    bound = frequent.groupBy("host", "path").agg(F.sum("chars").alias("same")).join(whole_text, ["host", "path"]).where("same >= 0.9 * all")
    texts = frequent.join(bound.select("host", "path", F.lit(True).alias("bound")), ["host", "path"], "left")
    texts = texts.where(F.col("bound") | (F.col("pages") >= least)).select("host", "token", "path", "chars")

    # what each element holds by itself goes to the nearest element of the template above
    again = stats.where("NOT element").groupBy("host", "path").agg(F.sum("chars").alias("again"))
    fixed = texts.groupBy("host", "path").agg(F.sum("chars").alias("fixed"))
    held = stats.where("element AND chars > 0").join(whole.select("host"), "host", "left_semi")
    held = held.join(again, ["host", "path"], "left").join(fixed, ["host", "path"], "left").select(
        "host", "path", "times", "pages", "headings", "chars", F.coalesce("again", F.lit(0)).alias("again"), F.coalesce("fixed", F.lit(0)).alias("fixed")
    ).withColumn("headings", F.greatest(F.col("headings") - F.col("fixed"), F.lit(0)))
    parts = F.split("path", "/")
    above = held.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    near = above.join(template.withColumnsRenamed({"path": "up"}), ["host", "up"]).groupBy("host", "path").agg(
        F.max_by("up", F.length("up")).alias("slot"), *[F.first(c).alias(c) for c in ("times", "pages", "headings", "chars", "again", "fixed")]
    )
    link = F.when(F.col("path").rlike("/a([.#][^/]*)?$"), F.col("chars") - F.col("fixed")).otherwise(0)
    slots = near.groupBy("host", "slot").agg(
        F.sum(F.col("chars") - F.col("fixed")).alias("varying"), F.sum(F.col("again") - F.col("fixed")).alias("again"), F.sum(link).alias("links"),
        F.sum("headings").alias("headings"), F.max(F.col("times") / F.col("pages")).alias("blocks"), F.sum("fixed").alias("fixed"), F.sum("chars").alias("chars"),
    )
    every = template.join(slots.withColumnRenamed("slot", "path"), ["host", "path"], "left").na.fill(0)
    every = every.groupBy("host").agg(F.collect_list(F.struct("path", "frame", "varying", "again", "links", "headings", "blocks", "fixed", "chars")).alias("slots"))
    every = every.join(texts.groupBy("host").agg(F.collect_list(F.struct("path", "token", "chars")).alias("texts")), "host", "left")

    def settle(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for host, slots, texts in zip(pdf["host"].tolist(), pdf["slots"].tolist(), pdf["texts"].tolist()):
                # a template of one page's elements, at most 1 / support of them
                container, without = choose([(s["path"], s["frame"], s["varying"], s["again"], s["links"], s["headings"], s["blocks"]) for s in slots])
                inside = [s for s in slots if _within(s["path"], container or "")]
                # on a host of copies everything repeats
                copies = sum(s["fixed"] for s in inside) > 0.5 * sum(s["chars"] for s in inside)
                keys = [] if copies or texts is None else [t["token"] for t in texts]
                if not copies:
                    out.append((host, container, without, keys))
            yield pd.DataFrame(out, columns=["host", "container", "without", "texts"])

    out = cut(every.mapInPandas(settle, "host string, container string, without array<string>, texts array<long>"), "templates")
    discard(stats)
    return out


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      support: float = 0.5, least: int = 5, words: bool = True, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; ``words`` off
    leaves out the words of class and id."""
    templates = deduce_templates(pages, id_col=id_col, url_col=url_col, html_col=html_col, support=support, least=least, words=words)
    names = F.aggregate("without", F.lit(0), lambda a, x: a + F.length(x))
    size = templates.agg(F.sum(F.length("host") + F.coalesce(F.length("container"), F.lit(0)) + names + 64 + 8 * F.size("texts"))).first()[0] or 0
    rows = pages.select(id_text(F.col(id_col)).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("__html"))
    joined = rows.join(F.broadcast(templates) if size <= broadcast_bytes else templates, "host", "left").select("page_id", "url", "host", "__html", "container", "without", "texts")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            known: dict[str, Template | None] = {}
            texts = []
            for html, host, container, without, keys in zip(*(pdf[c].tolist() for c in ("__html", "host", "container", "without", "texts"))):
                if host not in known:
                    known[host] = None if keys is None else Template(container, tuple(without), frozenset(keys.tolist()))
                texts.append(extract(html, known[host], words))
            yield pd.DataFrame({"page_id": id_array(pdf["page_id"]), "url": pdf["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
