"""HTML extraction (operator 5): template deduction by equivalence classes.

A page is read as a stream of tokens: its elements, each with its path of tags
and classes, and its blocks of text with their path. A token's occurrence
vector has its number of occurrences on every page of the host. Tokens of a
host with one vector form an equivalence class. A class is valid if it occurs
on at least half of the host's pages (three at least) and has two tokens or is
nested in a slot of a valid class; the valid classes nest by their paths into
the host's template. Vectors are compared as sums of hashes of (page, count),
so they are combined before the shuffle and no host's pages ever meet in a task.
Pages of a host with the same html are one page to all this.

What the template leaves open are slots. Text in an ``article`` or ``main`` slot
is the main text, fixed text in it included: a heading that all pages have, or a
line before varying text, belongs to the article. Only a slot of its own that holds
nothing but fixed text on any page, and that no varying text follows in the
article, is the template's there (headings and captions never are). Fixed text in a
slot that also holds varying text cannot be told from the article's and stays.
Pages without article or main give the slots that are not mostly links, without
the template's own text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, told by tag, role, class or id, are left out everywhere (a header
inside an article stays). Class and id count only on elements that can hold
blocks, never on a paragraph, heading or inline element; a name that begins with
has, with, no or without does not count; nor do those of ``html``, ``body``, an
``article`` or ``main``, of what holds it, or, on a page without one, of an element
that holds over half of the page's other text. An article inside another is a
comment if its names say so. Character references are decoded, white space inside
a block becomes one space, blocks are joined by one line feed; nothing else is cut.

Reading takes linear time: a tag whose quotes do not close ends at the next ``>``
(and from then on quotes count no more on that page), elements nest 512 deep at most.

Defined results: null html gives empty text; a null or odd url is a host of its
own (the empty one); broken markup closes what it must (a block opens: an open
paragraph ends); repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Pages of one host are spread over this many keys when they meet the template.
SALTS = 32
#: Slots for the keys of contents that a host has more than once.
COPY_SLOTS = 1 << 22

# What HTML says of its elements, and names that sites use.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "title", "textarea", "object", "canvas", "head"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select",
         "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An element that begins ends an open one of these, up to the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "menu"}
MAIN = {"article", "main"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "label"}
ASIDE_ROLES = {"navigation", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar",
               "toolbar", "form", "note", "status"}
ASIDE_NAMES = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies",
               "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
               "subscribe", "subscription", "signup", "login", "ad", "ads", "advert", "adverts", "advertisement",
               "advertisements", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "commentlist", "disqus",
               "reply", "replies", "respond", "social", "share", "sharing", "related", "recommended", "recommendations",
               "widget", "toolbar", "pagination", "pager", "copyright", "skip", "search", "aside", "disclaimer"}
HEAD_NAMES = {"header", "masthead", "banner", "topbar"}
#: Names count on these only.
HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "header", "article", "figure", "address", "blockquote"}
#: Fixed text in these is the article's own.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption", "th", "dt", "legend", "summary"}
#: A name that begins with one of these speaks of something else.
NEGATIONS = ("has", "with", "no", "without")
DEPTH = 512

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    path: int           # hash of the path of tags and classes
    main: bool          # inside an article or main element
    aside: bool         # inside something that is not main text, by tag, role or hiding
    link: bool = False
    begins: bool = False    # is an article or main element itself
    named: bool = False     # its class or id has a name of what is not main text
    holds: bool = False     # has the article or main element in it: names do not count
    parent: "Element | None" = None
    off: bool = False       # inside something that is not main text, names included
    block: "Element | None" = None  # itself or the nearest element around it that breaks blocks
    chars: int = 0          # of the text inside that no tag, role or other name leaves out


@dataclass
class Block:
    text: str
    path: int
    main: bool
    aside: bool
    link_chars: int     # characters of the text that stand in links
    heading: bool = False


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    paths: Counter = field(default_factory=Counter)
    parents: dict[int, int] = field(default_factory=dict)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), 7) >> 1


def _opened(tag: str, attrs: str, top: Element) -> Element:
    names, role, hidden = "", "", False
    if attrs and not attrs.isspace():
        for m in _NAMED.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("class", "id"):
                names += " " + value
            elif kind == "role":
                role = value.lower()
            elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and _HIDDEN.search(value):
                hidden = True
    words = set()
    if tag in HOLDERS:
        for name in names.split():
            parts = [w.lower() for w in _WORD.findall(name)]
            if parts and parts[0] not in NEGATIONS:
                words.update(parts)
    begins = tag in MAIN or role == "main"
    main = top.main or begins
    aside = top.aside or hidden or tag in ASIDE or role in ASIDE_ROLES or not main and (tag == "header" or role == "banner")
    named = bool(words & ASIDE_NAMES) or not main and bool(words & HEAD_NAMES)
    return Element(tag, _hash(top.path, tag, " ".join(names.split())) & ~1, main, aside, top.link or tag == "a", begins, named, parent=top)


def _begun(stack: list[Element], new: Element, led: set[int]):
    """Names do not count on an article or main element, nor on what holds it. An article
    in an article is a comment, as HTML has it; of the articles in a main element only
    the first speaks for what holds it (``led``: the main elements that had theirs)."""
    outer = next((k for k, e in enumerate(stack) if e.begins), len(stack))
    if any(e.tag == "article" for e in stack[outer:]):
        return
    new.holds = True
    if outer == len(stack) or id(stack[outer]) not in led:
        for e in stack:
            e.holds = True
        if outer < len(stack):
            led.add(id(stack[outer]))


class _Scanner:
    """The tags of a source, in linear time: (start, end, closing, name, attributes)."""

    def __init__(self, source: str):
        self.source, self.quoted = source, True
        self.missing: set[str] = set()  # raw elements without an end tag further on

    def tag(self, at: int) -> tuple[int, int, str, str, str] | None:
        source = self.source
        while True:
            start = source.find("<", at)
            if start < 0:
                return None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, "", "", ""
            shut = source.find(">", start)
            if shut < 0:
                return None  # nothing closes any more
            m = _TAG.match(source, start)
            if m:
                end = self._end(m.end(), shut)
                return start, end + 1, m[1], m[2].lower(), source[m.end():end]
            if source[start + 1:start + 2] in ("!", "?", "/"):
                return start, shut + 1, "", "", ""
            at = start + 1

    def _end(self, at: int, shut: int) -> int:
        """The ``>`` of a tag, quoted ones left aside."""
        first = shut
        while self.quoted:
            m = _MARK.search(self.source, at)
            if not m:
                self.quoted = False
                break
            if m[0] == ">":
                return m.start()
            at = self.source.find(m[0], m.end()) + 1
            if not at:
                self.quoted = False
        return first

    def raw_end(self, tag: str, at: int) -> int | None:
        """The end of a raw element that begins before ``at``; None if it has no end tag."""
        if tag in self.missing:
            return None
        m = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(self.source, at)
        if not m:
            self.missing.add(tag)
        return m.end() if m else None


def read(source: str) -> Page:
    """The blocks and the tokens of a page, in one pass."""
    root = Element("", 0, False, False)
    root.block = root
    page, stack = Page(), [root]
    open_tags: Counter = Counter()
    opened: list[Element] = []
    inside: list[Element] = []  # of each block
    led: set[int] = set()
    parts: list[str] = []
    scan = _Scanner(source)
    link_chars, at = 0, 0

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1].block
                page.blocks.append(Block(text, top.path, stack[-1].main, False, link_chars, top.tag in HEADINGS))
                inside.append(stack[-1])
            parts.clear()
        link_chars = 0

    def add(raw: str):
        nonlocal link_chars
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].link:
            link_chars += len(text)

    def close(to: int):
        """End all elements from stack position ``to`` on."""
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        open_tags.subtract(e.tag for e in stack[to:])
        del stack[to:]

    while True:
        found = scan.tag(at)
        if found is None:
            add(source[at:])
            break
        start, after, end, tag, attrs = found
        if start > at:
            add(source[at:start])
        at = after
        if not tag:
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not end a block
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                shut = scan.raw_end(tag, at)
                if shut or tag not in ("head", "object", "canvas", "noscript", "template"):
                    at = shut or len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[t] > 0 for t in ends) else ():
                if stack[k].tag in ends:
                    close(k)
                    if tag not in ("tr", "dt", "dd"):
                        break
                elif stack[k].tag in BOUNDARY:
                    break
        top = _opened(tag, attrs, stack[-1])
        top.block = top if tag in BLOCK else stack[-1].block
        if top.begins:
            _begun(stack, top, led)
        opened.append(top)
        page.paths[top.path] += 1
        page.parents.setdefault(top.path, stack[-1].path)
        if (not attrs.endswith("/") or tag in BLOCK) and len(stack) < DEPTH:
            stack.append(top)
            open_tags[tag] += 1
    flush()
    if not any(e.begins for e in opened):
        _spread(root, opened, page.blocks, inside)
    for e in opened:  # parents first
        e.off = e.aside or e.named and not e.holds or e.parent.off
    for block, e in zip(page.blocks, inside):
        block.aside = e.off
    return page


def _spread(root: Element, opened: list[Element], blocks: list[Block], inside: list[Element]) -> None:
    """On a page without article or main, names do not count on what holds over half of
    the text that tags and roles leave."""
    for block, e in zip(blocks, inside):
        if not e.aside:
            e.chars += len(block.text) - block.link_chars
    for e in reversed(opened):  # children first
        e.parent.chars += e.chars
    for e in opened:
        e.holds = e.holds or 2 * e.chars > root.chars


def _text_token(block: Block) -> int:
    """Odd; those of elements are even."""
    return _hash(block.path, "text", block.text) | 1


def _slot_token(path: int) -> int:
    """Counts the blocks of text in a slot."""
    return _hash(path, "texts") & ~1


def main_text(page: Page, template: set[int]) -> str:
    """The blocks of the main slots, joined by line feeds. ``template`` holds the tokens
    of the host's template and the slot tokens of slots that hold nothing else."""
    inside = [b for b in page.blocks if b.main and not b.aside]
    if inside:
        while inside and not inside[-1].heading and {_text_token(inside[-1]), _slot_token(inside[-1].path)} <= template:
            inside.pop()
        return "\n".join(b.text for b in inside)
    inside = [b for b in page.blocks if not b.aside and 2 * b.link_chars <= len(b.text)]
    return "\n".join(b.text for b in inside if _text_token(b) not in template)


_TOKENS = "host string, token bigint, copied bigint, parent bigint, pages bigint, times bigint, vector decimal(38,0)"


def _tokens(copied):
    """(host, token, copied, parent, pages, times, vector) summed over some pages of a task;
    token 0 counts pages. A content that may have copies has rows of its own, under its key."""
    def out(seen):
        from decimal import Decimal
        keys = list(seen)
        rows = [seen[k] for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([k[2] for k in keys], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
             pa.array([Decimal(r[3]) for r in rows], pa.decimal128(38, 0))],
            names=["host", "token", "copied", "parent", "pages", "times", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = copied.value
        seen: dict[tuple[str, int, int | None], list[int]] = {}
        for b in slices(batches):
            for host, key, source in zip(*(b.column(c).to_pylist() for c in ("host", "content", "html"))):
                own = key if may[key % COPY_SLOTS] else None
                if own is not None and (host, 0, own) in seen:
                    continue  # a copy
                page = read(source or "")
                counts = Counter(page.paths)
                parents = dict(page.parents)
                for block in page.blocks:
                    t = _text_token(block)
                    slot = _slot_token(block.path)
                    counts[t] += 1
                    counts[slot] += 1
                    parents[t] = parents[slot] = block.path
                counts[0] = 1
                for t, n in counts.items():
                    row = seen.setdefault((host, t, own), [parents.get(t, 0), 0, 0, 0])
                    row[1] += 1
                    row[2] += n
                    row[3] += xxhash.xxh64_intdigest(f"{key},{n}", 9)
            if len(seen) > 100_000:
                yield out(seen)
                seen = {}
        if seen:
            yield out(seen)
    return run


def _may_be_copied(pages: DataFrame) -> np.ndarray:
    """Which slots hold the key of a content that a host has more than once. A slot may
    also hold others: they only take the longer way."""
    slots = (pages.groupBy("host", "content").count().where("count > 1")
             .select(F.pmod("content", F.lit(COPY_SLOTS)).cast("int").alias("slot")).distinct().toArrow())  # a row for each slot at most
    may = np.zeros(COPY_SLOTS, bool)
    may[slots["slot"].to_numpy()] = True
    return may


def templates(pages: DataFrame) -> DataFrame:
    """host and the tokens of its template (each is on half of the host's pages at
    least, so there are at most twice as many as on a page) from host, html. Pages
    of a host with equal html count as one."""
    pages = pages.select("host", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("content"))
    copied = pages.sparkSession.sparkContext.broadcast(_may_be_copied(pages))
    found = pages.mapInArrow(_tokens(copied), _TOKENS).repartition("host", "token")  # for both groupings
    once = [F.when(F.col("copied").isNull(), F.sum(c)).otherwise(F.max(c)).cast(found.schema[c].dataType).alias(c)
            for c in ("pages", "times", "vector")]
    found = (found.groupBy("host", "token", "copied").agg(F.min("parent").alias("parent"), *once).groupBy("host", "token")
             .agg(F.min("parent").alias("parent"), F.sum("pages").alias("pages"), F.sum("times").alias("times"),
                  F.sum("vector").alias("vector")))
    found = stored(found.where("token = 0 OR pages >= 3"), "tokens")
    size = found.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = found.where("token <> 0").hint("merge").join(size, "host").where("2 * pages >= host_pages")
    classes = frequent.groupBy("host", "vector", "pages", "times").agg(
        F.collect_list(F.struct("token", "parent", "times")).alias("members"))
    large = classes.groupBy("host").agg(F.collect_list("members").alias("classes"))
    return large.mapInArrow(_nested, "host string, template array<bigint>")


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each host's valid classes; one of a single token is valid if its parent's is.
    A slot token is among them only if the slot's blocks are all of valid classes."""
    for b in slices(batches, 64):
        out = []
        for classes in b.column("classes").to_pylist():
            times = {x["token"]: x.get("times", 0) for c in classes for x in c}
            # slot tokens are no part of the page: they neither make a class nor nest
            slots = {x["parent"]: x["token"] for c in classes for x in c if x["token"] == _slot_token(x["parent"])}
            ours = [[x for x in c if x["token"] != slots.get(x["parent"])] for c in classes]
            ok = [x["token"] for c in ours if len(c) > 1 for x in c]
            under: dict[int, list[int]] = {}
            for c in ours:
                if len(c) == 1:
                    under.setdefault(c[0]["parent"], []).append(c[0]["token"])
            for t in ok:  # grows until nothing is nested in it any more
                ok += under.pop(t, ())
            valid, fixed = set(ok), Counter()
            for c in ours:
                for x in c:
                    if x["token"] & 1 and x["token"] in valid:  # a block of text
                        fixed[x["parent"]] += times[x["token"]]
            ok += [t for path, t in slots.items() if fixed[path] == times[t]]
            out.append(ok)
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.list_(pa.int64()))], names=["host", "template"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        texts = [main_text(read(source or ""), set(t or ()))
                 for source, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    pages = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"),
                         F.xxhash64("page_id", "url", "html").alias("key")).withColumn("host", F.coalesce("host", F.lit("")))
    found = stored(templates(pages), "templates").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return (salted.hint("merge").join(found, ["host", "salt"], "left").select("page_id", "url", "html", "template")
            .mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint"))
