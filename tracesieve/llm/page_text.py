"""Main text of web pages: what a site repeats goes, and so does what a page labels as no text.

Each page is read once into blocks of text and the subtrees of elements over them. A subtree is a
hash of its tags and texts and the range of blocks it covers. Spark counts subtrees per host; those
that recur across many pages are the site's template, and the blocks they cover are deleted.

A subtree counts once for each *companion*, the longest text of the article outside it. So copies of
one article, however many, are no template: their paragraphs always meet the same companion. Nor are
paragraphs, headings and list items of a declared ``article`` or ``main``: a licence line belongs to
every text that states it. There, only containers are counted.

Menus, adverts or notices that are new on each page cannot recur. They are known by their element,
role, class or id. The text itself is the ``article``, else ``main``, else the body.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import map_batches, written
from tracesieve.operators.joins import sized_join

#: Pages with different text that a subtree must recur on.
MIN_PAGES = 4
#: A page that would lose more than this share of its text is a copy of others and keeps it.
COPY_SHARE = 0.75

# Elements of HTML by what they do to text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody tfoot thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = set("script style template noscript iframe noembed noframes object svg canvas audio video head title datalist".split())
ENDS_P = BLOCKS - set("body caption head html legend option tbody tfoot thead title tr".split())
IN_HEAD = set("base link meta title style script noscript template head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p li blockquote pre dd dt figcaption tr".split())
SIBLINGS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "option": ("select",)}

# What labels an element as no part of the text.
LABEL_TAGS = set("nav footer aside form menu dialog search select button textarea label fieldset".split())
LABEL_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
LAYOUT_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside "
    "modal overlay share sharing sharebar social toolbar skip signup login pagination pager copyright".split()
)
SURE_WORDS = set(
    "cookie cookies cookiebar consent gdpr notice notices banner banners alert disclaimer popup newsletter subscribe "
    "subscription ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo "
    "promos promotion related recommended recommendations comment comments commentlist disqus respond replies".split()
)
NOT_LABELS = set("no has with without is".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def site(url: str | None) -> str | None:
    """Host of a URL, without user and port; null if there is none."""
    found = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*:?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


def _hash(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "labelled", "first", "parts", "holds_main", "silent")

    def __init__(self, tag: str, labelled: str, first: int, silent: bool):
        self.tag, self.labelled, self.first, self.silent = tag, labelled, first, silent
        self.parts: list[bytes] = []
        self.holds_main = False


def _label(tag: str, attributes: str, in_main: bool) -> str:
    """What labels the element as no text: ``sure``; ``layout``, which does not hold for an element around
    the article itself; empty for nothing."""
    if tag == "form":
        return "layout"
    if tag in LABEL_TAGS or (tag == "header" and not in_main):
        return "sure"
    if not attributes or tag in ("html", "body") or tag in HEADINGS:
        return ""
    found = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "sure"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "sure"
        if name == "role" and value.strip().lower() in LABEL_ROLES:
            return "sure"
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)} | {token.lower()}
                if words & NOT_LABELS:
                    continue
                if words & SURE_WORDS:
                    return "sure"
                if words & LAYOUT_WORDS and not (in_main and words & {"header", "masthead"}):
                    found = "layout"
    return found


class Page:
    """Blocks of a page in order; ranges of blocks that are labelled, of articles and of mains; and the
    subtrees, as (first, last, hash, countable)."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.labelled: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self._text: list[str] = []
        self._open = Counter()
        self._stack = [_Element("", "", 0, False)]
        self._main_depth = 0
        self._read(html)
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.blocks.append(text)
            self._stack[-1].parts.append(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())

    def _pop(self) -> None:
        element = self._stack[-1]
        if element.tag in BLOCKS:
            self._flush()
        self._stack.pop()
        self._open[element.tag] -= 1
        parent, last = self._stack[-1], len(self.blocks)
        own_main = element.tag in ("article", "main") and not element.labelled
        if own_main:
            self._main_depth -= 1
        rescued = element.holds_main and element.labelled in ("", "layout")
        if rescued:
            parent.holds_main = True
        if last == element.first:
            return
        if element.labelled and not rescued:
            self.labelled.append((element.first, last))
        if own_main:
            (self.articles if element.tag == "article" else self.mains).append((element.first, last))
        code = blake2b(element.tag.encode() + b"".join(element.parts), digest_size=8).digest()
        parent.parts.append(code)
        if element.tag not in ("article", "main", "body", "html"):
            countable = not (self._main_depth and element.tag in PROSE and not element.labelled)
            self.subtrees.append((element.first, last, int.from_bytes(code, "little", signed=True), countable))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("br", "td", "th"):
            self._text.append(" ")
            return
        if self._open["head"] and tag not in IN_HEAD:
            self._end("head")
        if tag in ENDS_P and self._open["p"]:
            self._end("p")
        if tag in SIBLINGS and self._open[tag]:
            for element in reversed(self._stack):
                if element.tag == tag:
                    self._end(tag)
                    break
                if element.tag in SIBLINGS[tag]:
                    break
        if tag in ("dd", "dt"):
            other = "dt" if tag == "dd" else "dd"
            if self._stack[-1].tag == other:
                self._end(other)
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        label = _label(tag, attributes, self._main_depth > 0)
        if tag in BLOCKS:
            self._flush()
        elif tag not in NO_TEXT and not label:
            return  # a plain inline element is no subtree of its own
        silent = self._stack[-1].silent or tag in NO_TEXT or tag not in BLOCKS
        element = _Element(tag, label, len(self.blocks), silent)
        self._stack.append(element)
        self._open[tag] += 1
        if tag in ("article", "main") and not label:
            self._main_depth += 1
            element.holds_main = True

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif self._open[tag]:
            while self._stack[-1].tag != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                self._say(html[at:])
                return
            self._say(html[at:begin])
            mark = html[begin + 1 : begin + 2]
            if html.startswith("<!--", begin):
                at = html.find("-->", begin + 2) + 3
                if at < 3:
                    return
            elif mark in ("!", "?") or (mark == "/" and not html[begin + 2 : begin + 3].isalpha()):
                at = html.find(">", begin) + 1
                if not at:
                    return
            elif mark == "/" or (mark.isascii() and mark.isalpha()):
                found = _TAG.match(html, begin)
                if not found:
                    # No end of this tag: all that follows is part of it.
                    return
                at = found.end()
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                    continue
                self._start(tag, found[3])
                if tag in RAW:
                    closing = _CLOSE[tag].search(html, at)
                    if not closing:
                        return
                    at = closing.start()
            else:
                self._say("<")
                at = begin + 1

    def _say(self, text: str) -> None:
        if text and not self._stack[-1].silent:
            self._text.append(unescape(text) if "&" in text else text)

    def scope(self) -> list[tuple[int, int]]:
        """Ranges of the main text: articles that are in the main part, if there is one, else all
        articles, else the main part, else everything."""
        mains = _outside(self.mains, self.labelled)
        articles = _outside(self.articles, self.labelled)
        inner = [a for a in articles if any(m[0] <= a[0] and a[1] <= m[1] for m in mains)] if mains else articles
        return inner or mains or [(0, len(self.blocks))]


def _outside(ranges: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that do not lie within one of the others."""
    if not ranges or not others:
        return ranges
    covered = covers(others, max(b for _, b in [*ranges, *others]))
    return [r for r in ranges if not covered[r[0] : r[1]].all()]


def covers(ranges: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of ``n`` blocks lie in a range."""
    edges = np.zeros(n + 1, np.int64)
    for first, last in ranges:
        edges[first] += 1
        edges[last] -= 1
    return np.cumsum(edges)[:n] > 0


def read_page(html: str) -> tuple[list[str | None], list[dict]]:
    """Blocks in page order, null where they are no part of the main text by label or place, and the
    subtrees that count: of those that cover the same blocks, one."""
    page = Page(html)
    n = len(page.blocks)
    main = covers(page.scope(), n) & ~covers(page.labelled, n)
    # The longest main block before each place and from each place on; of equal ones the same everywhere.
    ranked = [(len(t), t) if m else (0, "") for t, m in zip(page.blocks, main.tolist())]
    before, after = [(0, "")] * (n + 1), [(0, "")] * (n + 1)
    for k in range(n):
        before[k + 1] = max(before[k], ranked[k])
        after[n - 1 - k] = max(after[n - k], ranked[n - 1 - k])
    codes: dict[str, int] = {}
    subtrees, seen = [], set()
    for first, last, code, countable in page.subtrees:
        companion = max(before[first], after[last])[1]
        if countable and companion and (first, last) not in seen:
            seen.add((first, last))
            if companion not in codes:
                codes[companion] = _hash(companion.encode("utf-8", "surrogatepass"))
            held = bool(main[first:last].any())
            subtrees.append({"subtree": code, "companion": codes[companion], "first": first, "last": last, "main": held})
    return [t if m else None for t, m in zip(page.blocks, main.tolist())], subtrees


def _clean(text: str) -> str:
    """Lone surrogates, which only broken character references make, as replacement characters."""
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, copy_share: float = COPY_SHARE,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_template_blocks) of every row of ``pages``.

    The last one is the number of main blocks that were a template's. Blocks of the main text are joined by an empty line; white space inside a block is one space.
    Null or empty html has an empty text; a page without a host in its URL (null too) is a site of its
    own, where nothing recurs. Rows may repeat, ids may be null, further columns are not read. A page
    whose main text lies wholly in one subtree keeps it."""
    kind = pages.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("subtree", pa.int64()), ("companion", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("main", pa.bool_())]))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [read_page(h or "") for h in batch.column(2).to_pylist()]
        hosts = [site(u) for u in batch.column(1).to_pylist()]
        columns = [
            batch.column(0), batch.column(1),
            pa.array([None if h is None else _hash(h.encode()) for h in hosts], pa.int64()),
            pa.array([b for b, _ in found], pa.list_(pa.string())),
            pa.array([s if h is not None else [] for (_, s), h in zip(found, hosts)], shape),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "blocks", "subtrees"])

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    spans = "subtrees array<struct<subtree: long, companion: long, first: int, last: int, main: boolean>>"
    read_rows = map_batches(rows, read, f"page_id {kind}, url string, host long, blocks array<string>, {spans}", 64)
    parsed = written(read_rows.withColumn("row", F.monotonically_increasing_id()), "page-blocks")
    subtrees = parsed.select("row", "host", F.explode("subtrees").alias("s")).select("row", "host", "s.*")
    # Twice grouped, each time combined before the shuffle: a hot host's template is many small counts.
    template = subtrees.groupBy("host", "subtree", "companion").agg(F.lit(1).alias("one")).groupBy("host", "subtree")
    template = written(template.agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "subtree"), "templates")
    # All subtrees count; those without a main block have nothing left to delete.
    hits = sized_join(subtrees.where("main"), template, ["host", "subtree"], "inner", spread=["row"])
    hits = written(hits.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("hits")), "template-places")
    placed = sized_join(parsed.select("row", "page_id", "url", "blocks"), hits, ["row"], "left", spread=["row"])

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed = [], []
        for blocks, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = covers([(h["first"], h["last"]) for h in hits or []], len(blocks)).tolist()
            main = [t for t in blocks if t is not None]
            left = [t for t, g in zip(blocks, gone) if t is not None and not g]
            if sum(map(len, left)) < (1 - copy_share) * sum(map(len, main)):
                left = main
            texts.append(_clean("\n\n".join(left)))
            removed.append(len(main) - len(left))
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_template_blocks"])

    placed = placed.select("page_id", "url", "blocks", "hits")
    return map_batches(placed, keep, f"page_id {kind}, url string, text string, n_chars long, n_template_blocks long")
