"""HTML extraction by deduction of a host's template from equivalence classes of tokens.

A token is an element with the path of elements above it, or a block's words in order with that path.
Tokens with the same occurrence vector, that is the same number of occurrences on each page of the
host, form an equivalence class. The vector is kept as an exclusive or of hashes of (page, count), which
partitions add up for themselves, so a host with a third of all pages costs its largest task no more
than its number of different tokens.

Only different pages count: pages with the same tokens are one. A class is valid if it is on nearly all of
a host's pages, these are enough, and it is large: a block brings in all its words. Classes nest, since a
token's path holds the tokens around it. The tokens of valid classes are the template. What is left between
them are slots; a page's text is what stands in its slots, in those inside an article where there is one.
Where most of an article, or all of a page, would be template, its pages are copies of one text rather than
pages of one template, and it stays whole. Menus, adverts and the like that differ from page to page, and so
are no template, are known by their tags and names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, small, staged
from .url_filter import parts_of

#: The share of a host's different pages that a template token is on, how many there must be, and the tokens of a class.
SUPPORT, LEAST_PAGES, LEAST_TOKENS = 0.8, 5, 3
#: The share of an article's words that may be template.
IN_ARTICLE = 0.25
#: Hosts whose templates may be broadcast, and their tokens (16 bytes each).
BROADCAST_HOSTS, BROADCAST_TOKENS = 100_000, 1_000_000

# Tags by their part in a page.
SKIPPED = frozenset("head title script style noscript template iframe object svg math canvas audio video nav footer aside form button select option textarea input label dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = ("article", "main")
# Names of elements that hold menus, notices, adverts and comments; those that do so outside an article only.
NOTICE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|newsletter|subscribe|sidebar|menu|nav\w*|breadcrumbs?|pagination|pager|masthead|footer|comments?|disqus|respond|replies)(?:$|[\s_-])", re.I)
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:side|header|toolbar|modal|overlay|signup|reply|share|sharing|social|related|recommend\w*|widget|copyright|login|search)(?:$|[\s_-])", re.I)
# what closes an open paragraph or item
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol dl table article section main div body html nav aside header footer form blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


class Page:
    """A page as runs of text, each with the number of the innermost open element. Time is linear in its length."""

    def __init__(self, source: str):
        self.path: list[int] = [0]  # hash of the path of elements, inline ones left out
        self.skipped: list[bool] = [False]  # is it, or is what holds it, left out
        self.main: list[int] = [0]  # the outermost article or main around it (0: none)
        self.texts: list[tuple[int, str | None]] = []  # (element, decoded text); a block's end is (element, None)
        self._read(source)

    def _read(self, source: str) -> None:
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.blocks = [0]  # places in the stack of elements that aren't inline
        self.open = [Counter()]  # open names, for each barrier those behind it
        self.all_open = Counter()
        gone: set[str] = set()  # what is known not to come any more
        at, begun, end = 0, 0, len(source)

        def ahead(what: str, start: int) -> int:
            if what in gone:
                return -1
            found = source.find(what, start)
            if found < 0:
                gone.add(what)
            return found

        def text(start: int, stop: int) -> None:
            if stop > start:
                self.texts.append((self.stack[-1][1], html.unescape(source[start:stop])))

        while (lt := source.find("<", at)) >= 0:
            at, closing = lt + 1, source.startswith("/", lt + 1)
            if source.startswith("<!--", lt):
                text(begun, lt)
                stop = ahead("-->", lt + 4)
                at = begun = end if stop < 0 else stop + 3
                continue
            if source.startswith("<![CDATA[", lt):
                text(begun, lt)
                stop = ahead("]]>", lt + 9)
                self.texts.append((self.stack[-1][1], source[lt + 9 : end if stop < 0 else stop]))
                at = begun = end if stop < 0 else stop + 3
                continue
            name = _NAME.match(source, lt + 1 + closing)
            if not name and not source.startswith(("<!", "<?"), lt):
                continue  # a plain less-than sign
            stop = name.end() if name else lt + 2
            while stop < end:  # to the first > that isn't in quotes; a quote without an end is none
                stop = _PLAIN.match(source, stop).end()
                if stop >= end or source[stop] == ">":
                    break
                other = ahead(source[stop], stop + 1)
                stop = stop + 1 if other < 0 else other + 1
            if stop >= end:
                stop = ahead(">", lt)
                if stop < 0:
                    break  # no tag ends any more: text
            text(begun, lt)
            at = begun = stop + 1
            if name:
                raw = self._tag(name[0].lower(), closing, source[name.end() : stop])
                if raw:
                    close = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(source, at)
                    at = begun = close.end() if close else end
        text(begun, end)

    def _tag(self, name: str, closing: bool, rest: str) -> str | None:
        """Open or close an element; the name, if what follows is raw text."""
        if name not in INLINE:
            self.texts.append((self.stack[-1][1], None))
        if closing:
            if (self.all_open if name in _BARRIER else self.open[-1])[name] > 0:
                k = len(self.stack) - 1
                while self.stack[k][0] != name:
                    k -= 1
                self._pop_from(k)
            return None
        if name not in INLINE and name not in VOID:
            # an unclosed paragraph, with the inline tags left open in it, ends at the next block
            k = self.blocks[-1]
            if k and (self.stack[k][0] == "p" or self.stack[k][0] in _CLOSES.get(name, ())):
                while self.blocks[-2] and self.stack[self.blocks[-2]][0] in _CLOSES.get(name, ()):
                    k = self.blocks[-2]
                    self.blocks.pop()
                self._pop_from(k)
        if name in VOID or rest.rstrip().endswith("/") and name not in RAW and name not in _BARRIER:
            return None
        if name in RAW:
            return name
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest))
        up, number = self.stack[-1][1], len(self.path)
        main = self.main[up] or (number if name in MAIN else 0)
        named = name not in ("html", "body", *MAIN) and bool(NOTICE.search(names) or not main and OUTSIDE.search(names))
        self.path.append(self.path[up] if name in INLINE else _hash(self.path[up], name, *sorted(set(names.split()))))
        self.main.append(main)
        self.skipped.append(self.skipped[up] or name in SKIPPED or name == "header" and not main or named or bool(_HIDDEN.search(rest)))
        self.stack.append((name, number))
        self.all_open[name] += 1
        if name in _BARRIER:
            self.open.append(Counter())
        else:
            self.open[-1][name] += 1
        if name not in INLINE:
            self.blocks.append(len(self.stack) - 1)
        return None

    def _pop_from(self, k: int) -> None:
        for name, _ in reversed(self.stack[k:]):
            self.all_open[name] -= 1
            if name in _BARRIER:
                self.open.pop()
            else:
                self.open[-1][name] -= 1
        del self.stack[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def all_blocks(self) -> Iterator[tuple[int, str]]:
        """(element, text) of the blocks that aren't left out, in page order."""
        block, inside = [], 0
        for element, text in [*self.texts, (0, None)]:
            if text is None:
                if words := "".join(block).split():
                    yield inside, " ".join(words)
                block = []
            elif not self.skipped[element]:
                if not block or not "".join(block[-1:]).strip():
                    inside = element
                block.append(text)

    def tokens(self) -> list[tuple[int, int, int]]:
        """(token, occurrences, how many words and elements it stands for)."""
        out = Counter(p for p, s in zip(self.path, self.skipped, strict=True) if not s)
        words = {}
        for element, block in self.all_blocks():
            token = _hash(self.path[element], block)
            words[token] = block.count(" ") + 1
            out[token] += 1
        return [(t, n, words.get(t, 1)) for t, n in out.items()]

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """What isn't template, in the articles if there are any (in those that are on the host's other pages too, if any is)."""
        mains = set(self.main) - {0}
        shared = {m for m in mains if self.path[m] in template}
        inside = (shared or mains) or {0}
        blocks = [(e, b) for e, b in self.all_blocks() if self.main[e] in inside]
        if template:
            size, common = Counter(), Counter()
            for e, b in blocks:
                size[self.main[e]] += b.count(" ") + 1
                common[self.main[e]] += (b.count(" ") + 1) * (_hash(self.path[e], b) in template)
            slots = {m for m in size if common[m] <= size[m] * IN_ARTICLE or not m and common[m] < size[m]}
            blocks = [(e, b) for e, b in blocks if self.main[e] not in slots or _hash(self.path[e], b) not in template]
        return "\n".join(b for _, b in blocks)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, source in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
            if source:
                found = Page(source).tokens()
                body = _hash(*sorted((t, n) for t, n, _ in found))
                rows += [(host, token, size, _hash(body, n)) for token, n, size in found]
        kinds = (("host", pa.string()), ("token", pa.int64()), ("size", pa.int64()), ("mark", pa.int64()))
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid classes; pages with host and html, hosts with few different pages have none.

    A token on SUPPORT of a host's pages is one of 1 / SUPPORT times a page's tokens at most, so a template is as large as a page.
    Pages with the same tokens have the same marks, and count once.
    """
    seen = mapped(pages.where("host <> ''").select("host", "html"), _tokens, "host string, token long, size long, mark long", rows=200)
    once = seen.groupBy("host", "token", "mark").agg(F.max("size").alias("size"))
    tokens = staged(once.groupBy("host", "token").agg(F.count("*").alias("pages"), F.max("size").alias("size"), F.bit_xor("mark").alias("vector")), "tokens")
    # the page itself is a token, path 0
    whole = tokens.where("token = 0 AND pages >= %d" % LEAST_PAGES).select("host", F.col("pages").alias("of"))
    common = tokens.join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    classes = common.groupBy("host", "vector", "pages").agg(F.collect_list("token").alias("members"), F.sum("size").alias("size"))
    valid = classes.where(F.col("size") >= LEAST_TOKENS)
    return valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("template"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[list, frozenset] = ([], frozenset())
    for batch in batches:
        out = []
        for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (template or []) != held[0]:
                held = (template or [], frozenset(template or ()))
            out.append(Page(source).text(held[1]) if source else "")
        yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string())})


def extracted(pages: DataFrame, use_templates: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    text: the main text, blocks joined by a line feed, character references decoded, white space in a block as
    one space; empty for null or empty html. Pages without a host (null url, or none) have no template; nor have hosts
    with under LEAST_PAGES different pages. Equal rows stay apart and count once for a template, other columns are ignored,
    an empty table gives an empty table.
    """
    base = pages.select("page_id", "url", "html", F.coalesce(parts_of()[0], F.lit("")).alias("host"))
    if use_templates:
        found = staged(templates(base), "templates")
        tokens = found.agg(F.sum(F.size("template"))).first()[0] or 0
        told = base.join(F.broadcast(found) if small(found, BROADCAST_HOSTS) and tokens <= BROADCAST_TOKENS else found, "host", "left")
    else:
        told = base.withColumn("template", F.array().cast("array<long>"))
    out = mapped(told.select("page_id", "url", "html", "template"), _extract, "page_id long, url string, text string", rows=200)
    return out.withColumn("n_chars", F.length("text").cast("long"))
