"""Main text of web pages by removing site templates.

Every element's subtree is hashed (tag, attributes, text and children). Spark counts on how
many pages of a host each hash occurs; subtrees that recur on many pages of the host are
its template and are deleted. What a page says itself about its parts is used too: the
text is that of its articles, or else of its main part or body, and elements that are
navigation, forms, adverts, notices, comments and so on by tag, role or class go. A class
or id rules an element out only if one of its names says nothing else ("ad", "site-footer",
but not "ad-free" or "no-sidebar"), and not if the element holds most of the text of its
article, main part or page (for readers' comments, which may outgrow the article: all of
it); headings never go by name, and paragraphs, list items, tables and the like only by a
name that says advert, notice of cookies, sharing or comments. The count by host decides on
the elements that are spared so, whatever their tag.
Inside an article, other paragraphs, headings and other content elements are never taken for a template,
so a passage that a site repeats within its articles stays.

Blocks are separated by block-level tags; character references are decoded once, runs of
white space become one space, and non-empty blocks are joined by a line feed.

Defined results: null and empty pages have empty text; pages with a null or unreadable url
share the host null; repeated rows give equal texts, and pages of equal html count once, so
copies of a page make no template; a subtree on fewer than MIN_PAGES differing pages of its
host is no template; unclosed, misnested and cut-off markup is read as browsers do in essence; an empty table
gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import lean
from .scratch import Scratch

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|hidden", re.I)
WORD = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
SCOPE = frozenset("html table td th caption template object".split())
#: An opening tag ends an open element of these, unless one of the others is between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math canvas object embed button select input textarea dialog menu head title audio video map noembed noframes xmp datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words in a class or id that mark an element as no part of the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split()
)
#: Words that leave the meaning of such a word as it is, as in site-footer or sidebar-inner.
PART_WORDS = frozenset(
    "area article articles bar block blog bottom box btn button buttons center col column container desktop entry fixed form global google group holder icon icons inline inner item items layer left link links list main media mobile module outer overlay page panel post posts primary reader recent right row secondary section site slot sticky stories sub the this top unit user window wrap wrapper zone".split()
)
#: Of the dropped words, those of readers' comments.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Names that rule out a content element too, as whole names.
MARKS = READERS | frozenset("ad ads advert adverts advertisement advertising adsense consent cookie cookies newsletter promo promoted share sharing social sponsor sponsored subscribe widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Within an article these are content, whatever recurs.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table li dd dt".split())
TEMPLATE_TAGS = frozenset("div section ul ol dl aside nav header footer form center table".split()) | CONTENT


#: Differing pages of a host that a subtree must be on: two may be one article at two addresses.
MIN_PAGES = 3


class Page:
    """A parsed page: nodes in order of their opening, and its text and block boundaries in order."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [-1]
        self.parts: list[list[str]] = [[]]
        self.hash: list[int] = [0]
        self.events: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._open_at: dict[str, list[int]] = {}  # places in the stack, by tag
        self._parse(source)

    def _open(self, tag: str, attrs: str) -> None:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._stack[-1])
        self.parts.append([tag, attrs.strip()])
        self.hash.append(0)
        self._open_at.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        if tag in BLOCK:
            self.events.append((self._stack[-1], None))

    def _close(self, down_to: int) -> None:
        while len(self._stack) > down_to:
            node = self._stack.pop()
            if node:
                self._open_at[self.tag[node]].pop()
            self.hash[node] = xxhash.xxh64_intdigest("\0".join(self.parts[node]).encode("utf-8", "surrogatepass")) - (1 << 63)
            if self._stack:
                self.parts[self._stack[-1]].append(str(self.hash[node]))
            if self.tag[node] in BLOCK:
                self.events.append((node, None))

    def _end_open(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        """Close the innermost open element of tags, unless one of the fence is within it."""
        open_at = self._open_at
        at = max((own[-1] for t in tags if (own := open_at.get(t))), default=0)
        if at and (at == len(self._stack) - 1 or not any(own[-1] > at for t in fence if (own := open_at.get(t)))):
            self._close(at)

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        text = _html.unescape(text)
        self.events.append((node, text))
        if flat := " ".join(text.split()):
            self.parts[node].append(flat)

    def _parse(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                fence = SCOPE if tag not in SCOPE else frozenset()
                if tag not in BLOCK and tag not in SCOPE:
                    fence = SCOPE | BLOCK  # a stray inline end tag ends no block
                self._end_open(frozenset([tag]), fence)
                continue
            if tag in CLOSES_P:
                self._end_open(frozenset(["p"]), SCOPE | {"button", "article", "div", "li", "section", "blockquote", "body"})
            if tag in ENDS:
                self._end_open(*ENDS[tag])
            if tag in VOID:
                self.events.append((self._stack[-1], None if tag in BLOCK else " " if tag == "br" else ""))
                continue
            self._open(tag, attrs)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else len(source)
        if at < len(source):
            self._text(source[at:])
        self._close(0)

    def _marked(self) -> tuple[list[bool], list[bool]]:
        """Nodes that their tag, role, class or id rules out, and those that it would but for the rest of the name or their share of the text.

        Nodes around an article are in neither.
        """
        around = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            around[self.parent[i]] |= around[i] or self.tag[i] in ("article", "main")
        out = [False] * len(self.tag)
        spared = [False] * len(self.tag)
        inside = [False] * len(self.tag)
        named: dict[int, bool] = {}
        for i in range(1, len(self.tag)):
            tag, attrs = self.tag[i], self.attrs[i]
            inside[i] = inside[self.parent[i]] or tag == "article"
            if tag in ("html", "body", "main") or around[i]:
                continue
            out[i] = tag in DROPPED or tag == "header" and not inside[i]
            if attrs and not out[i] and TELLING.search(attrs):
                for name, *values in ATTRIBUTE.findall(attrs):
                    value, name = "".join(values).lower(), name.lower()
                    if name == "role":
                        out[i] |= value in DROPPED_ROLES
                    elif name == "hidden" or name == "aria-hidden" and value == "true":
                        out[i] = True
                    elif name in ("class", "id"):
                        for one in value.split():
                            if tag in HEADINGS:
                                continue
                            if tag in CONTENT and one not in MARKS:
                                spared[i] |= bool((set(WORD.split(one)) & DROPPED_WORDS))
                                continue
                            words = set(WORD.split(one)) - {""}
                            own = words & DROPPED_WORDS
                            if tag == "article":
                                own = {w for w in own if w.startswith(("comment", "repl"))}
                            elif inside[i]:  # an article's own head holds its title
                                own -= {"header", "masthead"}
                            if not own:
                                continue
                            if all(w in DROPPED_WORDS or w in PART_WORDS or w[0].isdigit() for w in words):
                                named[i] = named.get(i, False) or bool(own & READERS)
                            else:
                                spared[i] = True
        named = {i: readers for i, readers in named.items() if not out[i]}
        if named:
            size, whole = self._sizes(self._under(out))
            for i, readers in named.items():
                if size[i] and (size[i] == whole[i] if readers else 2 * size[i] > whole[i]):
                    spared[i] = True
                else:
                    out[i] = True
        return out, spared

    def _sizes(self, gone: list[bool]) -> tuple[list[int], list[int]]:
        """Characters of each node's text without white space, and of the article, main part or page around it."""
        size = [0] * len(self.tag)
        for node, text in self.events:
            if text and not gone[node]:
                size[node] += len("".join(text.split()))
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        around = [0] * len(size)  # the node itself if it is one
        whole = [size[0]] * len(size)
        for i in range(1, len(size)):
            whole[i] = size[around[self.parent[i]]]
            around[i] = i if self.tag[i] in ("article", "main") else around[self.parent[i]]
        return size, whole

    def _scope(self, marked: list[bool]) -> tuple[list[bool], str]:
        """Nodes of the articles, else of the main part, else of the body or the whole page."""
        gone = self._under(marked)
        for kind in ("article", "main", "body", "#root"):
            own = [t == kind and not g for t, g in zip(self.tag, gone, strict=True)]
            if any(own):
                return self._under(own), kind
        return [False] * len(self.tag), "#root"

    def _under(self, marks: list[bool]) -> list[bool]:
        out = list(marks)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def candidates(self) -> set[int]:
        """Hashes of the subtrees within the page's scope that may be template."""
        marked, spared = self._marked()
        scope, kind = self._scope(marked)
        gone = self._under(marked)
        allowed = TEMPLATE_TAGS - CONTENT if kind == "article" else TEMPLATE_TAGS
        return {self.hash[i] for i in range(1, len(self.tag)) if scope[i] and not gone[i] and (spared[i] or self.tag[i] in allowed) and len(self.parts[i]) > 2}

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        marked, spared = self._marked()
        scope, kind = self._scope(marked)
        if template:
            allowed = TEMPLATE_TAGS - CONTENT if kind == "article" else TEMPLATE_TAGS
            marked = [m or ((s or t in allowed) and h in template) for m, s, t, h in zip(marked, spared, self.tag, self.hash, strict=True)]
        gone = self._under(marked)
        blocks: list[str] = []
        now: list[str] = []
        for node, text in [*self.events, (0, None)]:
            if text is None:
                if flat := " ".join("".join(now).split()):
                    blocks.append(flat)
                now = []
            elif scope[node] and not gone[node]:
                now.append(text)
        return "\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, h) for each page, with no h, and for each of its subtrees that may be template."""
    for batch in batches:
        hosts: list[str | None] = []
        pages: list[int] = []
        hashes: list[int | None] = []
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = [None, *Page(source or "").candidates()]
            hosts += [host] * len(own)
            pages += [page] * len(own)
            hashes += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "page", "h"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(s or "").text(set(t or ())) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url):
    """The host of a url in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def main_texts(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = 0.1, rows_a_part: int = 10_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page.

    A subtree is template if it is on min_pages pages of the host and on min_share of them.
    Pages of equal html, by a hash, are one page.
    """
    tmp = Scratch(spark, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    seen = rows.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"), "html").mapInArrow(lean(_subtrees), "host string, page long, h long")
    seen = tmp.save(seen, "subtrees")
    counts = seen.where("h is null").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # Copies are told apart only for subtrees that are on enough pages with them.
    some = seen.where("h is not null").groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select(F.col("host").alias("x"), F.col("h").alias("y"))
    seen = seen.join(some, (F.col("h") == F.col("y")) & F.col("host").eqNullSafe(F.col("x")), "left_semi").distinct()
    seen = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = seen.alias("s").join(counts.alias("c"), F.col("s.host").eqNullSafe(F.col("c.host"))).where(F.col("n") >= min_share * F.col("pages"))
    # At most (subtrees of a page / min_share) hashes a host.
    template = often.groupBy(F.col("s.host").alias("host"), "pages").agg(F.collect_list("h").alias("template"))
    # Hosts of many pages are dealt in parts, each with the host's template.
    parts = template.withColumn("parts", F.ceil(F.col("pages") / rows_a_part))
    template = tmp.save(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("pages"), "template")
    sizes = template.select(F.col("host").alias("h"), "parts").distinct()
    dealt = rows.join(sizes, F.col("host").eqNullSafe(F.col("h")), "left").drop("h").withColumn("at", F.pmod(F.xxhash64("url", "page_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    t = template.select(F.col("host").alias("h"), F.col("part").alias("p"), "template")
    joined = dealt.join(t, F.col("host").eqNullSafe(F.col("h")) & (F.col("at") == F.col("p")), "left")
    kind = pages.schema[id_col].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "template").mapInArrow(lean(_texts), f"page_id {kind}, url string, text string")
    return out.toDF(id_col, url_col, "text")
