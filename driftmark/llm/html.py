"""Main text of web pages by site template removal.

Every page is parsed once into text blocks and hashes of its element subtrees. Spark counts, per
host, the different articles a subtree occurs beside; subtrees that recur across many of them are
the site's template and are deleted. Tags and class names that say what they are (menus, adverts,
forms, ...) are left out on every page, so pages of small hosts lose their furniture too. Headings
and plain paragraphs are not judged by name, and inside an article a name only counts as a whole
class or role of a container that the host uses beside many different articles.

Plain paragraphs and headings of an article are never template: a host may print one article, or one
sentence, many times.
"""

from __future__ import annotations

import hashlib
import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.batches import slices
from driftmark.sources.scratch import scratch_path

LEAST_PAGES = 5
SLICE_BYTES = 8 << 20

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that never belong to the text.
FURNITURE = frozenset(
    "head nav aside footer form script style noscript template iframe svg math button select "
    "textarea title object canvas audio video dialog menu".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead".split())
#: Prose that a name never removes.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ROOTS = frozenset("html body article main".split())
#: Classes and roles of an article element that is not the page's.
CARDS = frozenset("comment comments reply related".split())
CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
#: Where a search for an element to close stops.
SCOPES = frozenset("table ul ol dl article section div body html".split())
#: Words of class, id and role that name furniture; inside an article, whole classes and roles.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription paywall "
    "sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer comment comments disqus reply replies respond share sharing social related recommended "
    "login signup signin search pagination pager toolbar skip complementary contentinfo".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class _Element:
    __slots__ = ("tag", "gone", "article", "digest", "number", "prose", "shell")

    def __init__(self, tag, gone, article, number, prose, shell=-1):
        self.tag, self.gone, self.article = tag, gone, article
        self.digest = hashlib.blake2b(digest_size=8)
        self.number, self.prose, self.shell = number, prose, shell


class Page:
    """Blocks of text with the subtrees they lie in.

    ``blocks``: (text, in an article, numbers of the enclosing subtrees, in a named container of an
    article); ``subtrees``: their hashes by number. Furniture has subtrees but no blocks. A named
    container of an article has one more entry, its shell: the hash of its tag and names alone.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, list[int], bool]] = []
        self.subtrees: list[int] = []
        self.has_article = False
        self._stack = [_Element("", False, False, -1, False)]
        self._text: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = TOKEN.search(source, at)
            if not found:
                self._add(source[at:])
                break
            if found.start() > at:
                self._add(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
            else:
                self._start(tag, found[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                    inside = source[at : close.start() if close else len(source)]
                    self._stack[-1].digest.update(inside.encode("utf-8", "replace"))
                    at = close.end() if close else len(source)
                    self._pop()
                elif tag in VOID:
                    self._pop()
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _add(self, text: str) -> None:
        top = self._stack[-1]
        text = html.unescape(text)
        top.digest.update(" ".join(text.split()).encode("utf-8", "replace"))
        if not top.gone:
            self._text.append(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            chain = [e.number for e in self._stack if e.number >= 0]
            shells = [e.shell for e in self._stack if e.shell >= 0]
            self.blocks.append((text, self._stack[-1].article, chain + shells, bool(shells)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
            self._close_open(tag)
        if tag == "br":
            self._text.append(" ")
        above = self._stack[-1]
        names, tokens = set(), set()
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                names.update(WORDS.findall(value))
                if m[1].lower() != "id":
                    tokens.update(value.split())
        article = above.article or tag in ("article", "main") or "main" in names and tag == "div"
        # A header is the site's unless it stands in an article.
        gone = (
            above.gone
            or tag in FURNITURE
            or tag == "header" and not above.article
            or tag not in ROOTS | PLAIN and not above.article and bool(names & NAMES)
            or tag == "article" and not above.article and bool(tokens & CARDS)
        )
        shell = -1
        if above.article and not gone and tag not in INLINE | PROSE and tokens & NAMES:
            mark = f"{tag} {' '.join(sorted(tokens))}".encode("utf-8", "replace")
            digest = hashlib.blake2b(mark, digest_size=8, person=b"shell").digest()
            shell = len(self.subtrees)
            self.subtrees.append(int.from_bytes(digest, "big", signed=True))
        self.has_article |= article and not gone
        prose = above.prose or tag in PROSE
        counted = tag not in ROOTS and tag not in INLINE and not (prose and above.article)
        number = -1
        if counted:
            number = len(self.subtrees)
            self.subtrees.append(0)
        element = _Element(tag, gone, article and not gone, number, prose, shell)
        element.digest.update(f"<{tag} {' '.join(sorted(names))}>".encode())
        self._stack.append(element)

    def _close_open(self, tag: str) -> None:
        """Closes what a start tag ends by implication: an open paragraph, a list item, a cell."""
        closes = CLOSED_BY.get(tag, ())
        for i in range(len(self._stack) - 1, 0, -1):
            open_tag = self._stack[i].tag
            if open_tag in closes or open_tag == "p":
                while len(self._stack) > i:
                    self._pop()
                if open_tag in closes:
                    return
            elif open_tag in SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag in INLINE and self._stack[i].tag not in INLINE:
                return

    def _pop(self) -> None:
        element = self._stack[-1]
        if element.tag not in INLINE:
            self._flush()
        self._stack.pop()
        digest = element.digest.digest()
        self._stack[-1].digest.update(digest)
        if element.number >= 0:
            self.subtrees[element.number] = int.from_bytes(digest, "big", signed=True)

    def main_blocks(self, named: bool = False) -> list[tuple[str, list[int]]]:
        """(text, hashes of the enclosing subtrees): the article's blocks, or without an article
        all that are not furniture. Those in named containers of an article, which the counts of
        the host decide, only if ``named``."""
        return [
            (text, [self.subtrees[n] for n in chain])
            for text, article, chain, inside in self.blocks
            if (article or not self.has_article) and (named or not inside)
        ]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, article, subtrees, text, blocks): hash of the main text, hashes of all
    subtrees, and either the text, if no subtree of it could be template, or its blocks."""

    def parse(batches):
        for batch in slices(batches, "html", SLICE_BYTES):
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            articles, subtrees, texts, blocks = [], [], [], []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                # Copies of an article under other comments or links are one article.
                text = "\n\n".join(t for t, _ in page.main_blocks())
                mark = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
                main = page.main_blocks(named=True)
                articles.append(int.from_bytes(mark, "big", signed=True))
                subtrees.append(list(dict.fromkeys(page.subtrees)))
                open_ = any(chain for _, chain in main)
                texts.append(None if open_ else text)
                blocks.append([{"block": t, "inside": c} for t, c in main] if open_ else None)
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "host": pa.array(hosts, pa.string()),
                    "article": pa.array(articles, pa.int64()),
                    "subtrees": pa.array(subtrees, pa.list_(pa.int64())),
                    "text": pa.array(texts, pa.string()),
                    "blocks": pa.array(
                        blocks,
                        pa.list_(
                            pa.struct([("block", pa.string()), ("inside", pa.list_(pa.int64()))])
                        ),
                    ),
                }
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        parse,
        f"page_id {kind}, url string, host string, article long, subtrees array<long>, text string,"
        " blocks array<struct<block:string,inside:array<long>>>",
    )


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, subtree): subtrees beside at least ``least_pages`` different articles of the host,
    however many it has: the bar does not grow with the host, where a section's template is on few
    of its pages."""
    # Copies of a page count once; equal rows meet before the shuffle.
    return (
        parsed.select("host", "article", F.explode("subtrees").alias("subtree"))
        .distinct()
        .groupBy("host", "subtree")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_pages)
        .select("host", "subtree")
    )


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, host) per page; text is empty where there is none.

    pages: page_id, url and html; other columns are ignored. Null and empty html give empty text, a
    null url is a host of its own (without a name), equal rows get equal texts, and an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "pages")
    parsed = parse_pages(pages)
    # Text is most of the input: pack it tighter than usual.
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    decided = parsed.where(F.col("text").isNotNull()).select("page_id", "url", "host", "text")
    opened = parsed.where(F.col("text").isNull()).withColumn(
        "key", F.xxhash64("host", "article", "subtrees", "blocks")
    )
    template = templates(parsed, least_pages)
    gone = (
        opened.select("key", "host", F.explode(F.array_distinct(F.flatten("blocks.inside"))).alias("subtree"))
        .distinct()
        .join(template, ["host", "subtree"], "left_semi")
        .groupBy("key")
        .agg(F.collect_list("subtree").alias("gone"))
    )
    kept = F.filter(
        "blocks",
        lambda b: ~F.arrays_overlap(b["inside"], F.coalesce("gone", F.array().cast("array<long>"))),
    )
    cleaned = opened.join(gone, "key", "left").select(
        "page_id",
        "url",
        "host",
        F.array_join(F.transform(kept, lambda b: b["block"]), "\n\n").alias("text"),
    )
    return decided.unionByName(cleaned).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host"
    )
