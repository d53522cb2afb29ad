"""Main text of web pages by removing what the pages of a site share.

Every element subtree outside the marked article's own paragraphs is hashed; Spark counts, per host, the different pages
that hold it. Subtrees that recur on many pages of their host are the site's template and are deleted. What a count
cannot show (a host with one page, a menu that differs from page to page) is left to the names of elements: menus,
forms, scripts and the like, and classes that name adverts, notices, sharing bars and reader comments.

1. pages -> (host, subtree hash, text hash, page key); distinct texts are counted per (host, hash): rows are combined in
   each task before they are shuffled, so a host with a third of all pages is many tasks. Pages with the same main text
   count once, so that copies of an article are no template.
2. The subtrees of each page are joined to the recurring ones; what matches is gathered per page (at most the page's own
   elements) and joined to the pages, whose text travels compressed.
3. Each page is cut down and its blocks are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm.common import as_text, checkpoint
from gridstrata.llm.markup import BLOCKS, Page, attributes

#: A subtree is template if it is on at least so many different pages of its host, and on this share of them.
LEAST, SHARE = 3, 0.01

# fixed values: elements without reading text, and words in class, id and role that name parts around an article
SKIPPED = frozenset(
    "head title script style noscript template nav aside form iframe object embed svg canvas math audio video select button "
    "textarea input dialog menu noframes noembed".split())
AROUND = frozenset({"header", "footer"})
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody caption dd dt figcaption".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion banner "
    "banners sidebar sidebars navigation navbar nav menu menus breadcrumb breadcrumbs toolbar pagination pager cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget widgets masthead skip hidden colophon disclaimer".split())
COMMENTS = frozenset("comment comments commentlist replies respond discussion disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str) -> str:
    """Lower-case host of a url; empty if it names none."""
    found = _HOST.match(url.strip())
    return found[1].lower() if found else ""


_PLAIN = (frozenset(), False, "")


def _named(rest: str) -> tuple[set[str], bool, str]:
    """Words of class and id, whether the element is hidden, its role."""
    a = attributes(rest)
    words = set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    style = a.get("style", "").replace(" ", "").lower()
    gone = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return words, gone, a.get("role", "").lower() if "itemprop" not in a or a["itemprop"].lower() != "articlebody" else "articlebody"


class Cut:
    """A page with what its markup says: which elements go, which hold the article, which may be template."""

    def __init__(self, html: str):
        self.page = p = Page(html)
        n = len(p.tag)
        self.gone = [False] * n
        words = [_named(rest) if rest else _PLAIN for rest in p.marks]
        comment = [words[i] is not _PLAIN and bool(words[i][0] & COMMENTS) and p.tag[i] not in ("html", "body") for i in range(n)]
        self.article = self._article(words, comment)
        self.inside = [False] * n  # in the article or the article itself
        holds = [False] * n  # an element around the article
        for i in self.article:
            up = i
            while up and not holds[up]:
                holds[up] = True
                up = p.parent[up]
            holds[0] = True
        marked = set(self.article)
        for i in range(1, n):
            self.inside[i] = i in marked or self.inside[p.parent[i]]
        half = sum(p.letters[i] for i in self.article) if self.article else p.letters[0]
        for i in range(1, n):
            if self.gone[p.parent[i]]:
                self.gone[i] = True
                continue
            tag, (named, hidden, role) = p.tag[i], words[i]
            if holds[i]:
                continue
            large = 2 * p.letters[i] > half or tag in ("html", "body")
            self.gone[i] = (
                tag in SKIPPED
                or comment[i] and (not large or tag != "div" or bool(named <= COMMENTS | {"list", "area", "section"}))
                or tag in AROUND and (tag == "footer" or not self.inside[i])
                or hidden and not large
                or role in ROLES and not large
                or bool(named & PARTS) and not large
                or bool(named & AROUND) and not self.inside[i] and not large)
        self.holds, self.half = holds, half

    def _article(self, words: list, comment: list[bool]) -> list[int]:
        """Elements that hold the main text: outermost articles with text, else the article body or main element."""
        p = self.page
        skip = [False] * len(p.tag)
        kinds: dict[str, list[int]] = {"article": [], "body": [], "main": []}
        for i in range(1, len(p.tag)):
            named, _, role = words[i]
            skip[i] = skip[p.parent[i]] or p.tag[i] in SKIPPED or p.tag[i] in AROUND or comment[i] or p.tag[i] == "article" and bool(named & PARTS)
            if skip[i] or not p.letters[i]:
                continue
            if p.tag[i] == "article" or role == "article":
                kinds["article"].append(i)
            elif role == "articlebody":
                kinds["body"].append(i)
            elif p.tag[i] == "main" or role == "main":
                kinds["main"].append(i)
        for found in kinds.values():
            if found:
                out: list[int] = []
                for i in found:
                    if not out or i > p.last[out[-1]]:
                        out.append(i)
                return out
        return []

    def open(self) -> list[int]:
        """Elements that are template if their host repeats them: no paragraph of the article, nothing that holds most of the text."""
        p, out = self.page, []
        single = [0] * len(p.tag)
        for i in range(1, len(p.tag)):
            single[p.parent[i]] += bool(p.letters[i])
        for i in range(1, len(p.tag)):
            if not p.letters[i] or self.holds[i] or 2 * p.letters[i] > self.half and self.inside[i] or p.tag[i] in ("html", "body", "head"):
                continue
            if self.inside[i] and (p.tag[i] in PARAGRAPHS or p.tag[i] not in BLOCKS):
                continue
            if not self.article and 2 * p.letters[i] > self.half:
                continue
            up = p.parent[i]
            if up and single[up] == 1 and not p.own[up] and p.letters[up] == p.letters[i] and not self.holds[up] and p.tag[up] not in ("html", "body"):
                continue  # the element around it holds nothing else
            out.append(i)
        return out

    def text(self, template: frozenset = frozenset()) -> str:
        """Blocks of what is left, one a line."""
        p = self.page
        gone = list(self.gone)
        if template:
            for i in self.open():
                gone[i] = gone[i] or p.hashes[i] in template
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[p.parent[i]]
        blocks, line = [], []
        for node, text in p.pieces:
            if text is None:
                blocks.append("".join(line))
                line = []
            elif not gone[node] and (not self.article or self.inside[node]):
                line.append(text)
        blocks.append("".join(line))
        clean = (" ".join(x.split()) for x in blocks)
        return "\n".join(x for x in clean if x)


def _hash(*parts: str | int) -> int:
    """A signed 64-bit hash."""
    raw = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    """Host, html and key of each page; pages equal in host and html have one key."""
    for batch in batches:
        urls, pages = (as_text(batch.column(k)).to_pylist() for k in (0, 1))
        for url, html in zip(urls, pages):
            host = host_of(url)
            yield host, html, xxhash.xxh3_128_digest(f"{host}\0{html}".encode("utf-8", "surrogatepass"))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, text, page) of the pages whose url names a host; subtree null stands for the page itself."""
    names = ("host", "subtree", "text", "page")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns: list[list] = [[] for _ in names]

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], list(names))
        for x in columns:
            x.clear()
        return out

    for host, html, key in _pages(batches):
        if not host or not html:
            continue
        cut = Cut(html)
        trees = [None, *{cut.page.hashes[i] - (1 << 63) for i in cut.open()}]
        for column, values in zip(columns, ([_hash(host)], trees, [_hash(cut.text() or html)], [key])):
            column += values if values is trees else values * len(trees)
        if len(columns[0]) > 50_000:
            yield flush()
    yield flush()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the page's key and compressed html."""
    press = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        pages = list(_pages([batch.select([1, 2])]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([k for _, _, k in pages], pa.binary()),
             pa.array([press.compress(h.encode("utf-8", "surrogatepass")) for _, h, _ in pages], pa.binary())],
            ["row", "url", "page", "html"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for html, template in zip(batch.column(2), batch.column(3)):
            source = open_.decompress(html.as_py()).decode("utf-8", "surrogatepass")
            marks = frozenset(t + (1 << 63) for t in template.as_py() or ())
            texts.append(Cut(source).text(marks).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["row", "url", "text"])


def subtrees(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (host, subtree, text, page): hashes of the host, of what may be template, of the main text, and the page's key."""
    rows = df.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_subtrees, "host long, subtree long, text long, page binary")


def templates(found: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Rows (host, subtree, n) of ``subtrees`` on n different pages of a host, at least ``least`` and a ``share`` of them.

    Pages of a host with the same main text count once. Pages whose url names no host count for none.
    """
    counted = checkpoint(found.select("host", "subtree", "text").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")))
    pages = counted.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    recurring = counted.where(F.col("subtree").isNotNull() & (F.col("n") >= least))
    return recurring.join(pages, "host").where(F.col("n") >= F.col("pages") * share).select("host", "subtree", "n")


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Rows (``key``, ``url``, text, n_chars), one for each row of ``df``; other columns are not read.

    Null html is empty and gives an empty text; so does a page without any reading text. Null or odd urls name no host:
    such pages are cut by their markup alone. Rows that repeat, also with null keys, are all kept. An empty table gives no
    rows. Character references are decoded, a run of white space inside a block is one space, blocks are joined by a line
    end; unpaired surrogates from character references become question marks. Time grows with the length of a page.
    """
    found = checkpoint(subtrees(df, url, html))
    recurring = checkpoint(templates(found, least, share).select("host", "subtree"))
    members = found.where("subtree IS NOT NULL").select("host", "subtree", "page")
    marks = members.join(recurring, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("template"))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("row"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    packed = rows.mapInArrow(_packed, f"row {kind}, url string, page binary, html binary")
    joined = packed.join(checkpoint(marks), "page", "left").select("row", "url", "html", "template")
    texts = joined.mapInArrow(_extracted, f"row {kind}, url string, text string")
    return texts.select(F.col("row").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
