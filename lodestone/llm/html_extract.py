"""Main text of web pages by removal of site templates.

1. One pass parses each page and hashes the subtree of every container element outside
   article and main elements, whatever its name: once with its text (tags and text of all
   it holds) and, where at least half of its text is in links, once by shape alone (tags,
   classes and ids, of equal children one), for menus whose entries change.
2. Spark counts, for each host, the pages of different text on which a hash occurs with at
   most half of the page's text.  Hashes on SHARE of the host's pages, and LEAST of them,
   are the host's template.  What holds more than half of a page's text wherever it occurs
   is a text with copies, and nothing in an article or main element is ever a template.
3. A second pass parses each page again, next to the hashes of its host's template that it
   holds, and leaves their subtrees out.  Where a page has text in article or main elements
   after that, only text in the outermost of them counts.

What a host's pages can't show goes by its name: elements that by tag, role, class or id
aren't content (menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, comments of readers).  A class or id doesn't condemn what holds a main element.

Parsing is linear in the page: elements keep their parents, and what goes is passed down
from parents to children once.  Between the passes only hashes are written, and pages are
exchanged once, to meet theirs by a 128-bit key of their content.

Defined results: null and empty html give an empty text; a null or odd url counts as the
host ''; rows that repeat a page count once and get the same text each; broken
markup is read leniently (unclosed elements end with their parents, stray end tags are
ignored, `<` that begins no tag is text); an empty table gives an empty result; columns
other than page_id, url and html aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import cut

LEAST, SHARE = 3, 0.3
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
NAMED = re.compile(r"class|id|role|hidden", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "option", "label", "fieldset", "datalist"}
CHROME = {"header"}
MAIN = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "header", "footer", "center", "blockquote", "figure", "details", "nav", "aside", "form", "menu"}
BLOCKS = CONTAINERS | MAIN | DROP | {"html", "body", "p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "address", "figcaption", "hgroup", "summary", "hr", "br"}
#: An end tag or one of these closes an open p, unless one of WALLS was opened in it.
ENDS_P = BLOCKS - {"br"}
WALLS = ("td", "th", "table", "article")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
WORDS = COMMENTS | {
    "ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "menubar", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal",
    "newsletter", "subscribe", "subscription", "signup", "login", "share",
    "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "masthead", "skip", "search", "searchbox",
}
HASHES = "counted array<long>, present array<long>, content long"
#: How an element's name tells of it: not at all, by a class or id that a main element in
#: it outweighs, or for certain.
NOT, MAYBE, SURE = 0, 1, 2


def named(attributes: str) -> dict[str, str]:
    """class, id, role, hidden and aria-hidden, by exact names."""
    if not NAMED.search(attributes):
        return {}
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden"):
            found.setdefault(name, value.strip("\"'").lower())
    return found


def unwanted(tag: str, names: dict[str, str], in_main: bool) -> int:
    if tag in DROP or (tag in CHROME and not in_main) or "hidden" in names or names.get("aria-hidden") == "true" or names.get("role") in ROLES:
        return SURE
    if tag not in ("body", "html", "main") and (tag != "article" or in_main):
        words = set(re.split(r"[^a-z]+", names.get("class", "") + " " + names.get("id", "")))
        if not WORDS.isdisjoint(words):
            return MAYBE if COMMENTS.isdisjoint(words) else SURE
    return NOT


def signed(x: int) -> int:
    return x - (1 << 63)


class Element:
    """An open or closed block element."""

    __slots__ = ("digest", "has_main", "in_main", "kinds", "links", "name", "number", "own", "parent", "size", "tag", "text_hash", "verdict")

    def __init__(self, tag: str, names: dict[str, str], parent: Element | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.name = f"{tag} {names.get('class', '')} {names.get('id', '')}"
        self.in_main = parent is not None and (parent.in_main or tag in MAIN)
        self.verdict = unwanted(tag, names, parent is not None and parent.in_main)
        self.has_main = False
        self.digest, self.text_hash = xxhash.xxh3_64(tag.encode()), 0
        self.kinds: set[bytes] = set()
        self.size = self.links = 0

    def close(self) -> None:
        up = self.parent
        h = self.digest.digest()
        self.text_hash = signed(int.from_bytes(h, "big"))
        kind = xxhash.xxh3_64_digest(self.name.encode("utf-8", "replace") + b"".join(sorted(self.kinds)))
        self.own = kind
        up.digest.update(h)
        up.kinds.add(kind)
        up.size += self.size
        up.links += self.links
        up.has_main |= self.has_main or self.tag in MAIN

    def shape(self) -> int:
        """The shape of the subtree under the names of those around it."""
        path, e = [], self.parent
        while e is not None and len(path) < 8:
            path.append(e.name)
            e = e.parent
        return signed(xxhash.xxh3_64_intdigest(self.own + " < ".join(path).encode("utf-8", "replace")))


class Page:
    """Elements in page order, parents first, and blocks of text (text, element)."""

    def __init__(self, source: str | None):
        self.root = Element("", {}, None, 0)
        self.elements: list[Element] = []
        self.blocks: list[tuple[str, Element]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        # Open elements, and of each tag where its open ones are.  Inline elements are open
        # only if they go, and count in `hiding`; `linking` counts open links.
        stack: list[tuple[str, Element | None]] = [("", self.root)]
        where: dict[str, list[int]] = {}
        tops = [self.root]
        buffer: list[str] = []
        state = [0, 0, 0]  # hiding, linking, characters in links

        def flush() -> None:
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    top = tops[-1]
                    self.blocks.append((text, top))
                    top.digest.update(text.encode("utf-8", "replace"))
                    top.size += len(text)
                    top.links += min(len(text), state[2])
            state[2] = 0

        def close() -> None:
            tag, element = stack.pop()
            where[tag].pop()
            if element is None:
                state[0] -= 1
            else:
                tops.pop()
                element.close()

        def add(text: str) -> None:
            if not state[0]:
                buffer.append(text)
                if state[1]:
                    state[2] += len(text)

        def opened(tag: str, element: Element | None) -> None:
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, element))

        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCKS:
                    flush()
                if tag == "a":
                    state[1] = 0
                if where.get(tag):
                    depth = where[tag][-1]
                    while len(stack) > depth:
                        close()
                continue
            ends = m[3].rstrip().endswith("/")
            if tag in RAW:
                if not ends:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if tag in BLOCKS:
                flush()
                if tag in ENDS_P and where.get("p"):
                    depth = where["p"][-1]
                    if not any(where.get(w) and where[w][-1] > depth for w in WALLS):
                        while len(stack) > depth:
                            close()
                if tag in ("li", "dt", "dd", "td", "th", "tr") and stack[-1][0] == tag:
                    close()
            if tag in VOID:
                continue
            if tag == "a":
                state[1] = 1
            names = named(m[3]) if m[3] else {}
            if tag in BLOCKS:
                element = Element(tag, names, tops[-1], len(self.elements) + 1)
                self.elements.append(element)
                opened(tag, element)
                tops.append(element)
            elif names and not ends and unwanted(tag, names, tops[-1].in_main):
                state[0] += 1
                opened(tag, None)
        flush()
        while len(stack) > 1:
            close()

    def hashes(self) -> tuple[list[int], list[int], int]:
        """Hashes of containers with at most half of the page's text, those of all
        containers, and of the whole text."""
        total, counted, present = self.root.size, set(), set()
        shapes: dict[int, list[int]] = {}
        for e in self.elements:
            if e.tag in CONTAINERS and e.size and not e.in_main and not e.has_main:
                present.add(e.text_hash)
                if 2 * e.size <= total:
                    counted.add(e.text_hash)
                if 2 * e.links >= e.size:
                    shapes.setdefault(e.shape(), []).append(e.size)
        present |= shapes.keys()
        counted |= {h for h, sizes in shapes.items() if 2 * sum(sizes) <= total}
        content = xxhash.xxh3_64_intdigest("\n".join(t for t, _ in self.blocks).encode("utf-8", "replace"))
        return sorted(counted), sorted(present), signed(content)

    def text(self, gone: Iterable[int] | None = None) -> str:
        """The main text without subtrees of the hashes in `gone`."""
        gone = frozenset(() if gone is None else gone)
        out = [False] * (len(self.elements) + 1)
        for e in self.elements:
            out[e.number] = out[e.parent.number] or e.verdict == SURE or (e.verdict == MAYBE and not e.has_main)
            if gone and not out[e.number] and e.tag in CONTAINERS and e.size and not e.in_main and not e.has_main:
                out[e.number] = e.text_hash in gone or (2 * e.links >= e.size and e.shape() in gone)
        left = [(text, e.in_main) for text, e in self.blocks if not out[e.number]]
        if any(main for _, main in left):
            left = [x for x in left if x[1]]
        return " ".join(text for text, _ in left)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def hashed(pages: DataFrame) -> DataFrame:
    """key, host, hashes of the containers that count and of all, and of the whole text, of
    each row of pages with its key."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Page(t).hashes() for t in texts], columns=[c.split()[0] for c in HASHES.split(", ")])

    made = pages.select("key", host(F.col("url")).alias("host"), F.pandas_udf(run, HASHES)("html").alias("h"))
    return made.select("key", "host", "h.*")


def templates(hashes: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, hash) of subtrees on at least `least` pages of the host and `share` of them,
    pages of equal text counted once."""
    # A page's null stands for the page itself.
    marks = F.explode(F.concat("counted", F.array(F.lit(None).cast("long")))).alias("hash")
    seen = hashes.select("host", "content", marks).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    seen = cut(seen.filter(F.col("n") >= least))
    hosts = seen.filter("hash IS NULL").select("host", F.col("n").alias("pages"))
    return seen.filter("hash IS NOT NULL").join(hosts, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "hash")


def keyed(pages: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("page_id", "url", "html")]
    return pages.select("page_id", "url", "html", F.unhex(F.md5(F.concat_ws("\x00", *parts))).alias("key"))


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    rows = keyed(pages)
    hashes = cut(hashed(rows))
    found = hashes.select("key", "host", F.explode("present").alias("hash")).join(templates(hashes, least, share), ["host", "hash"])
    gone = found.groupBy("key").agg(F.collect_set("hash").alias("gone"))

    def run(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([Page(t).text(g) for t, g in zip(texts, gone, strict=True)], dtype=object)

    made = rows.join(gone, "key", "left").select("page_id", "url", F.pandas_udf(run, "string")("html", "gone").alias("text"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def extract_iter(sources: list[str | None]) -> Iterator[str]:
    """Texts without template removal, for pages outside Spark."""
    for s in sources:
        yield Page(s).text()
