"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its elements, told apart by their path, and its runs of text. Tokens with one occurrence vector over
the pages of a host (how often each page has them) form an equivalence class. A class is valid if its tokens occur once
in each of its pages; valid classes nest into the template. The template's elements cut a page into slots. The article is
in the innermost element of the template that holds most of the host's text, with the headings beside it: all slots
outside of it are left out, whatever their names, and so is text that belongs to the template itself. Within it, parts
that are named as menus, adverts, comments and the like are left out by name. Only pages that don't fit a template, and
hosts with too few pages for one where all hosts share none either, are read by the names of their elements alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, ship

ship(__name__)

#: Hosts with fewer pages show no template of their own; they take that of all hosts.
MIN_PAGES = 8
#: Tokens are part of the template if so many hundredths of the host's pages with any text have them.
SUPPORT = 90
#: The article's element holds so many hundredths of the text that isn't outside by name.
SHARE = 60
#: Templates with at most so many tokens in all are broadcast.
BROADCAST_TOKENS = 1_000_000

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "button", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
#: Words in a class, id or role that say a part isn't the article.
OUTSIDE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget"}
ARTICLES, HEADINGS = {"article", "main"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Page:
    """tokens: (key, whether it's text, characters in it, key of its parent) in page order; runs: for each run its
    text, block number and element. A token of text is a whole block, which inline elements don't end; `blocks` has its key.

    Keys are hashes of a parent's key with a name, so that deep pages take no more memory than flat ones.
    """

    def __init__(self, html: str | None, container: int = 0, beside: int = 0) -> None:
        self.tokens: list[list] = []
        self.runs: list[tuple[str, int, _Element]] = []
        self.blocks: dict[int, int] = {}
        self.container, self.beside, self.total, self.fits = container, beside, 0, False
        self.open: Counter[str] = Counter()
        html = html or ""
        root = _Element("", 0, None, False, False, False, False)
        stack: list[_Element] = [root]
        at = block = 0
        # no tag ends beyond the last ">"; up to it each search ends at one, so broken markup is read in linear time
        last = html.rfind(">") + 1
        for m in MARKUP.finditer(html, 0, last):
            if m.start() < at:
                continue
            self._text(html[at : m.start()], stack[-1], block)
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)
                continue
            closing, attrs = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
            if name not in INLINE:
                self._end_block(block)
                block += 1
            if closing:
                if self.open[name]:
                    self._cut(stack, next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            elif name in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at, last)
                at = end.end() if end else len(html)
            elif name not in VOID and name not in INLINE:
                if name in ENDS_P:
                    self._drop(stack, {"p"})
                if name in CLOSES:
                    self._drop(stack, CLOSES[name])
                self._enter(name, " ".join(x.strip("\"'").lower() for x in ATTR.findall(attrs)), stack)
        self._text(html[at:].split("<!--", 1)[0], stack[-1], block)
        self._end_block(block)
        self._cut(stack, 1)

    def _enter(self, name: str, mark: str, stack: list[_Element]) -> None:
        up = stack[-1]
        key = token_id(f"{up.key:x}/{name}.{mark}")
        named = name in OUTSIDE or bool(mark) and not OUTSIDE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", mark))
        chosen = key == self.container
        self.fits |= chosen
        inside = up.inside or chosen or (name in HEADINGS and up.key == self.beside and bool(self.container))
        # a name counts below the template's element only, but for headings, which stand beside it
        below = (up.below or named) if up.inside else named and not chosen
        token = [key, False, self.total, up.key]
        self.tokens.append(token)
        self.open[name] += 1
        stack.append(_Element(name, key, token, up.out or named, up.article or name in ARTICLES, inside, below))

    def _text(self, raw: str, where: _Element, block: int) -> None:
        if raw:
            text = unescape(raw)
            self.runs.append((text, block, where))
            if not where.out:
                self.total += sum(map(len, text.split()))

    def _end_block(self, block: int) -> None:
        first = next((i for i in range(len(self.runs), 0, -1) if self.runs[i - 1][1] != block), 0)
        words = "".join(t for t, *_ in self.runs[first:]).split()
        if words:
            where = self.runs[first][2]
            self.blocks[block] = token_id(f"{where.key:x}#{' '.join(words)}")
            self.tokens.append([self.blocks[block], True, sum(map(len, words)), where.key])

    def _drop(self, stack: list[_Element], names: set[str]) -> None:
        """Ends an open element of these names, if no other kind of container stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                self._cut(stack, i)
                return
            if stack[i].name not in CLOSES:
                return

    def _cut(self, stack: list[_Element], i: int) -> None:
        for e in stack[i:]:
            self.open[e.name] -= 1
            e.token[2] = self.total - e.token[2]
        del stack[i:]

    def main_text(self, texts: set[int]) -> str:
        """The slots' text: runs in the template's element, or by names where the page doesn't have it; no template text."""
        narrow = not self.fits and any(w.article for *_, w in self.runs)
        drop = {b for b, key in self.blocks.items() if key in texts}
        blocks: list[list[str]] = []
        last = None
        for text, block, w in self.runs:
            if self.fits and (not w.inside or w.below) or not self.fits and (w.out or narrow and not w.article) or block in drop:
                continue
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
        return " ".join(t for b in blocks if (t := " ".join("".join(b).split())))


class _Element(NamedTuple):
    """An open element. out: it or an element around it is outside by name; article: it or one around it is an article;
    inside: it is in the template's element; below: outside by name, counted from that element."""

    name: str
    key: int
    token: list | None
    out: bool
    article: bool
    inside: bool
    below: bool


def token_id(key: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) >> 1


def host(url: str = "url") -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, page, token, text (whether it's a run of text), n (times on the page), place (of its first occurrence),
    chars (in it) and parent. A page without tokens has no rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for h, row, html in zip(b.column(0), b.column(1), b.column(2)):
                seen: dict[int, list] = {}
                for i, (key, text, chars, parent) in enumerate(Page(html.as_py()).tokens):
                    if (old := seen.get(key)) is None:
                        seen[key] = [h.as_py(), row.as_py(), key, text, 1, i, chars, parent]
                    else:
                        old[4] += 1
                        old[6] += chars
                for one in seen.values():
                    for c, v in zip(cols, one):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "page", "token", "text", "n", "place", "chars", "parent"])

    return pages.select(host().alias("host"), F.xxhash64("url", "html").alias("page"), "html").mapInArrow(each, "host string, page long, token long, text boolean, n int, place int, chars long, parent long")


def nest(classes: list[list[tuple[float, int]]]) -> list[int]:
    """Tokens of the classes that nest, from the class with most pages down. Each class lists (place, token) in order.

    A class nests if no class that is already in the template has a token between its tokens while it also lies outside
    that class: all of its tokens must fall into one slot of every accepted class, or span it wholly.
    """
    taken: list[list[tuple[float, int]]] = []
    for c in classes:
        first, last = c[0][0], c[-1][0]
        if all(sum(first < p < last for p, _ in t) in (0, len(t)) for t in taken):
            taken.append(c)
    return [token for c in taken for _, token in c]


def article_of(tokens: dict[int, dict]) -> tuple[int, int]:
    """The innermost template element with SHARE hundredths of the text, and its parent; zeros if there is none."""
    elements = [t for t in tokens.values() if not t["text"]]
    most = max((t["chars"] for t in elements), default=0)
    fit = [t for t in elements if most and 100 * t["chars"] >= SHARE * most]
    if not fit:
        return 0, 0
    inner = min(fit, key=lambda t: (t["chars"], -t["place"]))
    return inner["token"], inner["parent"]


def templates(pages: DataFrame) -> DataFrame:
    """host, container, beside (its parent) and texts (template text), of hosts with at least MIN_PAGES pages that have
    any token; the template that all hosts share has a null host.

    An occurrence vector is kept as a sum of hashes of (page, times), so classes come from additive aggregates, and a
    host that has most of the pages is summed up in parts. Tokens are considered if SUPPORT hundredths of the host's
    pages have them just once. Hence a template has at most 100 / SUPPORT times the tokens of a page.
    """
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector")
    sums = [F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum(F.col("place") * F.col("pages")) / F.sum("pages")).alias("place"), F.sum("chars").alias("chars"), F.min("parent").alias("parent"), F.sum("vector").cast("decimal(38,0)").alias("vector")]
    first = occurrences(pages).groupBy("host", "token", "text").agg(F.count("*").alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.min("parent").alias("parent"), vector)
    by_token = cut(first)
    every = by_token.where("not text").groupBy("token", "text").agg(*sums).select(F.lit(None).cast("string").alias("host"), *[c for c in by_token.columns if c != "host"])
    both = by_token.unionByName(every).where("least = 1 and most = 1")
    sizes = pages.where(F.btrim(F.coalesce("html", F.lit(""))) != "").groupBy(host().alias("host")).agg(F.count("*").alias("of"))
    sizes = cut(sizes.union(sizes.agg(F.lit(None).cast("string"), F.sum("of"))))
    own = join_small(both, sizes, ["host"], "inner").where((F.col("of") >= MIN_PAGES) & (100 * F.col("pages") >= SUPPORT * F.col("of")))
    classes = own.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("place", "token", "text", "chars", "parent"))).alias("tokens"))
    per_host = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pages", F.size("tokens").alias("size"), "tokens")), asc=False).alias("classes"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            containers, besides, texts = [], [], []
            for row in b.column(1).to_pylist():
                known = {t["token"]: t for c in row for t in c["tokens"]}
                template = {k: known[k] for k in nest([[(t["place"], t["token"]) for t in c["tokens"]] for c in row])}
                container, beside = article_of(template)
                containers.append(container)
                besides.append(beside)
                texts.append([k for k, t in template.items() if t["text"]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(containers, pa.int64()), pa.array(besides, pa.int64()), pa.array(texts, pa.list_(pa.int64()))], ["host", "container", "beside", "texts"])

    return cut(per_host.mapInArrow(each, "host string, container long, beside long, texts array<long>"))


def main_text(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html). `found`: templates, instead of those of pages.

    Nulls: a null or empty html gives an empty text and counts in no template; pages without a URL form one host;
    page_id and url are carried. Repeated rows give equal texts. An empty table gives an empty result. Broken markup is
    read as far as it goes: an unclosed element ends with the element around it, an unclosed comment or script with the
    page. Other columns are ignored.
    """
    src = pages.select("page_id", "url", "html")
    own = templates(src) if found is None else found
    shared = own.where("host is null").first()
    shared_article = (shared.container, shared.beside) if shared else (0, 0)
    held = own.where("host is not null").agg(F.sum(F.size("texts") + 3)).first()[0] or 0
    joined = join_small(src.withColumn("host", host()), own.where("host is not null"), ["host"], limit=BROADCAST_TOKENS if held <= BROADCAST_TOKENS else -1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h, container, beside, known in zip(*[c for c in b.columns[2:]]):
                article = (container.as_py(), beside.as_py()) if container.is_valid else shared_article
                texts.append(Page(h.as_py(), *article).main_text(set(known.as_py()) if known.is_valid else set()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "container", "beside", "texts").mapInArrow(each, f"page_id {kind}, url string, text string, n_chars long")
