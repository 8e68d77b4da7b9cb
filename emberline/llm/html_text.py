"""Main text of web pages: rules for page furniture, and removal of what a site's pages have in common.

A page is parsed into a tree. Elements that are furniture by their name, role or class go (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, ...). What the rules don't know is
found by counting: the subtree of an element is hashed, and Spark counts for each host under how many
different main texts a subtree occurs. Subtrees that occur under many are the site's template and
are deleted, too. Copies of an article on many pages don't make it template: they count as one main text.

Inside a page's declared article only containers can be template (a paragraph that many articles share is
part of each of them); without a declared article, every element can.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import SLICE_BYTES, slices
from emberline.llm.url_filter import split_url
from emberline.operators.ordered import spread_join

LEAST_TEXTS = 5  # different main texts of the host under which a template occurs at least
LEAST_SHARE = 0.2  # and their part of all of the host
HOST_SALTS = 64

# Element and attribute names of HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
FURNITURE = frozenset("nav footer aside form button select fieldset dialog menu svg canvas audio video object head datalist script style textarea title iframe noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt tr td th figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    """nav navbar navigation menu masthead footer sidebar rail widget cookie cookies consent gdpr banner notice notification alert popup modal overlay
    newsletter subscribe subscription signup login ad ads advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social
    related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist respond disqus replies search toolbar
    topbar skip paywall disclaimer""".split()
)
HEADERS = frozenset(("header",))
MAIN_WORDS = ("articlebody", "article", "post", "entry", "content", "main", "story")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": ("tr", ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": ("option", ("select",))}


class Page:
    """Elements in page order: name, parent, kind, and parts (a string, or the number of a child)."""

    def __init__(self, source: str):
        self.name = ["#root"]
        self.parent = [-1]
        self.kind = [""]  # "furniture", "header", "main:<rank>" or nothing
        self.label = [""]
        self.parts: list[list] = [[]]
        self._parse(source)
        self.main = self._main()
        self._drop_rules()

    def _parse(self, source: str) -> None:
        stack, at = [0], 0
        lower = None

        def text(s: str) -> None:
            if s:
                self.parts[stack[-1]].append(html.unescape(s) if "&" in s else s)

        def pop_to(i: int) -> None:
            del stack[i:]

        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                return
            text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.name[stack[i]] == name:
                        pop_to(i)
                        break
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if self.name[stack[i]] == "p":
                        pop_to(i)
                        break
                    if self.name[stack[i]] in ("table", "td", "button", "object"):
                        break
            if name in _SAME:
                names, stops = _SAME[name]
                for i in range(len(stack) - 1, 0, -1):
                    here = self.name[stack[i]]
                    if here == names or here in names and not isinstance(names, str):
                        pop_to(i)
                        break
                    if here in stops:
                        break
            number = self._open(name, m[3] if m[2] else m[6], stack[-1])
            if name in RAW:
                if lower is None:
                    lower = source.lower()
                end = lower.find("</" + name, at)
                if end < 0:
                    return
                close = source.find(">", end)
                at = close + 1 if close >= 0 else len(source)
            elif name not in VOID:
                stack.append(number)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        kind, label = "furniture" if name in FURNITURE else "header" if name == "header" else "", ""
        rank = {"article": 0, "main": 2}.get(name)
        if attributes and "=" in attributes or "hidden" in (attributes or "").lower():
            values = {}
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                values.setdefault(k.lower(), (a or b or c).lower())
            label = f"{values.get('id', '')} {values.get('class', '')}".strip()
            words = set(_SPLIT.split(label))
            role = values.get("role", "")
            if name not in ("html", "body", "main"):
                if name == "article" and not words & {"comment", "comments", "reply", "replies", "ad", "ads", "sponsored", "promo", "related"}:
                    pass
                elif words & WORDS or role in ROLES or values.get("aria-hidden") == "true" or "hidden" in values and values["hidden"] != "until-found" or "display:none" in values.get("style", "").replace(" ", ""):
                    kind = "furniture"
                elif words & HEADERS and not kind:
                    kind = "header"
            if rank is None and name in ("div", "section", "td"):
                if values.get("itemprop") == "articlebody" or role == "article":
                    rank = 1
                elif role == "main":
                    rank = 2
                else:
                    rank = next((3 + i for i, w in enumerate(MAIN_WORDS) if w in words), None)
        if kind == "" and rank is not None:
            kind = f"main:{rank}"
        number = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.kind.append(kind)
        self.label.append(label)
        self.parts.append([])
        self.parts[parent].append(number)
        return number

    def _main(self) -> int:
        """The declared article with most text outside furniture, by the best kind of declaration; 0 without one."""
        size = [0] * len(self.name)
        for i in range(len(self.name) - 1, -1, -1):
            if self.kind[i] == "furniture":
                size[i] = 0
                continue
            size[i] += sum(len(p) for p in self.parts[i] if isinstance(p, str) and not p.isspace())
            if i:
                size[self.parent[i]] += size[i]
        hidden = [False] * len(self.name)
        best, found = None, 0
        for i in range(1, len(self.name)):
            hidden[i] = hidden[self.parent[i]] or self.kind[i] == "furniture"
            if not hidden[i] and self.kind[i].startswith("main:") and size[i]:
                key = (-int(self.kind[i][5:]), size[i])
                if best is None or key > best:
                    best, found = key, i
        return found

    def _drop_rules(self) -> None:
        n = len(self.name)
        self.around = set()
        i = self.main
        while i >= 0:
            self.around.add(i)
            i = self.parent[i]
        self.inside = [False] * n
        self.gone = [False] * n
        for i in range(n):
            p = self.parent[i]
            self.inside[i] = i == self.main or p >= 0 and self.inside[p]
            self.gone[i] = p >= 0 and self.gone[p] or self.kind[i] == "furniture" and i not in self.around
            if self.kind[i] == "header" and i not in self.around and not self.gone[i] and not (self.main and self.inside[i]):
                self.gone[i] = True
        # of an article's own header only the headings are text
        for i in range(n):
            p = self.parent[i]
            if p >= 0 and not self.gone[i] and self._in_header(i) and not self._heading(i) and not self._has_heading(i):
                self.gone[i] = True

    def _in_header(self, i: int) -> bool:
        p = self.parent[i]
        while p > 0 and self.inside[p]:
            if self.kind[p] == "header":
                return True
            p = self.parent[p]
        return False

    def _heading(self, i: int) -> bool:
        while i > 0 and self.kind[i] != "header":
            if self.name[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return True
            i = self.parent[i]
        return False

    def _has_heading(self, i: int) -> bool:
        todo = [i]
        while todo:
            j = todo.pop()
            if self.name[j] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return True
            todo += [p for p in self.parts[j] if not isinstance(p, str)]
        return False

    def subtrees(self) -> dict[int, int]:
        """Hash of every subtree that may turn out to be template, by element."""
        n = len(self.name)
        digest = [0] * n
        empty = [True] * n
        out = {}
        for i in range(n - 1, 0, -1):
            if self.gone[i]:
                continue
            inner = []
            for p in self.parts[i]:
                if isinstance(p, str):
                    s = " ".join(p.split())
                    if s:
                        inner.append("t" + s)
                        empty[i] = False
                elif not self.gone[p]:
                    inner.append(f"e{digest[p]}")
                    empty[i] &= empty[p]
            digest[i] = xxhash.xxh64_intdigest(f"{self.name[i]}|{self.label[i]}|" + "\x00".join(inner))
            if not empty[i] and i not in self.around and (self.name[i] in BLOCKS or self.name[i] in PROSE):
                if not (self.main and self.inside[i] and (self.name[i] in PROSE or self._in_prose(i))):
                    if not self.main or self.inside[i]:
                        out[i] = digest[i] - (1 << 64) if digest[i] >> 63 else digest[i]
        return out

    def _in_prose(self, i: int) -> bool:
        i = self.parent[i]
        while i > 0 and i != self.main:
            if self.name[i] in PROSE:
                return True
            i = self.parent[i]
        return False

    def signature(self) -> int:
        """Stands for the main text: a hash of its longest piece."""
        longest = max((p for i in range(len(self.name)) if not self.gone[i] and (self.inside[i] or not self.main) for p in self.parts[i] if isinstance(p, str)), key=len, default="")
        h = xxhash.xxh64_intdigest(longest.strip())
        return h - (1 << 64) if h >> 63 else h

    def text(self, template: set[int] | frozenset[int] = frozenset()) -> str:
        """Blocks of the main text, one to a line, without the subtrees whose hash is in ``template``."""
        if template:
            for i, h in self.subtrees().items():
                if h in template:
                    self.gone[i] = True
        blocks: list[str] = []
        current: list[str] = []

        def flush() -> None:
            s = " ".join("".join(current).split())
            if s:
                blocks.append(s)
            current.clear()

        todo: list = [self.main]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                current.append(x)
            elif x is None:
                flush()
            elif not self.gone[x]:
                name = self.name[x]
                if name in ("br", "td", "th", "wbr"):
                    current.append(" " if name != "wbr" else "")
                if name in BLOCKS:
                    flush()
                    todo.append(None)
                todo += reversed(self.parts[x])
        flush()
        return "\n".join(blocks)


def _html(value: pa.Scalar) -> str:
    return value.as_py() or ""


def host_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(host, templates)``: the subtree hashes that recur under many different main texts of a host.

    A host has at most ``elements of a page / least_share`` of them. Pages without a host belong to no site.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts, signs, hashes = [], [], []
            for u, h in zip(b.column("url").to_pylist(), b.column("html")):
                host = split_url(u)[0]
                if host:
                    page = Page(_html(h))
                    found = {0, *page.subtrees().values()}  # 0 counts the main texts of the host
                    hosts += [host] * len(found)
                    signs += [page.signature()] * len(found)
                    hashes += found
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(signs, pa.int64())], names=["host", "subtree", "sign"])

    source = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    seen = source.mapInArrow(run, "host string, subtree long, sign long").groupBy("host", "subtree", "sign").agg(F.lit(1).alias("one"))
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {int(least_texts)}")
    totals = counts.where("subtree = 0").select(F.col("host").alias("h"), F.col("n").alias("total"))
    often = counts.where("subtree <> 0").join(totals, F.col("host") == F.col("h")).where(F.col("n") >= F.col("total") * least_share)
    return often.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(id, url, text, n_chars)`` for every row of ``pages``.

    White space in a block becomes one space, blocks are joined by a line feed. NULL and empty pages have
    an empty text. Rows may repeat; a NULL url or one without a host has no site and so no template.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1), capitals, capitals.lower())
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    known = host_templates(pages, id_col, url_col, html_col, least_texts, least_share)
    kind = source.schema["id"].dataType.simpleString()

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            raw = [_html(h).encode("utf-8", "surrogatepass") for h in b.column("html")]
            yield pa.record_batch([b.column("id"), b.column("url"), b.column("host"), pa.array([len(r) for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], names=["id", "url", "host", "size", "zipped"])

    # pages cross the shuffle compressed one by one
    zipped = source.mapInArrow(small, f"id {kind}, url string, host string, size long, zipped binary")
    # a host may have a third of all pages: its pages are spread over as many sub-keys
    joined = spread_join(zipped, known, ["host"], F.col("id"), salts=HOST_SALTS).select("id", "url", "size", "zipped", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in slices(batches, "zipped", SLICE_BYTES // 4):
            sources = (codec.decompress(z.as_buffer(), n, asbytes=True).decode("utf-8", "surrogatepass") for z, n in zip(b.column("zipped"), b.column("size").to_pylist()))
            texts = [Page(h).text(frozenset(t or ())) for h, t in zip(sources, b.column("templates").to_pylist())]
            yield pa.record_batch([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
