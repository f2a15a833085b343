"""Main text of web pages by template deduction.

A page's tokens are its elements, each named by its path: the tags and the normalised classes and ids from the root.  Over the
pages of a host, a token's occurrence vector says how often it is on each page; tokens with equal vectors are an
equivalence class.  Classes whose tokens are once on each of enough pages are valid: their elements are laid down
by the site, not by what is written.  As paths nest, valid classes nest, and make up the host's template.
The text below a token of the template, and below no deeper one, fills that token's slot.

Slots are told apart by their names (tags, classes and ids that say article, menu, advert and so on), and where names say
nothing, by what fills them over all pages: always the same text, or mostly links, is not the main text.
Hosts with few pages are taken together.

Vectors are sums of hashes of (page, count), so a host may have any number of pages: all that is known of it is
summed up where pages are read.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from motifmill.llm.tables import prepare
from motifmill.session import stage

#: A host with fewer pages is taken together with the others of that kind; share of a group's pages that a class needs.
FEW, SUPPORT = 3, 0.05
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th", "blockquote"}
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "svg", "object",
            "menu", "dialog", "canvas", "video", "audio", "textarea", "title"}
NOT_TEXT_NAMES = set("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar
    navigation breadcrumb breadcrumbs footer sidebar aside widget related recommended recommendations share sharing social cookie
    cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments
    disqus reply replies respond pagination pager copyright skip toolbar complementary contentinfo""".split())
HEADERS = {"header", "masthead", "topbar", "hero"}
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "main", "post", "entry", "story"}
#: Elements that no name drops; names that say nothing for sure within a main part.
KEPT = {"html", "body", "main", "article"}
UNSURE = {"notice", "notices", "alert"}


class Page:
    """Blocks of text of a page in order, each with the path of the element that holds it."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int, bool, bool]] = []
        self.opened: dict[str, int] = {}
        self.weak: set[str] = set()
        self._inside: list[tuple[frozenset, bool]] = []
        self._run(source)
        self._judge()

    def _judge(self):
        """Elements whose compound name says main part are it if they hold most of the page's open text."""
        size, total = {}, 0
        for (_, text, linked, dropped, _), (named, _) in zip(self.blocks, self._inside):
            if not dropped and 2 * linked < len(text):
                total += len(text)
                for k in named:
                    size[k] = size.get(k, 0) + len(text)
        held = {k for k, n in size.items() if 2 * n > total}
        self.blocks = [(path, text, linked, dropped, main or not dropped and bool(named & held))
                       for (path, text, linked, dropped, main), (named, _) in zip(self.blocks, self._inside)]
        # Where nothing else is, an article within a part that is dropped by its name is the main part.
        if not any(main and not dropped for _, _, _, dropped, main in self.blocks):
            self.blocks = [(path, text, linked, dropped and not buried, main or buried)
                           for (path, text, linked, dropped, main), (_, buried) in zip(self.blocks, self._inside)]

    def _run(self, source):
        # A frame: (tag, path, no text, in the main part, elements with a compound main name, dropped by tag, article in a dropped part,
        # a compound name that may say no text)
        stack = [("", "", False, False, frozenset(), False, False, False)]
        links, parts, linked, at, opened = 0, [], 0, 0, 0

        def flush():
            nonlocal parts, linked
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, path, dropped, main, named, _, buried, weak = stack[-1]
                self.blocks.append((path, text, min(linked, len(text)), dropped, main))
                self._inside.append((named, buried))
                if weak:
                    self.weak.add(path)
            parts, linked = [], 0

        def words(a, b):
            nonlocal linked
            if b > a:
                parts.append(source[a:b])
                if links:
                    linked += b - a

        while True:
            found = _TAG.search(source, at)
            if not found:
                words(at, len(source))
                break
            words(at, found.start())
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in INLINE:
                    continue
                flush()
                if any(f[0] == tag for f in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag in INLINE:
                links += tag == "a"
                continue
            flush()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                at = end.start() if end else len(source)
            if tag in CLOSES_ITSELF:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in HOLDS:
                        break
            if tag in MAIN:  # no menu holds the main part: one that is open was not closed
                for k in range(1, len(stack)):
                    if stack[k][0] in ("nav", "menu"):
                        del stack[k:]
                        links = 0
                        break
            names, own = [], set()
            for key, value in _NAME.findall(found[3] or found[6] or ""):
                value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower()
                names += [w for w in re.split(r"[^a-z0-9]+", value) if w]
                own.update(value.split())
            _, path, dropped, main, named, by_tag, buried, weak = stack[-1]
            pieces = set(names) - own
            if tag in KEPT:
                by_name = False
            else:
                by_name = bool(own & (NOT_TEXT_NAMES - UNSURE if main else NOT_TEXT_NAMES)) or not main and bool(own & HEADERS)
                weak = weak or bool(pieces & (NOT_TEXT_NAMES | HEADERS) or main and own & UNSURE)
            by_tag = by_tag or tag in NOT_TEXT or not main and tag in HEADERS
            if tag == "main" and not by_tag:
                dropped = weak = False
            buried = buried and not by_name or tag == "article" and dropped and not by_tag and not set(names) & NOT_TEXT_NAMES
            buried = buried and not by_tag
            dropped = dropped or by_tag or by_name
            main = main or not dropped and (tag in MAIN or bool(own & MAIN_NAMES))
            if not main and pieces & MAIN_NAMES:
                opened += 1
                named = named | {opened}
            label = ".".join([tag, *(re.sub(r"\d+", "0", w) for w in names[:4])])
            path = f"{path}/{label}"
            self.opened[path] = self.opened.get(path, 0) + 1
            stack.append((tag, path, dropped, main, named, by_tag, buried, weak))
        flush()


def host_of(url):
    """The host of a URL, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def _tokens(batches):
    """Per page and path: how often, and what text it holds itself."""
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for host, key, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
            page = Page(source or "")
            held: dict[str, list] = {}
            for path, text, linked, dropped, main in page.blocks:
                x = held.setdefault(path, [0, 0, 0, dropped, main])
                x[0], x[1], x[2] = x[0] + len(text), x[1] + linked, hash_of(x[2], text)
            for path, n in page.opened.items():
                x = held.get(path, (0, 0, 0, False, False))
                for column, value in zip(out, (host, key, path, n, *x, path in page.weak)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()),
             pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.int64()), pa.array(out[7], pa.bool_()),
             pa.array(out[8], pa.bool_()), pa.array(out[9], pa.bool_())],
            names=["host", "page", "path", "n", "chars", "linked", "text", "dropped", "main", "weak"])


def hash_of(seed: int, text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), seed)


def deduce(pages: DataFrame) -> DataFrame:
    """(grp, template, content, cut, open): each group's template paths, those whose slots hold main text, paths ruled out by name and
    slot, and those whose slots are neither constant nor mostly links.

    ``pages`` has page, grp and html.  A template has as many paths as the host has kinds of elements.
    """
    rows = pages.select(F.col("grp").alias("host"), "page", "html").mapInArrow(
        _tokens, "host string, page long, path string, n long, chars long, linked long, text long, dropped boolean, main boolean, weak boolean")
    vectors = stage(rows.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.min("text") == F.max("text")).alias("constant"),
        F.bool_or("dropped").alias("dropped"), F.bool_or("main").alias("main"), F.bool_or("weak").alias("weak")).withColumn(
        # What a piece of a compound name may rule out: dropped if it is always the same, or mostly links.
        "cut", F.col("weak") & (F.col("chars") > 0) & (F.col("constant") & (F.col("pages") > 1) | (2 * F.col("linked") >= F.col("chars")))
        ), "vectors")
    size = vectors.groupBy("host").agg(F.max("pages").alias("all"))
    # Classes of equal vectors; valid ones are once on each of enough pages.
    classes = vectors.groupBy("host", "vector", "pages", "total").agg(F.count("*").alias("tokens")).join(size, "host").filter(
        (F.col("total") == F.col("pages")) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(SUPPORT * F.col("all")))))
    template = stage(vectors.join(classes.select("host", "vector", "pages", "total"), ["host", "vector", "pages", "total"]).select(
        "host", "path"), "template")
    # Every path's text goes to the slot of its deepest ancestor in the template.
    steps = F.split("path", "/")
    above = vectors.withColumn("above", F.explode(F.transform(
        F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    slot = above.join(template.withColumnRenamed("path", "slot"), (above["above"] == F.col("slot")) & (
        above["host"] == template["host"])).select(above["host"], above["path"], "slot")
    deepest = slot.groupBy("host", "path").agg(F.max_by("slot", F.length("slot")).alias("slot"))
    slots = vectors.join(deepest, ["host", "path"]).groupBy("host", "slot").agg(
        F.sum(F.when(F.col("dropped") | F.col("cut"), 0).otherwise(F.col("chars"))).alias("chars"), F.sum(F.when(F.col("cut"), 0).otherwise(F.col("linked"))).alias("linked"),
        F.bool_and(F.col("constant") & (F.col("pages") > 1)).alias("constant"), F.bool_or("main").alias("main"))
    best = Window.partitionBy("host")
    open_ = (F.col("chars") > 0) & ~F.col("constant") & (2 * F.col("linked") < F.col("chars"))
    judged = slots.withColumn("any_main", F.max(F.col("main") & (F.col("chars") > 0)).over(best)).withColumn(
        "content", F.when(F.col("any_main"), F.col("main")).otherwise(open_))
    content = judged.groupBy("host").agg(F.collect_set(F.when(F.col("content"), F.col("slot"))).alias("content"),
                                         F.collect_set(F.when(open_, F.col("slot"))).alias("open"))
    cut = vectors.filter("cut").groupBy("host").agg(F.collect_set("path").alias("cut"))
    paths = template.groupBy("host").agg(F.collect_set("path").alias("template"))
    return vectors.select("host").distinct().join(paths, "host", "left").join(content, "host", "left").join(cut, "host", "left").select(
        F.col("host").alias("grp"), "template", "content", "cut", "open")


def main_text(page: Page, template: set[str], content: set[str], cut: set[str] = frozenset(), open_: set[str] = frozenset()) -> str:
    """Blocks in slots with main text or in a part of the page that is named so; if there are none, all that is not mostly links.

    On a page without a part that is named so, all open slots have main text, whatever the host's other pages name.
    """
    def in_slot(path):
        while path and path not in template:
            path = path.rpartition("/")[0]
        return path in content

    blocks = [b for b in page.blocks if not b[3] and b[0] not in cut]
    if not any(b[4] for b in blocks):
        content = content | open_
    kept = [b for b in blocks if b[4] or in_slot(b[0])]
    return " ".join(b[1] for b in kept or [b for b in blocks if 2 * b[2] < len(b[1])])


def _extract(batches):
    for batch in batches:
        texts = []
        for source, *sets in zip(*(batch.column(c).to_pylist() for c in ("html", "template", "content", "cut", "open"))):
            texts.append(main_text(Page(source or ""), *(set(x or ()) for x in sets)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html), repeated rows included.

    Null pages are empty and have an empty text; pages with a null or odd url belong to the hosts with few pages.
    """
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    many = stage(pages.groupBy("host").count().filter((F.col("count") >= FEW) & (F.col("host") != "")).select(
        "host", F.col("host").alias("grp")), "hosts")
    pages = pages.join(many, "host", "left").withColumn("grp", F.coalesce("grp", F.lit("*")))
    rules = stage(deduce(pages.select("grp", F.coalesce("page_id", F.lit(-1)).alias("page"), "html")), "rules")
    return pages.join(rules, "grp", "left").select("page_id", "url", "html", "template", "content", "cut", "open").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
