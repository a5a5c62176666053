"""Main text of web pages by a site style tree.

Every page is parsed into blocks of text, each under a path of elements (tag, id, class, role).
The paths of all pages of a host are merged into one tree of style nodes.  A node's importance
comes from the entropy, over the host's different pages, of what stands under it: of its content
and of its presentation (the tags below it).  A branch that looks and reads the same on page after
page has an entropy near 0 and goes; an article differs from page to page and stays.

Kinds of element that are never main text (menus, forms, scripts, ...) go by tag, role or class,
whatever their entropy.  If a page has an ``article`` or ``main`` element, what lies outside goes.

Pages and counts are merged by aggregation, so no host is ever in one task.  Nodes are counted on
different pages only (copies of a page are one).  Importance shrinks towards 1, what a node seen once
has, by ``PRIOR`` pages, so it falls smoothly with the pages that repeat a branch.

Defined results: null or empty html gives an empty text; unclosed and stray tags, comments and
attributes without end are read as browsers do, roughly; a null or odd url makes a host of its own;
rows with equal ``page_id`` are pages of their own.
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

from tonegauge.llm.store import keep

PRIOR, LEAST_IMPORTANCE, CONTENT_SHARE = 0.6, 0.15, 0.7

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: class names that tell what a page has, not what an element is; read so on wrappers only
_LAYOUT = re.compile(r"(?:(?:has|with|without|no|page|is)[-_])+")
_LAYOUT_WORD = re.compile(r"\b(?:has|with|without|no|page|is)[-_]", re.I)
_OUTLINE = re.compile(r"<(/?)(?:(article|main)|div|section|center)\b", re.I)
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
#: an opening tag ends open elements of these names in its own container
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
ENDS |= {b: {"p"} for b in BLOCKS - set(ENDS) - {"body", "html"}}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
MAIN = frozenset(("article", "main"))
NEVER = frozenset("""script style noscript template head title nav footer aside form menu dialog button select option textarea
    input label svg canvas math iframe object embed audio video map noembed noframes xmp""".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead banner cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing
    social related recommended recommendations pagination pager widget widgets toolbar comment comments reply replies respond
    disqus discussion copyright disclaimer skip""".split())
#: only outside the article: an article's own header holds its title
OUTSIDE_WORDS = frozenset(("header", "topbar", "top"))


def _wrappers(source: str) -> set[int]:
    """Where the elements begin that hold an article."""
    out: set[int] = set()
    opened: list[int] = []
    done = 0
    for m in _OUTLINE.finditer(source):
        if m[2]:
            if not m[1]:
                out.update(opened[done:])
                done = len(opened)
        elif not m[1]:
            opened.append(m.start())
        elif opened:
            opened.pop()
            done = min(done, len(opened))
    return out


class Page:
    """Blocks of a page in order: (path of style nodes, text, lies in the article)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str, bool]] = []
        self.tags: dict[tuple[str, ...], list[str]] = {}
        self.has_main = False
        self._parse(source)

    def _parse(self, source: str) -> None:
        names: list[str] = []      # open elements
        nodes: list[str] = []      # their style nodes
        dead: list[bool] = []      # lies in an element that is never main text
        inside: list[bool] = []    # lies in an article
        parts: list[str] = []
        at = 0

        def flush():
            if parts:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                parts.clear()
                if text and not (dead and dead[-1]):
                    # inline elements are no style nodes of their own
                    path = tuple(x for n, x in zip(names, nodes) if n in BLOCKS)
                    self.blocks.append((path, text, bool(inside and inside[-1])))

        def close(to: int):
            if any(n in BLOCKS for n in names[to:]):
                flush()
            del names[to:], nodes[to:], dead[to:], inside[to:]

        def text(x: str):
            if x:
                parts.append(html.unescape(x) if "&" in x else x)

        end = len(source)
        wrappers = _wrappers(source) if _LAYOUT_WORD.search(source) else ()

        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at: m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["close"]:
                if name in names:
                    close(len(names) - 1 - names[::-1].index(name))
                elif name in ("p", "br"):
                    parts.append(" ") if name == "br" else flush()
                continue
            ends, fence = ENDS.get(name), CONTAINERS.get(name, BLOCKS - {"p"} if name in ENDS else ())
            if ends:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] in ends:
                        close(i)
                        if name not in ("tr", "tbody", "tfoot"):
                            break
                    elif names[i] in fence:
                        break
            if name in BLOCKS:
                flush()
            elif name == "br":
                parts.append(" ")
            node, never = self._style(name, m["rest"], bool(inside and inside[-1]), m.start() in wrappers)
            if name in BLOCKS:
                self.tags.setdefault(tuple(x for n, x in zip(names, nodes) if n in BLOCKS), []).append(name)
            if name in VOID:
                continue
            if name in MAIN and not never and not (dead and dead[-1]):
                self.has_main = True
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                if name not in NEVER:
                    text(source[at: stop.start() if stop else end])
                at = stop.end() if stop else end
                continue
            if m["rest"].endswith("/") and name not in BLOCKS:
                continue
            names.append(name)
            nodes.append(node)
            dead.append(never or bool(dead and dead[-1]))
            inside.append(name in MAIN or bool(inside and inside[-1]))
        flush()

    @staticmethod
    def _style(name: str, rest: str, inside: bool, wrapper: bool) -> tuple[str, bool]:
        """(style node, is it never main text)."""
        never = name in NEVER or (name == "header" and not inside)
        if "=" not in rest:
            return name, never
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}
        if name not in ("html", "body"):
            words = {w for k in ("class", "id") for x in found.get(k, "").lower().split() if not (wrapper and _LAYOUT.match(x)) for w in re.split(r"[^a-z]+", x)}
            if name not in MAIN or words & {"comment", "comments", "related", "ad", "sponsored"}:
                never = never or bool(words & NEVER_WORDS) or (not inside and bool(words & OUTSIDE_WORDS))
            never = never or found.get("role", "").lower() in NEVER_ROLES
        # numbers in ids tell one page's element from the next one's, not its style
        style = ".".join([name, *(re.sub(r"\d+", "0", found[k]) for k in ("id", "class", "role") if k in found)])
        return style, never

    def candidates(self) -> Iterator[tuple[tuple[str, ...], str]]:
        for path, text, inside in self.blocks:
            if inside or not self.has_main:
                yield path, text


def _hash(*x: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(x)) - (1 << 63)


def _branches(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [path[:i] for i in range(1, len(path) + 1)]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else url or ""


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, content, tags, page): hashes of each branch of each page with text below it."""
    def run(batches):
        for batch in batches:
            out = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source or "")
                below: dict[tuple[str, ...], list[str]] = {}
                for path, text in page.candidates():
                    for b in _branches(path):
                        below.setdefault(b, []).append(text)
                whole = _hash(*(t for _, t in page.candidates()))
                host = host_of(url)
                for b, texts in below.items():
                    out.append((host, _hash(*b), _hash(*texts), _hash(*page.tags.get(b, ())), whole))
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["host", "node", "content", "tags", "page"])
    return pages.select("url", "html").mapInArrow(run, "host string, node long, content long, tags long, page long").distinct()


def _entropy(nodes: DataFrame, what: str) -> DataFrame:
    """(host, node, n, e): pages with the node, and the entropy of ``what`` in units of log n."""
    each = nodes.groupBy("host", "node", what).agg(F.count("*").cast("double").alias("c"))
    out = each.groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return out.select("host", "node", "n", F.when(F.col("n") > 1, 1 - F.col("s") / (F.col("n") * F.log("n"))).otherwise(1.0).alias("e"))


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, nodes): per host, the branches that look and read the same on page after page."""
    nodes = keep(style_nodes(pages), "nodes")
    content = _entropy(nodes, "content").withColumnRenamed("e", "content")
    tags = _entropy(nodes, "tags").select("host", "node", F.col("e").alias("tags"))
    score = F.col("content") * CONTENT_SHARE + F.col("tags") * (1 - CONTENT_SHARE)
    shrunk = (F.col("n") * score + PRIOR) / (F.col("n") + PRIOR)
    low = content.join(tags, ["host", "node"]).filter(shrunk < LEAST_IMPORTANCE)
    return low.groupBy("host").agg(F.collect_list("node").alias("low"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    low = keep(unimportant(pages), "low")

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    named = pages.select("page_id", "url", "html").mapInArrow(hosts, "page_id long, url string, html string, host string")

    def run(batches):
        for batch in batches:
            texts = []
            for source, gone in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
                page, gone = Page(source or ""), set(gone or ())
                texts.append("\n".join(t for path, t in page.candidates() if not gone or not any(_hash(*b) in gone for b in _branches(path))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                                             ["page_id", "url", "text", "n_chars"])

    return (named.join(low, "host", "left").select("page_id", "url", "html", "low")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
