"""Main text of pages by site style trees.

1. Pages are parsed to nodes: the text between two block bounds, under the path of block elements (tag and classes or id) above it. Only what is never
   shown (scripts, styles, heads, comments in markup) is left out here; menus, footers and the rest become nodes like any other.
2. The style tree of a site merges the nodes of all its pages by path and declared part. A node's evidence is an entropy over the site's pages: of the
   contents there, or of the presentations (the tags that follow one another below it), whichever is larger; 0 where all pages agree, 1 where all
   differ. Equal pages count once. All sums are grouped with map-side combining, so a site with very many pages is no task's.
3. A node's importance is the logistic of a prior and that evidence. The prior follows from what the page declares: elements that by tag, role, or a whole class
   or id are menus, headers, footers, sidebars, notices, adverts, forms or reader comments start low, so do nodes outside an article or main element on a page that has one with
   text; nodes in an article start high, its plain paragraphs and headings so high that repeating them takes nothing away. A name's part says nothing
   ("has-sidebar"), and no name makes noise of an article or main element, of what holds the only ones with text, or, on a page without
   such text, of what holds most of the text. The evidence weighs ``pages / (pages + SMOOTHING)``, so a small site leans on the prior and a large one on its pages, without a cut between them.
4. Nodes of an importance below one half are removed from each page. The rest is joined by single spaces, in page order.

Each page is parsed twice, so that its text never crosses a shuffle: first for the tree, whose rows are hashes, then to be cut. The nodes to remove
are a row for each site; they are broadcast up to ``BROADCAST_NODES`` of them, and beyond that joined by site, with sites salted.

Contract. A null or empty html has an empty text; a null or odd url has the host "". Broken markup is read as far as it goes: a tag ends at the next angle
bracket outside quotes, a quote that is never closed is a character. Markup of any nesting is read in time in proportion to its length. Pages of any length are read whole, by one task. Equal rows get equal
texts. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tensorfold.llm.frames import batched, joined_left, lean, written

#: Declared parts of a page and the log odds that they are main text.
NOISE, OUTSIDE, FREE, INSIDE, PLAIN = range(5)
PRIOR = {NOISE: -6.0, OUTSIDE: -6.0, FREE: 1.0, INSIDE: 3.0, PLAIN: 6.0}
SLOPE, PIVOT, SMOOTHING = 8.0, 0.5, 10.0
BROADCAST_NODES = 1 << 18
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head template svg math canvas audio video object map datalist".split()) | RAW
NOISE_TAGS = frozenset("nav footer aside form button select option label fieldset menu dialog".split()) | HIDDEN
BLOCKS = frozenset("html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr br center header details summary hgroup".split()) | NOISE_TAGS
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
MAIN = frozenset(("article", "main"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar\w*|side|aside|widgets?|menus?|nav\w*|breadcrumbs?|masthead|header|topbar|footer\w*|copyright|"
    r"comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|pagination|pager|skip|toolbar)",
    re.I,
)
# Possessive throughout, so that no text is read twice: a quote opens a value only after "=", and one that nothing closes is passed over once.
_TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|(?=<)|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_MARKS = re.compile(r"([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def _path(above: int, own: str) -> int:
    return xxh3_64_intdigest(own, above) or 1


class Page:
    """Nodes of one page: ``texts`` in page order and ``shown`` (elements with the tags below them), each with a path and a declared part."""

    def __init__(self, html: str):
        self.texts: list[tuple[int, str]] = []
        self.shown: list[tuple[int, str]] = []
        self._found: list[tuple[int, bool, bool, bool, int, str]] = []  # path, noise, main, plain, innermost doubtful element, text
        self._tags: dict[int, list] = {}  # path: flags as above, tags below
        # Elements with a noise word's name: the next one above (-1: none), and whether they lie in an article or main element.
        self._above: list[int] = []
        self._inside: list[bool] = []
        self._read(html)
        self._declare()

    def _read(self, html: str) -> None:
        # tag, path, noise, main, plain, innermost doubtful element, hidden
        stack: list[tuple[str, int, bool, bool, bool, int, bool]] = [("", 1, False, False, True, -1, False)]
        open_tags: Counter = Counter()
        held: list[str] = []
        at, end = 0, len(html)

        def flush():
            _, path, noise, main, plain, doubt, hidden = stack[-1]
            text = "" if hidden else " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                self._found.append((path, noise, main, plain, doubt, text))

        def close(tag):
            while True:
                top = stack.pop()[0]
                open_tags[top] -= 1
                if top == tag:
                    return

        while at < end:
            found = _TOKEN.search(html, at)
            if not found:
                held.append(html[at:])
                break
            held.append(html[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if open_tags[tag]:
                    flush()
                    close(tag)
                elif tag in BLOCKS:
                    flush()
                continue
            marks: dict[str, list[str]] = {}
            if "=" in found[3]:
                for k, a, b, c in _MARKS.findall(found[3]):
                    if (k := k.lower()) in ("class", "id", "role"):
                        marks.setdefault(k, (a or b or c).lower().split())  # the first of a name counts
            named = [*marks.get("class", ()), *marks.get("id", ())]
            doubtful = any(map(NOISE_WORDS.fullmatch, named))
            if tag not in BLOCKS and not doubtful:
                continue
            flush()
            if tag in VOID:
                continue
            if tag in RAW:
                stop = _ENDS[tag].search(html, at)
                at = stop.end() if stop else end
                continue
            if tag in BLOCKS and any(s[0] == "p" for s in stack[-3:]):
                close("p")
            for other in CLOSES.get(tag, ()):
                if any(s[0] == other for s in stack[-3:]):
                    close(other)
            _, path, noise, main, plain, doubt, hidden = stack[-1]
            roles = marks.get("role", ())
            noise = noise or tag in NOISE_TAGS or not NOISE_ROLES.isdisjoint(roles) or (tag == "header" and not main)
            hidden = hidden or tag in HIDDEN
            if doubtful and tag not in ("html", "body") and tag not in MAIN and "main" not in roles and not (main and "header" in named) and not noise:
                self._above.append(doubt)
                self._inside.append(main)
                doubt = len(self._inside) - 1
            if not hidden:
                self._tags.setdefault(path, [noise, main, plain, doubt, {}])[4][tag] = None
            main = main or tag in MAIN or "main" in roles
            stack.append((tag, _path(path, " ".join((tag, *sorted(named)))), noise, main, not named and (plain or tag in MAIN), doubt, hidden))
            open_tags[tag] += 1
        flush()

    def _declare(self) -> None:
        dropped = self._noise_by_name()
        article = any(main and not noise and not dropped[doubt] for _, noise, main, _, doubt, _ in self._found)

        def node(path, noise, main, plain, doubt):
            part = NOISE if noise or dropped[doubt] else (PLAIN if plain else INSIDE) if main else OUTSIDE if article else FREE
            return (path & ~7 | part) - (1 << 63)

        self.texts = [(node(*x[:5]), x[5]) for x in self._found]
        self.shown = [(node(path, *x[:4]), ">".join(x[4])) for path, x in self._tags.items()]

    def _noise_by_name(self) -> list[bool]:
        """Of each doubtful element, whether it or one above it is noise; one more for none. Elements come after those above them."""
        above, n = self._above, len(self._above)
        rest = [x for x in self._found if not x[1]]

        def below(noise):
            out = [False] * (n + 1)
            for k in range(n):
                out[k] = noise[k] or out[above[k]]
            return out

        if any(main and doubt < 0 for _, _, main, _, doubt, _ in rest):
            return below([True] * n)
        # Elements that hold the only articles with text.
        holds = [False] * n
        for _, _, main, _, k, _ in rest:
            while main and k >= 0 and not holds[k]:
                holds[k] = True
                k = above[k]
        named = below([self._inside[k] or not holds[k] for k in range(n)])
        if any(main and not named[doubt] for _, _, main, _, doubt, _ in rest):
            return named
        held = [0] * (n + 1)
        for *_, k, text in rest:
            held[k] += len(text)
        most = sum(held) / 2
        for k in range(n - 1, -1, -1):
            if above[k] >= 0:
                held[above[k]] += held[k]
        return below([held[k] <= most for k in range(n)])


def part_of(node: Column) -> Column:
    """The declared part, which the node's last three bits hold."""
    return node.bitwiseAND(F.lit(7)).cast("int")


NODES = "host string, page bigint, node bigint, kind int, value bigint, share double"


def _signed(x: int) -> int:
    return x - (1 << 63)


@lean
def _nodes(batches):
    """A row for each different value (text, or tags below) of each node of each page; ``share`` is one over the node's values on the page."""
    for b in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            page = Page(html.as_py() or "")
            own = {(node, kind, _signed(xxh3_64_intdigest(value))) for kind, pairs in enumerate((page.texts, page.shown)) for node, value in pairs}
            name = _signed(xxh3_64_intdigest(repr(sorted(own))))
            many = Counter(x[:2] for x in own)
            for node, kind, value in own:
                for c, x in zip(cols, (host, name, node, kind, value, 1 / many[node, kind]), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["host", "page", "node", "kind", "value", "share"])


def sites(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, html)"""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def style_tree(rows: DataFrame) -> DataFrame:
    """(host, node, pages, evidence, importance) of each node of each site's tree, of (host, html)."""
    values = rows.select("host", "html").mapInArrow(_nodes, NODES).distinct()
    counts = values.groupBy("host", "node", "kind", "value").agg(F.count("*").cast("double").alias("c"), F.sum("share").alias("share"))
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("share").alias("pages"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # From all pages alike, each value as often as there are pages, to no value seen twice.
    least, most = F.log(F.col("n") / F.col("pages")), F.log("n")
    entropy = F.log("n") - F.col("clogc") / F.col("n")
    rate = F.when(F.col("pages") > 1.5, F.least(F.greatest((entropy - least) / (most - least), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    nodes = sums.withColumn("rate", rate).groupBy("host", "node").agg(F.round(F.max("pages")).alias("pages"), F.round(F.max("rate"), 9).alias("evidence"))
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in PRIOR.items() for x in kv]), part_of(F.col("node")))
    seen = F.when(F.col("pages") > 1, F.col("pages") / (F.col("pages") + SMOOTHING)).otherwise(0.0)
    score = prior + seen * SLOPE * (F.col("evidence") - PIVOT)
    return nodes.withColumn("importance", 1 / (1 + F.exp(-score)))


def removed_nodes(rows: DataFrame) -> DataFrame:
    """(host, low): the nodes of little importance, a row for each site. A site has as many nodes as its pages have layouts."""
    return style_tree(rows).where("importance < 0.5").groupBy("host").agg(F.collect_set("node").alias("low"))


CUT = "page_id bigint, url string, text string"


@lean
def _cut(batches):
    for b in batches:
        texts = []
        for html, low in zip(b.column("html"), b.column("low"), strict=True):
            low = set(low.as_py() or ())
            texts.append(" ".join(text for node, text in Page(html.as_py() or "").texts if node not in low))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def cut(rows: DataFrame, low: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages without the nodes that are listed for their site."""
    entries = low.agg(F.sum(F.size("low"))).first()[0] or 0
    joined = joined_left(rows, low, "host", entries, BROADCAST_NODES, "page_id", "url")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_cut, CUT).withColumn("n_chars", F.char_length("text").cast("bigint"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    batched(pages.sparkSession, 500)
    rows = sites(pages)
    return cut(rows, written(removed_nodes(rows), "low-nodes"))


def importance(prior: float, pages: int, evidence: float) -> float:
    """The same as the column, for one node."""
    seen = pages / (pages + SMOOTHING) if pages > 1 else 0
    return 1 / (1 + exp(-(prior + seen * SLOPE * (evidence - PIVOT))))
