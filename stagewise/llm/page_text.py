"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. Its nodes are elements, told apart by their path from the root (tag, class and id with digits
folded). A node remembers how pages present it (the sequence of its children, runs of alike ones folded) and what
they put there (the texts of its blocks). Both are judged by entropy, as in Yi, Liu and Li (2003):

* presentation: the entropy of its styles over the pages, to base ``m``, the number of pages that have the node;
* content: one minus the mean, over the distinct texts of the node, of the entropy with which a text spreads over pages, to base ``m``;
* together, with ``l`` styles: ``(1 - 0.9^l) * presentation + 0.9^l * content``.

What most pages repeat in the same dress has low importance and is removed. A branch goes if all its nodes are low, which is to say that every
node goes that holds text and is low itself. Pages of a host with equal articles count once, so copies
of an article don't make it a template. A node that under ``MIN_PAGES`` pages of its host have is judged by the pages of all hosts together.

Markup that says what it is needs no statistics, and has importance zero: navigation, asides, footers, forms, scripts, adverts and the like by tag,
role, or a word of class or id. If a page has an ``article``, or else ``main``, text outside it is no part of the article.

Statistics are sums by (host, node, text), pre-aggregated; no host and no page meets in one task as a whole.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.tables import SMALL_ROWS, dropped, stored

#: Importance below which a node is noise, pages a host needs for a verdict of its own, weight of content against presentation.
THRESHOLD, MIN_PAGES, GAMMA = 0.3, 8, 0.9
MASK, FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15

# Kinds of HTML elements, and what elements are called that hold no part of an article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
FENCES = frozenset("table td th caption button object template".split())
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog footer form input map menu nav noscript object optgroup option progress search select svg template"
    " video".split()
)
NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split()
)
#: Whatever lies inside of these is no article, even an ``article``.
OUTER_WORDS = frozenset(
    "ad adbox ads adsense adslot advert advertisement advertising adverts comment comments commentlist discussion disqus promo promoted promotion"
    " recommendations recommended related replies reply responses sidebar sidebars sponsor sponsored sponsors teaser teasers".split()
)
NOISE_WORDS = OUTER_WORDS | frozenset(
    "alert banner breadcrumb breadcrumbs colophon consent cookie cookies copyright footer form gdpr header login masthead menu menus modal nav navbar"
    " navigation newsletter notice notices overlay pager pagination popup rail search searchbox share sharing signup skiplink social subscribe"
    " subscription tabs toolbar topbar widget widgets".split()
)
TITLE_WORDS = frozenset("article entry post story".split())
TITLE_PARTS = frozenset("header banner".split())
NEGATIONS = ("has", "no", "with", "without")

ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
VALUE_OR_END = re.compile(r"""=\s*(["'])|>""")
NAME = re.compile(r"[a-z][^\s/>]*", re.IGNORECASE)
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
NUMBERS = re.compile(r"\b\d+\b")
SPACE = re.compile(r"\s+")
HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)
CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
MARK_TYPE = "array<struct<node:long,kind:int,value:long,n:long>>"


def hashed(text: str, seed: int = 0) -> int:
    """64 bits of a text."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def signed(value: int) -> int:
    """As a long."""
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str | None) -> int:
    """Hash of the host of an address, in lower case; one value for all addresses without."""
    found = HOST.match(url or "")
    return hashed(found[1].lower()) if found else 0


def node_key(host: int, node: int) -> int:
    """A node of a host as one number."""
    return (host * FACTOR + node) & MASK


@dataclass
class Open:
    """An element that has not ended yet."""

    tag: str
    node: int
    declared: bool
    outer: bool
    region: int


@dataclass
class Block:
    """A run of text between the borders of blocks: its parts with the node, whether markup declares it noise, and its region."""

    parts: list[tuple[int, bool, str]] = field(default_factory=list)
    region: int = 0


def declared_kind(tag: str, attributes: dict[str, str], above: Open) -> tuple[bool, bool, int]:
    """Whether markup declares an element noise, whether for good, and its region: 2 article, 1 main, 0 neither."""
    role = attributes.get("role", "").lower()
    region = above.region
    if tag == "article" or role == "article" or "articlebody" in attributes.get("itemprop", "").lower():
        region = 2
    elif tag == "main" or role == "main":
        region = max(region, 1)
    outer = above.outer or (tag == "article" and above.region == 2)
    declared = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [x.lower() for x in HUMPS.findall(name)]
        if not words or words[0] in NEGATIONS:
            continue
        if not OUTER_WORDS.isdisjoint(words):
            outer = outer or tag not in ("html", "body", "main")
        found = NOISE_WORDS.intersection(words)
        if found and not (found <= TITLE_PARTS and (region or not TITLE_WORDS.isdisjoint(words))):
            declared = True
    if tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not region):
        declared = True
    if tag in ("html", "body", "main") or (region > above.region and not outer):
        return outer, outer, region
    return declared or outer or above.declared, outer, region


class Page:
    """The blocks of a page in order, and the style of each of its elements."""

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        self.styles: dict[int, int] = {}
        self._last: dict[int, int] = {}
        self._stack = [Open("#root", 1, False, False, 0)]
        self._count: dict[str, int] = {}
        self._now = Block()
        self._read(source or "")
        self._end_block()

    def _end_block(self) -> None:
        if self._now.parts:
            self.blocks.append(self._now)
        self._now = Block()

    def _say(self, text: str) -> None:
        """Text at the current place."""
        here = self._stack[-1]
        if text and (self._now.parts or not text.isspace()):
            self._now.parts.append((here.node, here.declared, text))
            self._now.region = max(self._now.region, here.region)

    def _child(self, key: int) -> None:
        """Count a child into the style of the current element, once for a run of alike ones."""
        node = self._stack[-1].node
        if self._last.get(node) != key:
            self._last[node] = key
            self.styles[node] = (self.styles.get(node, 0) * FACTOR + key) & MASK

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            gone = self._stack.pop()
            self._count[gone.tag] -= 1

    def _find(self, tags, fences) -> int:
        """Depth of the nearest open element among ``tags``, 0 if a fence or the root comes first."""
        if not any(self._count.get(tag) for tag in tags):
            return 0
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag in tags:
                return depth
            if tag in fences:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._end_block()
            if self._count.get("p") and (depth := self._find({"p"}, FENCES)):
                self._pop(depth)
            if tag in CLOSES and (depth := self._find(*CLOSES[tag])):
                self._pop(depth)
            if tag in HEADINGS and self._stack[-1].tag in HEADINGS:
                self._pop(len(self._stack) - 1)
        elif tag == "br":
            self._say(" ")
        if tag in VOID:
            self._child(hashed(tag))
            return
        found = {k.lower(): markup.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        above = self._stack[-1]
        declared, outer, region = declared_kind(tag, found, above)
        named = " ".join([tag, *sorted(DIGITS.sub("0", found.get("class", "")).lower().split()), "#" + DIGITS.sub("0", found.get("id", "")).lower()])
        key = hashed(named)
        self._child(key)
        if block or declared != above.declared or region != above.region:
            self._stack.append(Open(tag, (above.node * FACTOR + key) & MASK, declared, outer, region))
            self._count[tag] = self._count.get(tag, 0) + 1
            node = self._stack[-1].node
            self.styles.setdefault(node, 0)
            self._last.pop(node, None)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag in HEADINGS:
            depth = self._find(HEADINGS, FENCES)
        else:
            depth = self._find({tag}, FENCES - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
        if depth and tag not in ("html", "body"):
            self._pop(depth)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        unclosed = {'"': size + 1, "'": size + 1}
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            nxt = source[lt + 1 : lt + 2]
            closing = nxt == "/"
            name = NAME.match(source, lt + 1 + closing)
            if name is None:
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 2)
                    at = size if end < 0 else end + 3
                elif nxt in ("!", "?", "/"):
                    end = source.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    self._say("<")
                    at = lt + 1
                continue
            end = self._tag_end(source, name.end(), unclosed)
            if end < 0:
                return
            tag, attributes = name[0].lower(), source[name.end() : end]
            at = end + 1
            if closing:
                self._end(tag)
            elif tag in RAW:
                self._child(hashed(tag))
                found = CLOSERS[tag].search(source, at)
                if found is None:
                    return
                end = source.find(">", found.end())
                at = size if end < 0 else end + 1
            else:
                self._start(tag, attributes)

    @staticmethod
    def _tag_end(source: str, at: int, unclosed: dict[str, int]) -> int:
        """Place of the ``>`` that ends a tag, outside of quoted values unless a quote is never closed; -1 if the page ends first."""
        first = source.find(">", at)
        while (found := VALUE_OR_END.search(source, at)) and found[1]:
            quote = found[1]
            close = source.find(quote, found.end()) if found.end() < unclosed[quote] else -1
            if close < 0:
                unclosed[quote] = min(unclosed[quote], found.end())
                return first
            at = close + 1
        return found.start() if found else first

    def _text(self, text: str) -> None:
        self._say(markup.unescape(text) if "&" in text else text)


def block_text(parts: list[str]) -> str:
    """White space as single blanks, trimmed."""
    return SPACE.sub(" ", "".join(parts)).strip()


def shape_of(text: str) -> str:
    """A text with its numbers made alike, unless it is mostly numbers: counters and dates are no news."""
    found = NUMBERS.findall(text)
    return NUMBERS.sub("0", text) if found and 2 * sum(map(len, found)) < len(text) else text


def nothing(node: int) -> bool:
    """No node is noise."""
    return False


def main_text(page: Page, noise, declared: bool = True) -> str:
    """Blocks of the article: without noise, and of the innermost kind of region that has text. ``noise`` tells by node.

    A page of nothing but noise nodes keeps them: there the tree has seen one article under many addresses.
    """
    kept: list[tuple[int, str]] = []
    for block in page.blocks:
        text = block_text([text for node, said, text in block.parts if not (declared and said) and not noise(node)])
        if text:
            kept.append((block.region, text))
    if not kept and noise is not nothing:
        return main_text(page, nothing, declared)
    best = max((region for region, _ in kept), default=0)
    return "\n\n".join(text for region, text in kept if region == best)


def marks_of(page: Page) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Fingerprint of the text of the innermost kind of region outside declared parts, and what the page adds to the tree: (node, 0, style, 1) and (node, 1, text, times)."""
    times: dict[tuple[int, int], int] = {}
    prints = [0, 0, 0]
    for block in page.blocks:
        by_node: dict[tuple[int, bool], list[str]] = {}
        for node, said, text in block.parts:
            by_node.setdefault((node, said), []).append(text)
        for (node, said), texts in by_node.items():
            text = block_text(texts)
            if text:
                value = hashed(shape_of(text))
                times[node, value] = times.get((node, value), 0) + 1
                if not said:
                    prints[block.region] = (prints[block.region] * FACTOR + hashed(text)) & MASK
    nodes = {node for node, _ in times}
    marks = [(signed(node), 0, signed(page.styles.get(node, 0)), 1) for node in nodes]
    return prints[2] or prints[1] or prints[0], marks + [(signed(node), 1, signed(value), n) for (node, value), n in times.items()]


def tree(pages: DataFrame) -> DataFrame:
    """Stored sums of the merged trees: ``host``, ``node``, ``kind``, ``value``, ``n`` and ``e``, the sum of ``n ln n`` over pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, source in zip(frame["url"], frame["html"], strict=True):
                print_, marks = marks_of(Page(source))
                if marks:
                    rows.append((signed(host_of(url)), signed(print_), sorted(marks)))
            yield pd.DataFrame(rows, columns=["host", "print", "marks"])

    each = pages.select("url", "html").mapInPandas(run, f"host long, print long, marks {MARK_TYPE}")
    once = each.groupBy("host", "print").agg(F.min("marks").alias("marks"))
    rows = once.select("host", F.inline("marks"))
    spread = F.sum(F.col("n") * F.ln(F.col("n").cast("double")))
    return stored(rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), spread.alias("e")), "tree")


def importance(sums: DataFrame, *by: str) -> DataFrame:
    """``m`` (pages) and ``importance`` of nodes; 1 for those that a single page has."""
    style, text = F.col("kind") == 0, F.col("kind") == 1
    n, total = F.col("n").cast("double"), F.sum(F.when(style, F.col("n")))
    nodes = sums.groupBy(*by).agg(
        total.alias("m"),
        F.sum(F.when(style, 1)).alias("l"),
        F.sum(F.when(style, n * F.ln(n))).alias("styles"),
        F.avg(F.when(text, F.ln(n) - F.col("e") / n)).alias("texts"),
    )
    base, weight = F.ln(F.col("m").cast("double")), F.pow(F.lit(GAMMA), F.col("l").cast("double"))
    presentation = (base - F.col("styles") / F.col("m")) / base
    content = 1 - F.col("texts") / base
    value = F.when(F.col("m") > 1, (1 - weight) * presentation + weight * content).otherwise(1.0)
    return nodes.select(*by, "m", value.alias("importance"))


def noise_nodes(sums: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """Stored ``host``, ``node`` of the nodes of low importance."""
    low = F.col("importance") < threshold
    together = sums.groupBy("node", "kind", "value").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    common = importance(together, "node").filter((F.col("m") >= min_pages) & low).select("node")
    own = importance(sums, "host", "node")
    judged = own.filter((F.col("m") >= min_pages) & low).select("host", "node")
    rest = own.filter(F.col("m") < min_pages).select("host", "node")
    return stored(judged.unionByName(rest.join(common, "node").select("host", "node")), "noise")


def extract_text(
    pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, declared: bool = True, small: int = SMALL_ROWS
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``page_id``, ``url``, ``html``.

    A null or empty page, and one without text in its article, has empty text. Null and repeated ids are kept as they are; pages without an address
    make up one host. Other columns are ignored. ``declared=False`` leaves all to the tree. Noise nodes are sent to all tasks up to ``small``
    of them; beyond, each page is joined with those of its host.
    """
    sums = tree(pages)
    noise = noise_nodes(sums, threshold, min_pages)
    dropped(sums)
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    rows = pages.select("page_id", "url", "html")
    few = noise.count() <= small
    sent = None
    if few:
        found = noise.toPandas()
        keys = found["host"].to_numpy("i8").view("u8") * np.uint64(FACTOR) + found["node"].to_numpy("i8").view("u8")
        sent = pages.sparkSession.sparkContext.broadcast(np.unique(keys))
    else:
        by_host = noise.groupBy("host").agg(F.collect_list("node").alias("nodes"))
        rows = rows.withColumn("_host", _host_column(F.col("url"))).join(by_host, F.col("_host") == F.col("host"), "left")
        rows = rows.select("page_id", "url", "html", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = set(sent.value.tolist()) if few else set()
        for batch in batches:
            texts, nodes = [], None if few else batch.column("nodes")
            for place, (url, source) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                host = host_of(url)
                if not few:
                    keys = {node_key(host, x & MASK) for x in nodes[place].as_py() or ()}
                texts.append(main_text(Page(source), lambda node: node_key(host, node) in keys, declared) if source else "")
            found = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *found], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def _host_column(url: Column) -> Column:
    """``host_of`` over a column."""

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda x: signed(host_of(x)))

    run.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(url)
