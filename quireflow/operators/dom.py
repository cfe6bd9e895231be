"""HTML to an interval-encoded node table, and the operators on it.

Each page is parsed once, in Arrow batches; the flags that need a whole tree are set in
the same pass, so that everything after is a filter, a window or a join on the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.text import basename, is_english

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())
BLOCK = TEXT | {"div", "figure", "img"}
CHROME = frozenset("footer header nav script style".split())
SILENT = frozenset("script style".split())
HEADINGS = frozenset("h1 h2 h3 h4".split())
HAN = re.compile("[\u4e00-\u9fff]")

#: Nodes that go out together.
BATCH = 5_000
SCHEMA = "doc string, pre int, post int, parent int, depth int, tag string, attrs map<string,string>, classes array<string>, text string, chars int, has_han boolean, in_chrome boolean, is_text_node boolean, block int"


class Node:
    """An element. Its text is a stretch of the page's runs of text, so that nested elements don't each hold a copy."""

    __slots__ = ("tag", "attrs", "parent", "kids", "pre", "post", "depth", "runs", "first", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.pre = self.post = -1
        self.depth = 0 if parent is None else parent.depth + 1
        self.runs: list[str] = []
        self.first = self.last = 0

    @property
    def text(self) -> str:
        return " ".join(self.runs[self.first : self.last])


class Tree(HTMLParser):
    """Tags nest as written: an end tag closes up to its nearest open start tag, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while self.at.parent is not None:
            closed, self.at = self.at, self.at.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.at.tag not in SILENT:
            self.at.kids.append(data)


def parsed(html: str) -> list[Node]:
    """The nodes in document order, numbered; the stripped texts of the page are kept once."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    order: list[Node] = []
    runs: list[str] = []
    stack: list[tuple[Node, int]] = [(tree.root, 0)]
    clock = 0
    while stack:
        node, i = stack.pop()
        if i == 0:
            node.runs, node.first = runs, len(runs)
            if node.parent is not None:
                node.pre = len(order)
                order.append(node)
        if i < len(node.kids):
            stack.append((node, i + 1))
            kid = node.kids[i]
            if isinstance(kid, str):
                if kid := kid.strip():
                    runs.append(kid)
            else:
                stack.append((kid, 0))
        else:
            node.last = len(runs)
            node.post = clock
            clock += 1
    return order


def shown_text(node: Node, wanted: bool) -> str | None:
    """The text of a node if it is ``wanted`` or all its own; of other headings the first 200 signs; else null."""
    if wanted or sum(isinstance(k, str) and bool(k.strip()) for k in node.kids) == node.last - node.first:
        return node.text
    return node.text[:200] if node.tag in HEADINGS and node.last - node.first < 100 else None


def flags(order: list[Node]) -> tuple[list[bool], list[bool], list[int | None]]:
    """Per node: below chrome; a text node; its place among the content blocks or null.

    A text node is a text tag with text and no text node above it. Blocks skip chrome; an
    image counts unless it stands in a text block with text; divisions and figures give way
    to what they hold.
    """
    chrome, text, block = [False] * len(order), [False] * len(order), [None] * len(order)
    below_text, below_block, n = [False] * len(order), [False] * len(order), 0
    for node in order:
        i, up = node.pre, node.parent.pre if node.parent is not None else -1
        chrome[i] = node.tag in CHROME or (up >= 0 and chrome[up])
        below_text[i] = up >= 0 and (below_text[up] or text[up])
        text[i] = node.tag in TEXT and not below_text[i] and node.last > node.first
        below_block[i] = up >= 0 and (below_block[up] or (block[up] is not None and order[up].tag in TEXT))
        if not chrome[i] and not below_block[i] and ((node.tag in TEXT and node.last > node.first) or (node.tag == "img" and node.attrs.get("src"))):
            block[i] = n
            n += 1
    return chrome, text, block


def shred(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The node table of every page; a null page has no nodes. Map-only.

    text is there for text nodes, blocks, headings, and nodes whose text is all their own; chars
    and has_han speak of all text below a node. Pages go out in batches of about ``BATCH`` nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]
        rows: list[tuple] = []
        for b in batches:
            for doc, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                order = parsed(html or "")
                if not order:
                    continue
                chrome, text, block = flags(order)
                runs = order[0].runs
                signs, han = [0, *accumulate(len(x) + 1 for x in runs)], [0, *accumulate(bool(HAN.search(x)) for x in runs)]
                for n, c, t, k in zip(order, chrome, text, block, strict=True):
                    rows.append((doc, n.pre, n.post, n.parent.pre, n.depth, n.tag, list(n.attrs.items()), n.attrs.get("class", "").split(), shown_text(n, t or k is not None), max(0, signs[n.last] - signs[n.first] - 1), han[n.last] > han[n.first], c, t, k))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return pages.select(F.col(id_col).cast("string").alias("doc"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def text_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_text_node").select("doc", "pre", "tag", "text")


def blocks(nodes: DataFrame) -> DataFrame:
    """(doc, block, type, text, src, alt) in document order; images by bare file name."""
    image = F.col("tag") == "img"
    return nodes.where("block is not null").select("doc", "block", F.when(image, "image").otherwise("text").alias("type"), F.when(~image, F.col("text")).alias("text"), F.when(image, basename(F.col("attrs")["src"])).alias("src"), F.when(image, F.coalesce(F.col("attrs")["alt"], F.lit(""))).alias("alt"))


def paragraphs(nodes: DataFrame) -> DataFrame:
    return blocks(nodes).where("type = 'text'").select("doc", "block", "text")


def images(nodes: DataFrame) -> DataFrame:
    src = F.col("attrs")["src"]
    return nodes.where((F.col("tag") == "img") & (src != "") & ~src.startswith("data:")).select("doc", basename(src).alias("name")).distinct()


def links(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag = 'a' and attrs['href'] is not null").select("doc", "pre", F.col("attrs")["href"].alias("href"))


def with_next(nodes: DataFrame) -> DataFrame:
    """Adds next_text, next_han (any Han in all its text) and next_classes of the next sibling element."""
    w = Window.partitionBy("doc", "parent").orderBy("pre")
    return nodes.withColumn("next_text", F.lead("text").over(w)).withColumn("next_han", F.lead("has_han").over(w)).withColumn("next_classes", F.lead("classes").over(w))


def uncovered(nodes: DataFrame) -> DataFrame:
    """(doc, pre, text) of English text nodes that no target follows, neither directly nor after a source element around them."""
    near = with_next(nodes)
    followed = F.coalesce("next_han", F.lit(False))
    target = F.arrays_overlap("classes", F.array(F.lit("tgt"), F.lit("tgt-zh")))
    open_ = near.where(F.col("is_text_node") & is_english(F.col("text")) & ~target & ~followed).select("doc", "pre", "post", "text")
    cover = near.where(F.array_contains("classes", "src") & followed).select(F.col("doc").alias("d"), F.col("pre").alias("a"), F.col("post").alias("z"))
    return open_.join(cover, (open_.doc == cover.d) & (cover.a < open_.pre) & (open_.post < cover.z), "left_anti").select("doc", "pre", "text")
