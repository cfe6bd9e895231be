"""Writing pairs back into pages, contents lists and packages."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.functions.text import has_han, relative_path, safe_uid
from quireflow.operators.dom import TEXT, VOID, Node, parsed

HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("footer nav script style".split())


def laid_out(html: str) -> tuple[list[Node], list[Node]]:
    """(top nodes, text nodes in reading order) of a page made ready for pairing.

    Scripts, styles, navigation and footers go. With a body, headings in headers move to its
    start, in order, and the headers go; without one they stay.
    """
    order = parsed(html)
    body = next((n for n in order if n.tag == "body"), None)

    def below(node: Node, tags: frozenset[str]) -> bool:
        while node.parent is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    for n in order:
        if n.tag in DROPPED:
            n.parent.kids.remove(n)
    if body is not None:
        header = frozenset({"header"})
        moved = [n for n in order if n.tag in HEADS and not below(n, DROPPED) and below(n.parent, header)]
        for n in order:
            if n.tag == "header" and n in n.parent.kids:
                n.parent.kids.remove(n)
        for n in moved:
            n.parent = body
        body.kids[:0] = moved
    top = order[0].parent if order else None
    while top is not None and top.parent is not None:
        top = top.parent
    found: list[Node] = []
    stack = [k for k in reversed(top.kids) if isinstance(k, Node)] if top is not None else []
    while stack:
        n = stack.pop()
        if n.tag in TEXT and n.text:
            found.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return ([] if top is None else top.kids), found


def markup(kids: list, added: dict[int, tuple[str, list[str]]]) -> str:
    """XHTML of the nodes; after a node in ``added`` comes a paragraph with that text and those classes."""
    out: list[str] = []
    stack: list = list(reversed(kids))
    while stack:
        k = stack.pop()
        if isinstance(k, tuple):
            out.append(k[0])
        elif isinstance(k, str):
            out.append(escape(k, quote=False))
        else:
            attrs = dict(k.attrs)
            if id(k) in added:
                attrs["class"] = " ".join(dict.fromkeys([*attrs.get("class", "").split(), "src"]))
            head = f"<{k.tag}" + "".join(f' {a}="{escape(v)}"' for a, v in attrs.items())
            after = ""
            if id(k) in added:
                text, classes = added[id(k)]
                after = f'<p class="{escape(" ".join(classes))}">{escape(text, quote=False)}</p>'
            if k.tag in VOID:
                out.append(f"{head}/>{after}")
            else:
                out.append(f"{head}>")
                stack.append((f"</{k.tag}>{after}",))
                stack += reversed(k.kids)
    return "".join(out)


def nodes_to_pair(pages: DataFrame, item_col: str = "item", html_col: str = "html") -> DataFrame:
    """(item, n from 1, tag, text) of the text nodes that ``bilingual_pages`` will follow with targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = laid_out(html or "")[1]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([n.tag for n in found], pa.string()), pa.array([n.text for n in found], pa.string())], ["item", "n", "tag", "text"])

    return pages.select(F.col(item_col).cast("string").alias("item"), F.col(html_col).alias("html")).mapInArrow(run, "item string, n int, tag string, text string")


def bilingual_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, html) with each pair's target set after its source; pairs as from ``pairing.pairs``, pages (item, html, role, labels map<string,string>).

    Links of a contents page get their label beside them, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html, role, labels, rows in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                kids, found = laid_out(html or "")
                added = {}
                for r in rows or []:
                    node = found[r["n"] - 1]
                    own = [c for c in node.attrs.get("class", "").split() if c != "src"]
                    added[id(node)] = (r["target"], list(dict.fromkeys(["tgt", "tgt-zh", *own, *(["unpaired"] if r["unpaired"] else [])])))
                if role == "contents":
                    known, stack = dict(labels or []), [k for k in kids if isinstance(k, Node)]
                    while stack:
                        n = stack.pop()
                        stack += [k for k in n.kids if isinstance(k, Node)]
                        if n.tag == "a" and "｜" not in n.text and known.get(n.text):
                            n.kids = [f"{n.text} ｜ {known[n.text]}"]
                out.append(markup(kids, added))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["item", "html"])

    rows = pairs.groupBy("item").agg(F.collect_list(F.struct("n", "target", "unpaired")).alias("rows"))
    both = pages.join(rows, "item", "left").select(F.col("item").cast("string").alias("item"), "html", "role", "labels", "rows")
    return both.mapInArrow(run, "item string, html string")


def patched_ncx(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(book_id, xml) with the points of whole pages relabelled; documents (book_id, xml), labels (book_id, path, label, pos if they have an order), the first of a file name counts. Null XML stays null, malformed XML as it is."""
    order = F.struct("pos", "path") if "pos" in labels.columns else F.struct("path", "label")
    first = labels.groupBy("book_id", F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.min_by("label", order).alias("label"))
    maps = first.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "label"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for xml, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    root, known = ElementTree.fromstring(xml or ""), dict(m or [])
                except ElementTree.ParseError:
                    out.append(xml)
                    continue
                space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
                if space:
                    ElementTree.register_namespace("", space[1:-1])
                for point in root.iter(f"{space}navPoint"):
                    content = point.find(f"{space}content")
                    src = "" if content is None else content.get("src", "")
                    label = known.get(unquote(src).rpartition("/")[2])
                    if not src or "#" in src or not label:
                        continue
                    box = point.find(f"{space}navLabel")
                    if box is None:
                        point.insert(0, box := ElementTree.Element(f"{space}navLabel"))
                    text = box.find(f"{space}text")
                    if text is None:
                        text = ElementTree.SubElement(box, f"{space}text")
                    text.text = label
                out.append(ElementTree.tostring(root, encoding="unicode"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["book_id", "xml"])

    return documents.join(maps, "book_id", "left").select("book_id", "xml", "m").mapInArrow(run, "book_id string, xml string")


MEDIA = {"css": "text/css", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "otf": "font/otf", "png": "image/png", "svg": "image/svg+xml", "ttf": "font/ttf", "webp": "image/webp", "woff": "font/woff", "woff2": "font/woff2", "xhtml": "application/xhtml+xml"}


def minimal_package(entries: DataFrame, assets: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, opf): a package for books without one. entries (book_id, pos, idref, path), assets (book_id, path), books (book_id, title, root)."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    kind = F.coalesce(kinds[F.lower(F.element_at(F.split("path", r"\."), -1))], F.lit("application/octet-stream"))
    item = lambda uid: F.concat(F.lit('<item id="'), esc(uid), F.lit('" href="'), esc(relative_path(F.col("path"), F.col("root"))), F.lit('" media-type="'), kind, F.lit('"/>'))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", c.alias("x")))), lambda s: s["x"]), "")
    pages = entries.join(books, "book_id").withColumn("o", F.format_string("0%09d", "pos"))
    pages = pages.select("book_id", "o", item(F.col("idref")).alias("i"), F.concat(F.lit('<itemref idref="'), esc(F.col("idref")), F.lit('"/>')).alias("r"))
    extra = assets.join(books, "book_id").select("book_id", F.concat(F.lit("1"), "path").alias("o"), item(F.concat(F.lit("a_"), safe_uid(F.col("path")))).alias("i"), F.lit("").alias("r"))
    body = pages.union(extra).groupBy("book_id").agg(listed(F.col("i")).alias("items"), listed(F.col("r")).alias("refs")).join(books, "book_id")
    head = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">'), esc(F.col("book_id")), F.lit("</dc:identifier><dc:title>"), esc(F.coalesce("title", F.lit("Book"))), F.lit("</dc:title><dc:language>zh-Hant</dc:language></metadata><manifest>"))
    return body.select("book_id", F.concat(head, "items", F.lit("</manifest><spine>"), "refs", F.lit("</spine></package>")).alias("opf"))


def source_only_texts(nodes: DataFrame) -> DataFrame:
    """(book_id, texts): the source texts without Han on source-only pages, each once, in order. nodes (book_id, pos, classes, text)."""
    kept = nodes.where(F.array_contains("classes", "src") & (F.col("text") != "") & ~has_han(F.col("text")))
    first = kept.groupBy("book_id", "text").agg(F.min("pos").alias("pos"))
    return first.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))


def listed_exceptions(payload: DataFrame) -> DataFrame:
    """(book_id, text) from (book_id, json): a list of strings or of objects with src_text; anything else gives nothing."""
    v = F.try_parse_json("json")
    each = payload.select("book_id", F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("x"))
    return each.select("book_id", F.coalesce(F.try_variant_get("x", "$.src_text", "string"), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string"))).alias("text")).where("text is not null").distinct()
