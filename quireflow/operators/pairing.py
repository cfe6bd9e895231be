"""Pairing source nodes with translations, and the labels they fall back to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.text import blank_to_null, clean, ensure_han, is_identifier

#: Labels that every book shares: in texts and in contents lists.
STRUCTURAL = dict(x.split("=") for x in "About the Author=關於作者|Acknowledgments=致謝|Contents=目錄|GO TO NOTE REFERENCE IN TEXT=返回正文註記位置|Introduction=導論|Notes=註釋|PART I=第一部|PART II=第二部|Sign up now.=立即註冊。|Discover your next great read!=發現下一本精彩好書！|What's next on your reading list?=你的下一本書想讀什麼？|What’s next on your reading list?=你的下一本書想讀什麼？".split("|"))
CONTENTS = dict(x.split("=") for x in "Copyright=版權頁|Cover=封面|Dedication=獻辭|Title Page=書名頁".split("|")) | {k: STRUCTURAL[k] for k in ("Contents", "PART I", "PART II", "Acknowledgments", "Notes", "About the Author")}


def lookup(labels: dict[str, str], key: Column) -> Column:
    """The label of a key in a fixed dictionary, inside the plan: no join."""
    return F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])[key]


def nav_label(first: Column, override: Column, exact: Column) -> Column:
    """The target-language label: the book's own, then the shared ones as written, then with white space cleaned, then by exact text."""
    tidy = clean(first)
    return F.coalesce(blank_to_null(override), lookup(STRUCTURAL, first), lookup(CONTENTS, first), lookup(STRUCTURAL, tidy), lookup(CONTENTS, tidy), blank_to_null(exact), F.lit(""))


def display_label(first: Column, label: Column) -> Column:
    shown = F.coalesce(blank_to_null(clean(first)), F.lit("Untitled"))
    return F.when((F.coalesce(label, F.lit("")) != "") & (label != shown), F.concat(shown, F.lit(" ｜ "), label)).otherwise(shown)


def fallback(text: Column, exact: Column) -> Column:
    return F.coalesce(blank_to_null(exact), lookup(STRUCTURAL, text), F.lit(""))


def pairs(nodes: DataFrame, paragraphs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Positional pairing within an item.

    nodes (item, n from 1, tag, text, strategy), paragraphs (item, n from 1, text), labels
    (text, label). If an item has one node more than it has paragraphs and its first node is a
    bare "introduction" or "chapter", or a heading with a label of its own, that node takes
    the label and the paragraphs start at the second. Of labels for one text the smallest counts. Surplus paragraphs are dropped. Gives
    (item, n, text, target, unpaired); nodes without text, and identifiers without a
    target, are left out.
    """
    texts = nodes.withColumn("clean", clean(F.col("text")))
    if labels is not None:
        texts = texts.join(labels.groupBy(F.col("text").alias("clean")).agg(F.min("label").alias("own")), "clean", "left")
    else:
        texts = texts.withColumn("own", F.lit(None).cast("string"))
    first = F.struct("tag", "clean", "own")
    sizes = texts.groupBy("item").agg(F.count("*").alias("n_nodes"), F.min_by(first, "n").alias("first"))
    sizes = sizes.join(paragraphs.groupBy("item").agg(F.count("*").alias("n_targets")), "item", "left")
    head = F.col("first.clean")
    label = nav_label(head, F.lit(None).cast("string"), F.col("first.own"))
    bare = F.lower(head).isin("introduction", "chapter")
    titled = F.col("first.tag").rlike("^h[1-6]$") & (label != "") & (label != head)
    shift = F.when((F.col("n_nodes") == F.coalesce("n_targets", F.lit(0)) + 1) & (bare | titled), 1).otherwise(0)
    opening = F.when(bare, fallback(head, F.col("first.own"))).otherwise(label)
    sizes = sizes.select("item", shift.alias("shift"), opening.alias("opening"))
    placed = texts.join(sizes, "item").withColumn("at", F.col("n") - F.col("shift"))
    targets = paragraphs.select("item", F.col("n").alias("at"), F.col("text").alias("candidate"))
    both = placed.join(targets, ["item", "at"], "left")
    translate = F.col("strategy") == "translate"
    candidate = F.when(translate, F.when((F.col("shift") == 1) & (F.col("n") == 1), F.col("opening")).otherwise(F.col("candidate")))
    both = both.withColumn("candidate", blank_to_null(candidate)).where((F.col("clean") != "") & ~(is_identifier(F.col("clean")) & F.col("candidate").isNull()))
    target = ensure_han(F.coalesce("candidate", fallback(F.col("clean"), F.col("own"))), F.col("clean"))
    return both.select("item", "n", F.col("clean").alias("text"), target.alias("target"), (translate & F.col("candidate").isNull()).alias("unpaired"))


def children(entries: DataFrame) -> DataFrame:
    """(book_id, id, label, children): the contents list in order; rows of a part stand below its divider."""
    shown = entries.where("output_strategy not in ('drop_explicit', 'nav_generated') and role <> 'nav'")
    parts = shown.where("role = 'part_divider'").select("book_id", F.col("id").alias("parent_id"), F.lit(True).alias("nested"))
    placed = shown.join(parts, ["book_id", "parent_id"], "left")
    below = placed.where("nested").groupBy("book_id", F.col("parent_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "first_heading"))), lambda x: x["first_heading"]).alias("children"))
    top = placed.where("nested is null").join(below, ["book_id", "id"], "left")
    return top.select("book_id", "pos", "id", F.col("first_heading").alias("label"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def nav_document(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, xhtml): the contents page of each book; entries need path and shown (their label), titles (book_id, title)."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.concat(F.lit('<a href="'), esc(F.col("path")), F.lit('">'), esc(F.col("shown")), F.lit("</a>"))
    shown = entries.where("output_strategy not in ('drop_explicit', 'nav_generated') and role <> 'nav'").withColumn("link", link)
    parts = shown.where("role = 'part_divider'").select("book_id", F.col("id").alias("parent_id"), F.lit(True).alias("nested"))
    placed = shown.join(parts, ["book_id", "parent_id"], "left")
    listed = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", x.alias("x")))), lambda s: s["x"]), "")
    item = F.concat(F.lit("<li>"), F.col("link"), F.lit("</li>"))
    below = placed.where("nested").groupBy("book_id", F.col("parent_id").alias("id")).agg(listed(item).alias("below"))
    top = placed.where("nested is null").join(below, ["book_id", "id"], "left")
    whole = F.concat(F.lit("<li>"), F.col("link"), F.coalesce(F.concat(F.lit("<ol>"), F.col("below"), F.lit("</ol>")), F.lit("")), F.lit("</li>"))
    body = top.groupBy("book_id").agg(listed(whole).alias("body")).join(titles, "book_id", "left")
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>'), esc(F.coalesce("title", F.lit("Book"))), F.lit('</title></head><body><nav epub:type="toc"><ol>'), F.col("body"), F.lit("</ol></nav></body></html>"))
    return body.select("book_id", page.alias("xhtml"))


def numbered(texts: DataFrame, item: str, text: str, separator: str) -> DataFrame:
    """(item, n, text): the paragraphs of each text between separators, stripped, empty ones dropped."""
    from quireflow.functions.text import strip

    parts = F.filter(F.transform(F.split(F.col(text), separator), strip), lambda x: x != "")
    return texts.select(F.col(item).alias("item"), F.posexplode(parts).alias("n", "text")).withColumn("n", F.col("n") + 1)


def merged_overrides(titles: DataFrame, entries: DataFrame, known: DataFrame, overwrite: bool = False) -> DataFrame:
    """(book_id, key, value) of label overrides: those known, and the titles by first heading; known ones win unless ``overwrite``."""
    new = entries.join(titles, (entries.book_id == titles.book_id) & (entries.first_heading == titles.source)).select(entries.book_id, F.col("idref").alias("key"), F.col("target").alias("new"))
    new = new.groupBy("book_id", "key").agg(F.min("new").alias("new"))
    both = known.join(new, ["book_id", "key"], "full_outer")
    order = ("new", "value") if overwrite else ("value", "new")
    return both.select("book_id", "key", F.coalesce(*order).alias("value"))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
