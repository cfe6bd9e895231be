"""What the files of a book say: pages, translations, headings, contents lists and images, each by a fixed order of preference.

Nulls count as empty. Of equal candidates the first in reading order counts. An empty table gives
an empty one. Only the columns named in a docstring are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.text import basename, blank_to_null, clean, dirname, int_or_zero, is_prose, local_path, normpath, original_path, unquote
from quireflow.operators.gates import failures
from quireflow.plans.spine import role


def _preferred(rows: DataFrame, names: Column, files: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """For each key the first of its candidate ``names`` that is a file of the book, with the columns ``kept`` of that file."""
    tried = rows.select(*keys, F.posexplode(F.filter(names, lambda x: x.isNotNull() & (x != ""))).alias("rank", "name"))
    hit = tried.join(files.select("book_id", "name", *kept), ["book_id", "name"])
    best = hit.groupBy(*keys).agg(F.min_by(F.struct("name", *kept), "rank").alias("f"))
    return best.select(*keys, *[F.col(f"f.{c}").alias(c) for c in ("name", *kept)])


def translation_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, id, name, text): the translation of each entry (book_id, id, translation_id): a file of its id, else of its translation_id."""
    of = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("chapters/"), c, F.lit("_translation.txt")))
    return _preferred(entries, F.array(of(F.col("id")), of(F.col("translation_id"))), files, ["book_id", "id"], ["text"])


def source_pages(entries: DataFrame, files: DataFrame, opf_path: Column) -> DataFrame:
    """(book_id, id, name): the page of each entry (book_id, id, original_path, href, src_href) among the book's local files, in that order of columns."""
    e = entries.withColumn("__o", opf_path)
    local = lambda c: local_path(F.coalesce(c, F.lit("")), F.coalesce("__o", F.lit("")))
    names = F.array(local(F.col("original_path")), F.coalesce("href", F.lit("")), local(F.col("src_href")))
    return _preferred(e, names, files, ["book_id", "id"], [])


def nav_paths(books: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, path) of the contents page of each of ``books`` (book_id, opf_path).

    The first manifest item (book_id, ordinal, href, properties) with the property nav; else
    the first entry (book_id, pos, id, href, src_href, original_path, output_strategy, role)
    that stands for it; else nav.xhtml beside the package.
    """
    marked = items.where(F.coalesce(F.col("properties"), F.lit("")).rlike(r"\bnav\b") & (F.col("href") != "")).groupBy("book_id").agg(F.min_by("href", "ordinal").alias("a"))
    stands = entries.where("output_strategy = 'nav_generated' or role = 'nav'").join(books, "book_id")
    path = original_path(F.coalesce("original_path", F.lit("")), F.coalesce("src_href", F.lit("")), F.coalesce("href", F.lit("")), F.col("id"), F.coalesce("opf_path", F.lit("")))
    stands = stands.groupBy("book_id").agg(F.min_by(path, "pos").alias("b"))
    root = dirname(F.coalesce("opf_path", F.lit("")))
    beside = F.when(root == "", "nav.xhtml").otherwise(F.concat(root, F.lit("/nav.xhtml")))
    return books.join(marked, "book_id", "left").join(stands, "book_id", "left").select("book_id", F.coalesce(normpath(F.col("a")), "b", beside).alias("path"))


def ncx_paths(names: DataFrame) -> DataFrame:
    """(book_id, path): the first entry (book_id, ordinal, name) of an archive that ends in .ncx, in any case."""
    return names.where(F.lower("name").endswith(".ncx")).groupBy("book_id").agg(F.min_by("name", "ordinal").alias("path"))


def listed(entries: DataFrame) -> DataFrame:
    """Entries that a contents list shows."""
    return entries.where("coalesce(output_strategy, '') not in ('drop_explicit', 'nav_generated') and coalesce(role, '') <> 'nav'")


def by_file_name(entries: DataFrame) -> DataFrame:
    """(book_id, name, id): the first listed entry (book_id, pos, id, original_path, href, src_href) for each bare file name in those paths."""
    plain = lambda c: basename(unquote(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[^?#]*", 0)))
    keys = F.array(*[plain(F.col(c)) for c in ("original_path", "href", "src_href")])
    each = listed(entries).select("book_id", "pos", "id", F.posexplode(keys).alias("rank", "name")).where("name <> ''")
    return each.groupBy("book_id", "name").agg(F.min_by("id", F.struct("pos", "rank")).alias("id"))


def unlabelled(entries: DataFrame) -> DataFrame:
    """Failures of a strict contents list: listed entries (book_id, pos, id, idref, first_heading, output_strategy, role, label) shown in one language only."""
    shown = F.coalesce(blank_to_null(clean(F.coalesce("first_heading", "id"))), F.lit("Untitled"))
    bare = F.col("output_strategy").isin("translate", "source_only", "nav") & ((F.coalesce("label", F.lit("")) == "") | (F.col("label") == shown))
    key = F.coalesce(blank_to_null(F.col("idref")), F.col("id"))
    message = F.concat(F.lit("no label in the target language: "), shown, F.lit(" (override key "), key, F.lit(")"))
    return failures(listed(entries).where(bare), "nav_labels", message, F.col("id"), F.col("pos"))


def lost_images(images: DataFrame, names: DataFrame, audit: str = "images") -> DataFrame:
    """Failures for images (book_id, id, name) that pages show and the book's files or output (book_id, name; bare names) lack."""
    lost = images.where("name <> ''").distinct().join(names.select("book_id", "name").distinct(), ["book_id", "name"], "left_anti")
    return failures(lost, audit, F.concat(F.lit("image missing: "), F.col("name")), F.col("id"), F.lit(0))


def headings(nodes: DataFrame) -> DataFrame:
    """(doc, heading): of the first node of each of h1 to h4, the first in that order with 1 to 120 signs that isn't prose."""
    first = nodes.where(F.col("tag").isin("h1", "h2", "h3", "h4")).groupBy("doc", "tag").agg(F.min_by("text", "pre").alias("text"))
    tidy = first.withColumn("text", clean(F.coalesce("text", F.lit(""))))
    fit = tidy.where(F.length("text").between(1, 120) & ~is_prose(F.col("text")))
    return fit.groupBy("doc").agg(F.min_by("text", "tag").alias("heading"))


def text_sizes(nodes: DataFrame) -> DataFrame:
    """(doc, char_count): signs in all text of a page, pieces joined by one space."""
    top = nodes.where("parent < 0 and chars > 0").groupBy("doc").agg((F.sum("chars") + F.count("*") - 1).cast("int").alias("n"))
    return nodes.select("doc").distinct().join(top, "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("char_count"))


def backfilled(entries: DataFrame, legacy: bool = False) -> DataFrame:
    """Entries of an older list in full form: each column that is null or empty takes what it follows from.

    entries (book_id, pos, id, spine_id, src_idref, src_href, original_idref, original_path, href,
    linear, media_type, role, char_count, first_heading, output_strategy, translation_id,
    parent_id, reason), all strings but pos. In a ``legacy`` list, id named the translation.
    """
    text = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    either = lambda *cs: F.coalesce(*[blank_to_null(text(c)) for c in cs], F.lit(""))
    new_id = either("spine_id", "id") if legacy else text("id")
    e = entries.withColumn("__id", new_id)
    idref, href = either("src_idref", "__id"), either("src_href", "href")
    translation = either("translation_id", "id", "__id") if legacy else F.col("translation_id")
    return e.select(
        "book_id", "pos", F.col("__id").alias("id"), idref.alias("src_idref"), href.alias("src_href"), either("original_idref", "src_idref", "__id").alias("original_idref"), either("original_path", "src_href", "href").alias("original_path"), text("href").alias("href"),
        F.coalesce(blank_to_null(text("linear")), F.lit("yes")).alias("linear"), F.coalesce(blank_to_null(text("media_type")), F.lit("application/xhtml+xml")).alias("media_type"), F.coalesce(blank_to_null(text("role")), role(idref, href, text("first_heading"), F.lit(""))).alias("role"),
        int_or_zero(F.col("char_count")).alias("char_count"), either("first_heading", "__id").alias("first_heading"), F.coalesce(blank_to_null(text("output_strategy")), F.lit("translate")).alias("output_strategy"), translation.alias("translation_id"), "parent_id", "reason",
    )


def json_rows(files: DataFrame, field: str, schema: str) -> DataFrame:
    """(book_id, pos from 1, x, problem) from files (book_id, json) whose object has an array ``field`` of ``schema``; a file without one gives one row with the problem."""
    v = files.select("book_id", F.try_parse_json("json").alias("v"))
    v = v.withColumn("kind", F.schema_of_variant("v")).withColumn("held", F.try_variant_get("v", f"$.{field}", "array<variant>"))
    problem = F.when(F.col("v").isNull(), "not JSON").when(~F.col("kind").startswith("OBJECT"), "not an object").when(F.col("held").isNull(), f"no list {field}")
    bad = v.withColumn("problem", problem)
    good = bad.where("problem is null").select("book_id", F.posexplode("held").alias("pos", "e")).select("book_id", (F.col("pos") + 1).alias("pos"), F.from_json(F.to_json("e"), schema).alias("x"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(bad.where("problem is not null").select("book_id", F.lit(0).alias("pos"), F.from_json(F.lit(None).cast("string"), schema).alias("x"), "problem"))


def json_files(rows: DataFrame, field: str, columns: list[str]) -> DataFrame:
    """(book_id, json): one object a book, with the array ``field`` of its rows (book_id, pos, ...) in order. A book's list is short."""
    listed_ = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*columns).alias("x")))), lambda r: r["x"])
    made = rows.groupBy("book_id").agg(listed_.alias(field))
    return made.select("book_id", F.to_json(F.struct(field), {"ignoreNullFields": "false"}).alias("json"))


def assets(*sources: DataFrame) -> DataFrame:
    """(book_id, name, content): files of several sources, each name once; an earlier source goes before a later one."""
    every = None
    for i, s in enumerate(sources):
        one = s.select("book_id", "name", F.struct(F.lit(i).alias("rank"), "content").alias("c"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("book_id", "name").agg(F.min_by("c", "c.rank").alias("c")).select("book_id", "name", "c.content")


def standalone(pages: DataFrame, packages: DataFrame, others: DataFrame) -> DataFrame:
    """(book_id, o, name, content) of a whole archive for ``archive.zipped``: mimetype, container, package, pages in order, then other files by name.

    pages (book_id, pos, name, content), packages (book_id, opf_path, opf), others (book_id, name, content).
    """
    place = lambda part, n: F.struct(F.lit(part).alias("part"), n.cast("int").alias("ordinal"), F.col("name"))
    put = lambda df, part, n: df.select("book_id", place(part, n).alias("o"), "name", F.col("content").cast("binary").alias("content"))
    first = packages.select("book_id", F.lit("mimetype").alias("name"), F.lit("application/epub+zip").alias("content"))
    found = F.concat(F.lit('<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="'), F.col("opf_path"), F.lit('" media-type="application/oebps-package+xml"/></rootfiles></container>'))
    container = packages.select("book_id", F.lit("META-INF/container.xml").alias("name"), found.alias("content"))
    opf = packages.select("book_id", F.col("opf_path").alias("name"), F.col("opf").alias("content"))
    rest = others.join(pages.select("book_id", "name"), ["book_id", "name"], "left_anti")
    return put(first, 0, F.lit(0)).unionByName(put(container, 1, F.lit(0))).unionByName(put(opf, 2, F.lit(0))).unionByName(put(pages, 3, F.col("pos"))).unionByName(put(rest, 4, F.lit(0)))
