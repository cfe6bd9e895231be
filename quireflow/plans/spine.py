"""From spine rows to classified, numbered entries: roles, strategies, part chain, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.text import blank_to_null, first_text

HEADINGS = dict(x.split("=") for x in "about_author=About the Author;acknowledgments=Acknowledgments;contents=Contents;copyright=Copyright;cover=Cover;dedication=Dedication;nav=Table of Contents;notes=Notes;promo=Promotional;title_page=Title Page".split(";"))
TRANSLATED = "about_author acknowledgments body dedication epilogue".split()
PART_CHILDREN = "about_author acknowledgments body epilogue notes".split()
CHAIN_BREAKS = "contents copyright cover dedication promo title_page".split()
SOURCE_ONLY = "contents copyright cover notes part_divider promo title_page".split()
OPENINGS = "Dedicated to |For my |For the |In memory of |To my |To the "


def role(idref: Column, href: Column, heading: Column, properties: Column) -> Column:
    """The first rule that holds decides. The path counts with its directories, as written."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(idref, F.lit("")), F.coalesce(href, F.lit(""))))
    head = F.coalesce(heading, F.lit(""))
    is_nav = F.array_contains(F.split(F.coalesce(properties, F.lit("")), r"\s+"), "nav") | F.lower(F.coalesce(href, F.lit(""))).endswith("nav.xhtml")
    notice = head.rlike(r"^Copyright (?:©|\(c\))") | F.lower(F.left(head, F.lit(40))).contains("all rights reserved")
    return (
        F.when(is_nav, "nav")
        .when(hay.contains("cover"), "cover")
        .when(hay.contains("title") & ~hay.contains("chapter"), "title_page")
        .when(hay.contains("copyright"), "copyright")
        .when(hay.contains("dedication"), "dedication")
        .when(notice, "copyright")
        .when(head.rlike(f"^(?:{OPENINGS})"), "dedication")
        .when(hay.rlike("contents|toc"), "contents")
        .when(head.rlike(r"(?i)^\s*part\s*(?:[ivxlcdm]+|\d+)\b"), "part_divider")
        .when(hay.contains("epilogue"), "epilogue")
        .when(hay.contains("acknowledg"), "acknowledgments")
        .when(hay.contains("note"), "notes")
        .when(hay.contains("author"), "about_author")
        .when(hay.rlike("next-reads|promo"), "promo")
        .otherwise("body")
    )


def strategy(role: Column, chars: Column) -> Column:
    return (
        F.when((role == "body") & (chars == 0), "source_only")
        .when(role.isin("copyright", "dedication", "part_divider") & (chars >= 300), "translate")
        .when(role.isin(TRANSLATED), "translate")
        .when(role == "nav", "nav_generated")
        .when(role.isin(SOURCE_ONLY), "source_only")
        .otherwise("translate")
    )


def classified(spine: DataFrame) -> DataFrame:
    """(book_id, pos, idref, href, properties, heading, text or char_count) with role, strategy, ids, parent and heading to show.

    One window per book, over its spine in order: the latest part divider until a role that
    breaks the chain; running numbers of the rows to translate. A book's spine is short;
    books spread over tasks.
    """
    chars = F.coalesce("char_count", F.length("text")) if "char_count" in spine.columns else F.length("text")
    named = spine.withColumn("char_count", F.coalesce(chars, F.lit(0)))
    named = named.withColumn("role", role(F.col("idref"), F.col("href"), F.coalesce(blank_to_null(F.col("heading")), first_text(F.col("text")), F.lit("")), F.col("properties")))
    named = named.withColumn("output_strategy", strategy(F.col("role"), F.col("char_count"))).withColumn("id", F.format_string("item_%03d", F.col("pos")))
    book = Window.partitionBy("book_id").orderBy("pos")
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("role") == "part_divider", F.col("id")).when(F.col("role").isin(CHAIN_BREAKS), F.lit(""))
    chapter = F.sum(F.when(F.col("output_strategy") == "translate", 1).otherwise(0)).over(book)
    labels = F.create_map(*[F.lit(v) for kv in HEADINGS.items() for v in kv])
    return (
        named.withColumn("parent_id", F.when(F.col("role").isin(PART_CHILDREN), blank_to_null(F.last(mark, ignorenulls=True).over(before))))
        .withColumn("translation_id", F.when(F.col("output_strategy") == "translate", F.format_string("ch_%02d", chapter)))
        .withColumn("first_heading", F.coalesce(blank_to_null(F.col("heading")), labels[F.col("role")], first_text(F.col("text")), F.lit("(untitled)")))
    )
