"""Audits: each gives rows (book_id, audit, seq, path, message); none raises on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.text import has_han, is_english, resolve_href

#: Traces of summaries, labels and glued numbers that a translation must not hold.
BANNED = "(untitled)|PARTI|PARTII|繁中：|本段介紹|本段保留|本段提供|版權頁說明|延伸閱讀：本段|關於作者：本段|致謝：作者在此感謝|1CREATING|2ALIGNING|3FOUR".split("|") + [f"{n}AI AS" for n in range(4, 10)]
REFUSAL = r"(?i)\b(?:As an AI|I'm sorry|I (?:am unable|can't|cannot|won't))\b"
AUDITS = ["structural", "bilingual_coverage", "translation_quality", "href_resolve"]


def failures(df: DataFrame, audit: str, message: Column, path: Column | str = "path", seq: Column | str = "seq") -> DataFrame:
    return df.select("book_id", F.lit(audit).alias("audit"), (F.col(seq) if isinstance(seq, str) else seq).cast("long").alias("seq"), (F.col(path) if isinstance(path, str) else path).alias("path"), message.alias("message"))


def pair_failures(pairs: DataFrame, min_ratio: float | Column = 0.22, exceptions: DataFrame | None = None) -> DataFrame:
    """Quality of (book_id, path, seq, tag, text, target): a target must be there, be long enough, and hold nothing banned.

    Headings and texts under 50 signs have no least length. ``min_ratio`` may be a column of
    ``pairs``, such as the ratio of the book's register. One row for each banned text.
    """
    least = min_ratio if isinstance(min_ratio, Column) else F.lit(float(min_ratio))
    missing = pairs.where("text <> '' and target is null")
    if exceptions is not None:
        missing = missing.join(exceptions.select("text"), "text", "left_anti")
    lost = failures(missing, "translation_quality", F.concat(F.lit("no target: "), F.left("text", F.lit(120))))
    long_enough = F.length("target") >= least * F.length("text")
    short = pairs.where("text <> '' and target is not null").where(~F.col("tag").rlike("^h[1-6]$") & (F.length("text") >= 50) & ~long_enough)
    short = failures(short, "translation_quality", F.concat(F.lit("too short: "), F.left("text", F.lit(120))))
    found = F.filter(F.array(*map(F.lit, BANNED)), lambda x: F.col("target").contains(x))
    banned = pairs.where("target is not null").withColumn("b", F.explode(found))
    return lost.unionByName(short).unionByName(failures(banned, "translation_quality", F.concat(F.lit("banned: "), F.col("b"))))


def coverage_failures(pairs: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """English texts of (book_id, path, seq, text, target) whose target has no Han."""
    open_ = pairs.where(is_english(F.col("text")) & ~F.coalesce(has_han(F.col("target")), F.lit(False)))
    if exceptions is not None:
        open_ = open_.join(exceptions.select("text"), "text", "left_anti")
    return failures(open_, "bilingual_coverage", F.left("text", F.lit(120)))


def href_failures(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (book_id, path, seq, href) that resolve to no name of their archive (book_id, name)."""
    found = links.withColumn("name", resolve_href(F.col("path"), F.col("href"))).where("name is not null")
    lost = found.join(names.select("book_id", "name").distinct(), ["book_id", "name"], "left_anti")
    return failures(lost, "href_resolve", F.concat(F.col("path"), F.lit(": "), F.col("href"), F.lit(" -> "), F.col("name")))


def entry_match(source: DataFrame, entries: DataFrame) -> DataFrame:
    """Source spine rows (book_id, src_pos, src_idref, src_href) with the first entry (book_id, pos, idref, href) that matches.

    A match has the same id, the same path, or a path that ends with the other's; an empty
    path ends any. Within a book only, so the join is keyed by the book.
    """
    same = (F.col("src_idref") == F.col("idref")) | F.col("src_href").endswith(F.col("href")) | F.col("href").endswith(F.col("src_href"))
    e = entries.select(F.col("book_id").alias("b"), "pos", "idref", "href")
    hit = source.join(e, (source.book_id == e.b) & same).groupBy("book_id", "src_pos").agg(F.min("pos").alias("pos"))
    return source.join(hit, ["book_id", "src_pos"], "left")


def structural_failures(source: DataFrame, entries: DataFrame, output: DataFrame, translated: DataFrame, chapters: DataFrame | None = None, images: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """The structural checks of each book, one row for each fault.

    source (book_id, src_pos, src_idref, src_href); entries (book_id, pos, id, idref, href, role,
    output_strategy, reason, and original_idref if there is one); output (book_id, idref, href)
    of the written spine; translated (book_id, id) with a translation; chapters as in
    ``state.fold``; images (book_id, id, name) on source-only pages with names (book_id, name)
    of the output's images. A book of ``source`` without entries fails. A cover counts as
    kept if its entry is written or anything written is called cover; so does a body chapter,
    or any page that isn't a contents list. Without the paths of the output, entries alone count.
    """
    from quireflow.operators.books import lost_images
    from quireflow.operators.state import invalid

    out = output.select("book_id", F.col("idref").alias("o")).distinct()
    own = [c for c in ("id", "idref", "original_idref", "src_idref") if c in entries.columns]
    ids = entries.select("book_id", "pos", F.explode(F.array_distinct(F.array(*own))).alias("o"))
    nav = entries.where("output_strategy = 'nav_generated'").select("book_id", "pos", F.lit("nav").alias("o"))
    there = ids.union(nav).where("o <> ''").join(out, ["book_id", "o"], "left_semi").select("book_id", "pos").distinct().withColumn("written", F.lit(True))
    dropped = F.coalesce((F.col("output_strategy") == "drop_explicit") & (F.trim(F.coalesce("reason", F.lit(""))) != ""), F.lit(False))
    matched = entry_match(source, entries).join(entries.select("book_id", "pos", "output_strategy", "reason"), ["book_id", "pos"], "left").join(there, ["book_id", "pos"], "left").withColumn("dropped", dropped)
    matched = matched.withColumn("path", F.col("src_href")).withColumn("seq", F.col("src_pos"))
    written = entries.join(there, ["book_id", "pos"]).groupBy("book_id").agg(F.count_if(F.col("role") == "cover").alias("covered"), F.count_if(F.col("role").isin("body", "epilogue")).alias("bodies"))
    href = F.col("href") if "href" in output.columns else F.lit(None).cast("string")
    called = F.when(href.isNotNull(), F.lower(F.concat_ws(" ", "idref", href)))
    made = output.groupBy("book_id").agg(F.count("*").alias("n_out"), F.count_if(called.contains("cover")).alias("like_cover"), F.count_if((F.col("idref") != "nav") & ~F.lower(href).contains("nav")).alias("like_body"))
    counts = matched.groupBy("book_id").agg(F.count_if(~F.col("dropped")).alias("expected"), F.count_if(F.col("src_href").rlike("(?i)cover")).alias("covers"))
    counts = counts.join(written, "book_id", "left").join(made, "book_id", "left").withColumn("path", F.lit(""))
    counts = counts.na.fill(0, ["covered", "bodies", "n_out", "like_cover", "like_body"])
    few = failures(counts.where("n_out < expected"), "structural", F.format_string("spine has %d of %d", "n_out", "expected"), seq=F.lit(-3))
    cover = failures(counts.where("covers > 0 and covered = 0 and like_cover = 0"), "structural", F.lit("cover lost"), seq=F.lit(-2))
    body = failures(counts.where("bodies = 0 and like_body = 0"), "structural", F.lit("no body chapter"), seq=F.lit(-1))
    lost = failures(matched.where("not dropped and written is null"), "structural", F.concat(F.lit("not in the output: "), F.col("src_idref")))
    bare = entries.where("output_strategy = 'translate'").join(translated.select("book_id", "id"), ["book_id", "id"], "left_anti").withColumn("path", F.col("href")).withColumn("seq", F.col("pos"))
    out_rows = [few, lost, failures(bare, "structural", F.concat(F.lit("no translation: "), F.col("id"))), cover, body]
    if chapters is not None:
        out_rows.append(failures(invalid(chapters).withColumn("path", F.col("chapter_id")), "structural", F.concat(F.lit("state: "), F.col("problem")), seq=F.lit(0)))
    if images is not None:
        out_rows.append(lost_images(images, names, "structural"))
    return reduce(DataFrame.unionByName, out_rows)


def preflight(entries: DataFrame, sources: DataFrame, translated: DataFrame) -> DataFrame:
    """Why a book can't be assembled: unknown strategy, drop without a reason, no source page, no translation."""
    from quireflow.operators.state import STRATEGIES

    e = entries.join(sources.select("book_id", "id").distinct().withColumn("has_page", F.lit(True)), ["book_id", "id"], "left").join(translated.select("book_id", "id").distinct().withColumn("has_text", F.lit(True)), ["book_id", "id"], "left")
    s = F.col("output_strategy")
    unknown = ~F.coalesce(s.isin(STRATEGIES), F.lit(False))
    problems = F.filter(F.array(F.when(unknown, "unknown strategy"), F.when((s == "drop_explicit") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "drop without a reason"), F.when(s.isin("translate", "source_only") & F.col("has_page").isNull(), "no source page"), F.when((s == "translate") & F.col("has_text").isNull(), "no translation")), lambda x: x.isNotNull())
    return failures(e.withColumn("m", F.explode(problems)).withColumn("path", F.col("id")).withColumn("seq", F.col("pos")), "preflight", F.col("m"))


def translation_warnings(n_source: Column, target: Column, n_target: Column, min_ratio: float = 0.5) -> Column:
    """Array of what looks wrong: empty, too few paragraphs, a refusal."""
    few = (n_source > 0) & (n_target < F.greatest(F.lit(1), F.floor(n_source * F.lit(float(min_ratio))).cast("int")))
    body = F.trim(F.coalesce(target, F.lit("")))
    found = F.array(F.when(few, "paragraphs"), F.when(F.left(body, F.lit(500)).rlike(REFUSAL), "refusal"))
    return F.when(body == "", F.array(F.lit("empty"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def suite(books: DataFrame, audits: dict[str, DataFrame]) -> DataFrame:
    """(book_id, audit, status, n_failures, messages): every audit of every book, also those without a failure.

    ``audits`` has the failures of each audit that ran. One that did not run is "not run", and a
    book doesn't pass without it. Messages are in order of place, then text.
    """
    unknown = set(audits) - set(AUDITS)
    if unknown:
        raise ValueError(f"unknown audits: {sorted(unknown)}")
    ran = F.array(*[F.struct(F.lit(a).alias("audit"), F.lit(a in audits).alias("ran")) for a in AUDITS])
    every = books.select("book_id").distinct().withColumn("a", F.explode(ran)).select("book_id", "a.audit", "a.ran")
    if not audits:
        return every.select("book_id", "audit", F.lit("not run").alias("status"), F.lit(0).cast("long").alias("n_failures"), F.array().cast("array<string>").alias("messages"))
    named = [df.withColumn("audit", F.lit(a)) for a, df in audits.items()]
    rows = reduce(DataFrame.unionByName, named).groupBy("book_id", "audit").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("messages"))
    done = every.join(rows, ["book_id", "audit"], "left")
    status = F.when(~F.col("ran"), "not run").when(F.col("n") > 0, "fail").otherwise("pass")
    return done.select("book_id", "audit", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_failures"), F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))


def all_passed(results: DataFrame) -> DataFrame:
    """(book_id, passed, n_failed): a book passes if each audit ran and passed."""
    return results.groupBy("book_id").agg(F.bool_and(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("n_failed"))


def summary(results: DataFrame) -> DataFrame:
    """(book_id, summary): counts, then a line for each audit and one for each message below it, in the order of ``AUDITS``."""
    order = F.array_position(F.array(*map(F.lit, AUDITS)), F.col("audit"))
    lines = F.concat(F.array(F.concat_ws(" ", F.upper("status"), "audit")), F.transform("messages", lambda m: F.concat(F.lit("  "), m)))
    each = results.select("book_id", "status", F.struct(order.alias("o"), lines.alias("l")).alias("x"))
    made = each.groupBy("book_id").agg(F.count_if(F.col("status") == "pass").alias("p"), F.count_if(F.col("status") != "pass").alias("f"), F.sort_array(F.collect_list("x")).alias("x"))
    head = F.concat(F.col("p").cast("string"), F.lit(" passed, "), F.col("f").cast("string"), F.lit(" not"))
    return made.select("book_id", F.array_join(F.concat(F.array(head), F.flatten(F.transform("x", lambda x: x["l"]))), "\n").alias("summary"))
