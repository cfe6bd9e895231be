"""Scalar functions on text and paths, all native columns.

Lengths are code points. White space is Unicode's, with U+001C to U+001F, written out so
that it means the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c-\u001f]"
#: The same signs, for trims: a pattern that ends in $ would look at each inner run of white space again for each of its signs.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
HAN = r"[\u4e00-\u9fff]"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def clean(x: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"{WHITE}+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/*[^/]*$", 1)


def normpath(path: Column) -> Column:
    """POSIX normalisation: one leading slash, or exactly two, stay; ``.`` for nothing."""
    lead = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    none = F.array().cast("array<string>")

    def step(seen: Column, part: Column) -> Column:
        up = part == ".."
        stuck = (F.size(seen) == 0) | (F.get(seen, F.size(seen) - 1) == "..")
        return (
            F.when(part.isin("", "."), seen)
            .when(up & (F.size(seen) == 0) & (lead != ""), seen)
            .when(up & stuck, F.concat(seen, F.array(F.lit(".."))))
            .when(up, F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
            .otherwise(F.concat(seen, F.array(part)))
        )

    joined = F.concat(lead, F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def join_path(base: Column, target: Column) -> Column:
    return F.when(target.startswith("/") | (base == ""), target).otherwise(F.concat_ws("/", base, target))


def relative_path(target: Column, start: Column) -> Column:
    """``target`` as seen from the directory ``start``; both normalised and relative."""
    parts = lambda x: F.filter(F.split(x, "/"), lambda p: ~p.isin("", "."))
    a, b = parts(start), parts(target)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    rest = F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0)))
    return F.coalesce(blank_to_null(F.array_join(F.concat(up, rest), "/")), F.lit("."))


def local_path(path: Column, opf_path: Column) -> Column:
    """``path`` without the package's directory."""
    root = F.concat(dirname(opf_path), F.lit("/"))
    return F.when((root != "/") & path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def original_path(original: Column, src_href: Column, href: Column, item_id: Column, opf_path: Column) -> Column:
    """The archive path of an entry: as recorded, else as linked, else derived from its local file."""
    name = F.when(href.startswith("chapters/"), F.concat(item_id, F.lit(".xhtml"))).otherwise(href)
    return F.coalesce(blank_to_null(original), blank_to_null(src_href), normpath(join_path(dirname(F.coalesce(opf_path, F.lit(""))), name)))


def unquote(x: Column) -> Column:
    """Percent decoding that leaves ``+`` alone."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def resolve_href(source: Column, href: Column) -> Column:
    """The archive path an href points at; null if it leads out of the archive or stays on the page."""
    target = F.substring_index(href, "#", 1)
    outside = href.rlike(r"(?i)^(?:https?|mailto|tel|urn|doi):")
    return F.when(~outside & (F.coalesce(target, F.lit("")) != ""), normpath(join_path(dirname(source), unquote(target))))


def is_prose(heading: Column) -> Column:
    """More than one sentence end: body text set as a heading."""
    return F.size(F.regexp_extract_all(heading, F.lit("[.!?。？！]"), 0)) > 1


def first_text(text: Column) -> Column:
    return blank_to_null(F.left(clean(text), F.lit(80)))


def is_identifier(x: Column) -> Column:
    return x.rlike(r"^[._A-Za-z0-9\-]{6,}$") & x.rlike("[_0-9]")


def has_han(x: Column) -> Column:
    return x.rlike(HAN)


def ensure_han(translated: Column, source: Column) -> Column:
    return F.when(has_han(translated) | is_identifier(source), translated).otherwise(F.concat(F.lit("譯文："), translated))


def is_english(x: Column) -> Column:
    """At least 50 signs, no Han, and enough ASCII letters."""
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    return (F.length(x) >= 50) & ~has_han(x) & (letters >= F.greatest(F.lit(20), F.floor(F.length(x) * F.lit(0.35)).cast("int")))


def short_hash(x: Column) -> Column:
    return F.left(F.sha2(x.cast("binary"), 256), F.lit(12))


def carryover(x: Column) -> Column:
    return F.right(x, F.lit(200))


def int_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


def safe_uid(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]+", "_")


def target_classes(source_classes: Column, unpaired: Column) -> Column:
    """Classes of a translated paragraph: its own two, what it inherits, and a mark if unpaired."""
    inherited = F.array_remove(F.coalesce(source_classes, F.array().cast("array<string>")), "src")
    return F.array_distinct(F.concat(F.array(F.lit("tgt"), F.lit("tgt-zh")), inherited, F.when(unpaired, F.array(F.lit("unpaired"))).otherwise(F.array().cast("array<string>"))))


LANGUAGES = {"en": "English", "ja": "日本語", "ko": "한국어", "zh-cn": "簡體中文（中國大陸）", "zh-tw": "台灣繁體中文"}


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    return F.coalesce(names[F.lower(code)], code)
