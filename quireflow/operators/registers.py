"""Style registers, glossaries and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTER = "ordinal int, id string, register string, min_length_ratio double, rules array<string>"
GLOSSARY = "characters map<string,string>, places map<string,string>, terms map<string,string>, chapter_titles_zh map<string,string>, style_anchor struct<register:string,avoid:array<string>,prefer:array<string>>"


def matched(requests: DataFrame, registers: DataFrame) -> DataFrame:
    """Adds the id (register_id) and least ratio of the first register that fits ``requested``.

    One fits if either name holds the other, or a word of two signs or more of its name is
    in the request; case does not count. Registers are a configuration of a few rows: all of
    them count; they are broadcast as long as they are under 10,000, and joined as any
    other table beyond. A null request has no register and the usual ratio.
    """
    asked = requests.select("requested").where("requested is not null").distinct()
    want, have = F.lower("requested"), F.lower("register")
    words = F.filter(F.split(have, "[ /，,;；、]+"), lambda w: F.length(w) >= 2)
    fits = (F.trim("requested") != "") & (want.contains(have) | have.contains(want) | F.exists(words, lambda w: want.contains(w)))
    best = asked.join(F.broadcast(registers) if registers.count() < 10_000 else registers, fits).groupBy("requested").agg(F.min_by(F.struct("id", "min_length_ratio"), "ordinal").alias("r"))
    return requests.join(best, "requested", "left").select(*requests.columns, F.col("r.id").alias("register_id"), F.coalesce("r.min_length_ratio", F.lit(0.22)).alias("min_length_ratio"))


def resolved(requests: DataFrame, registers: DataFrame, fallback: list[str]) -> DataFrame:
    """Adds register_id and rules to requests (requested, override): the register an override names, in any case, else the one that ``matched`` finds.

    An override that names no register gives none. Rules are stripped and blank ones dropped;
    where none are left, ``fallback`` stands in.
    """
    named = F.coalesce(F.trim("override"), F.lit(""))
    by_id = registers.groupBy(F.lower(F.trim("id")).alias("__key")).agg(F.min_by("id", "ordinal").alias("__own"))
    both = matched(requests, registers).drop("min_length_ratio").withColumn("__key", F.lower(named)).join(by_id, "__key", "left")
    chosen = both.withColumn("register_id", F.when(F.coalesce("override", F.lit("")) != "", F.col("__own")).otherwise(F.col("register_id"))).drop("__key", "__own")
    tidy = F.filter(F.transform("rules", lambda r: F.trim(r)), lambda r: r != "")
    rules = registers.groupBy(F.col("id").alias("register_id")).agg(F.min_by(tidy, "ordinal").alias("rules"))
    none = F.array(*map(F.lit, fallback)).cast("array<string>")
    return chosen.join(rules, "register_id", "left").select(*requests.columns, "register_id", F.when(F.size("rules") > 0, F.col("rules")).otherwise(none).alias("rules"))


def glossary(text: Column) -> Column:
    """A glossary parsed from an answer, with or without a code fence; null if a part it needs is missing."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    g = F.from_json(bare, GLOSSARY)
    whole = g["characters"].isNotNull() & g["places"].isNotNull() & g["terms"].isNotNull() & g["style_anchor"]["register"].isNotNull() & g["style_anchor"]["avoid"].isNotNull() & g["style_anchor"]["prefer"].isNotNull()
    return F.when(whole, g)


def trimmed(m: Column) -> Column:
    """A map with keys and values stripped and blank keys dropped."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"] != ""))


def rule_lines(rules: Column, start: int = 5) -> Column:
    """The rules of a register, numbered after the general ones."""
    return F.array_join(F.transform(rules, lambda r, i: F.concat(F.lit("  "), (i + start).cast("string"), F.lit(". "), r)), "\n")


def prompt(label: Column, title: Column, language: Column, terms: Column, style: Column, carried: Column, text: Column, n_paragraphs: Column, rules: Column, custom: Column) -> Column:
    """The request for one chapter, as text: context, glossary, style, what came before, source, numbered requirements."""
    n = F.size(rules) + 5
    part = lambda head, body, none: F.concat(F.lit(f"{head}\n---\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit(none)), F.lit("\n---"))
    general = "Requirements\n  1. Give the translation only.\n  2. Leave one blank line between paragraphs and none inside them.\n  3. Use the glossary's forms.\n  4. Keep every paragraph, in order."
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Translate chapter "), label, F.lit(' of "'), title, F.lit('" into '), language, F.lit(".")),
        part("Glossary", terms, "{}"),
        part("Style sample", style, "(none yet)"),
        part("End of the previous chapter", carried, "(first chapter)"),
        part("Source", text, ""),
        F.lit(general),
        rule_lines(rules),
        F.concat(F.lit("  "), n.cast("string"), F.lit(". "), F.coalesce(custom, F.lit("No other wishes."))),
        F.concat(F.lit("  "), (n + 1).cast("string"), F.lit(". The translation must have "), n_paragraphs.cast("string"), F.lit(" paragraphs; count them.")),
    )
