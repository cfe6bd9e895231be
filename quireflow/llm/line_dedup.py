"""Removal of boilerplate lines by the number of distinct sites they spread over."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.store import written

SPACES = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, site_col: str, id_col: str, text_col: str) -> DataFrame:
    """(k, t, site, pos, h, g) of each line with a word; t is a hash of the text, h and g of the trimmed line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.btrim("line", F.lit(SPACES))
    each = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("t"), F.xxhash64(F.col(site_col)).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return each.select("k", "t", "site", "pos", line.alias("line")).where("line <> ''").select("k", "t", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))


def boilerplate(docs: DataFrame, min_sites: int = 10, precision: int = 12, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, owner): lines found on ``min_sites`` distinct sites or more, with the smallest id that has them.

    One HyperLogLog sketch of sites per line, merged map-side and after the shuffle, so a
    line's occurrences never meet in one task. A line whose estimate is within five
    standard errors of the threshold is counted exactly.
    """
    lines = _lines(docs, site_col, id_col, text_col)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("sites"), F.min("k").alias("owner"))
    slack = max(1.0, 5 * 1.04 / sqrt(2**precision) * min_sites)
    spread = written(spread.where(F.col("sites") >= min_sites - slack), "spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= slack).select("h", "g")
    exact = lines.join(near, ["h", "g"]).groupBy("h", "g", "site").agg(F.lit(1).alias("one")).groupBy("h", "g").count().where(F.col("count") >= min_sites).select("h", "g")
    sure = spread.where(F.col("sites") > min_sites + slack).select("h", "g")
    return written(spread.join(sure.union(exact), ["h", "g"]).select("h", "g", "owner"), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 10, precision: int = 12, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text_col``; adds n_lines (with a word) and n_removed, both long.

    A line, trimmed of ``[\\x20\\x09-\\x0D]``, that occurs on ``min_sites`` distinct sites or more
    is removed from every document but the one with the smallest id among those that have
    it, so its text isn't lost. Lines without a word stay. Null or empty text: no
    lines. A null site counts as one site; a null id never keeps a line. Repeated rows are
    treated alike and stay repeated. An empty table gives an empty one. Columns of ``docs``
    named n_lines or n_removed are replaced; other names don't matter.
    """
    common = boilerplate(docs, min_sites, precision, site_col, id_col, text_col)
    gone = _lines(docs, site_col, id_col, text_col).join(common, ["h", "g"]).where("k is null or owner is null or k > owner").groupBy("k", "t").agg(F.collect_set("pos").alias("p"))
    gone = gone.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("p").alias("__p"))
    own = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = own.join(gone, own[id_col].eqNullSafe(gone["__k"]) & (own["__h"] == gone["__t"]), "left")
    both = both.select("*", F.split(F.col(text_col), "\n").alias("__l"))
    lines = F.col("__l")
    # Every line with its place, less those at the places to go: one hash set, however many lines there are.
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.array_except(at, F.col("__p")), lambda i: F.get("__l", i)), "\n")
    columns = [F.when(F.col("__p").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    worded = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))), F.lit(0))
    return both.select(*columns, F.when(F.col(text_col).isNull(), 0).otherwise(worded).cast("long").alias("n_lines"), F.greatest(F.lit(0), F.coalesce(F.size("__p"), F.lit(0))).cast("long").alias("n_removed"))
