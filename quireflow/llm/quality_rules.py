"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.store import written

SPACE = "[\\x20\\x09-\\x0D]"

#: Measure: (expression, outer quantile, how many times its distance from the median a cut-off is, least
#: distance, both sides?). Junk has symbols and stays out of the quantile as long as it is under 15 % of a
#: group; most texts have no repeats at all, so there only the 99th percentile says what is usual. The least
#: distance is what one word or line in fifty makes; it decides in groups where the quantile is the median.
MEASURES = {
    "symbols": ("n_symbols / n_words", 0.85, 3.0, 0.02, False),
    "repeats": ("n_repeat_words / n_words", 0.99, 1.5, 0.02, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.99, 1.5, 0.02, False),
    "word_length": ("word_chars / n_words", 0.75, 8.0, 0.02, True),
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), window: int = 5) -> DataFrame:
    """(k, t, g0, g1, ..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), counted over whole texts without a shuffle.

    The arrays are columns of their own, each used twice or more by the next step, so that
    Spark computes each once per row. Windows are compared by 64-bit hashes of word hashes.
    """
    v = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("k"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)], v.alias("v"))
    groups = [f"g{i}" for i in range(len(group_cols))]
    d = d.select(
        "k", *groups, "v", F.xxhash64("v").alias("t"),
        F.array_remove(F.split("v", f"{SPACE}+"), "").alias("w"),
        F.filter(F.split("v", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    d = d.select(
        "k", *groups, "t", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("v", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("v") - F.length(F.regexp_replace("v", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counts = ["k", *groups, "t", "n_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols"]
    at = F.when(F.size("h") >= window, F.sequence(F.lit(0), F.size("h") - window)).otherwise(F.array().cast("array<int>"))
    d = d.select(*counts, F.transform(at, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(window)])).alias("s"))
    pairs = F.sort_array(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.select(*counts, F.when(F.size(F.array_distinct("s")) < F.size("s"), pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("o"))
    # A window found twice stands beside its equal. F.get is null outside the array.
    same = F.filter("o", lambda x, i: (x["x"] == F.get("o", i - 1)["x"]) | (x["x"] == F.get("o", i + 1)["x"]))
    d = d.select(*counts, F.sort_array(F.transform(same, lambda x: x["i"])).alias("p"))
    gaps = F.transform("p", lambda x, i: F.least(F.lit(window), F.coalesce(F.get("p", i + 1) - x, F.lit(window))))
    return d.select(*counts, F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), min_words: int = 10, max_repeat_percent: int = 20, rules: dict[str, tuple] = MEASURES) -> DataFrame:
    """One row per input row: (k, t, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of them in
    windows found twice. For each group and measure, a KLL sketch over the documents that did
    not fail gives the median and an outer quantile; a document is kept if it didn't fail and
    each measure is no farther from its group's median than ``rules`` say: a multiple of the
    distance of that quantile, or the least distance there, if more. Sketches merge, so groups of any size cost a
    map-side combine; the filter is a join on the group. A null group value is a group of
    its own; a null or empty text has no words and fails; repeated rows each get a row; an
    empty table gives an empty one; other columns are not read.
    """
    groups = [f"g{i}" for i in range(len(group_cols))]
    m = measures(docs, id_col, text_col, group_cols)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    ratios = [F.when(~failed & (F.col("n_words") > 0) & (F.col("n_lines") > 0), F.expr(f"cast({e} as double)")).alias(name) for name, (e, *_) in rules.items()]
    m = written(m.select("*", *ratios), "measures")
    sketch = m.groupBy(*groups).agg(*[F.kll_sketch_agg_double(name).alias(name) for name in rules], *[F.count(name).alias(f"n_{name}") for name in rules])
    cuts = []
    for name, (_, outer, *_) in rules.items():
        q = F.kll_sketch_get_quantile_double(F.col(name), F.array(F.lit(1 - outer), F.lit(0.5), F.lit(outer)))
        cuts.append(F.when(F.col(f"n_{name}") > 0, q).alias(f"q_{name}"))  # an empty sketch has no quantiles
    sketch = sketch.select(*[F.col(g).alias(f"_{g}") for g in groups], *cuts)
    limits = []
    for name, (_, _, times, least, both) in rules.items():
        q = F.col(f"q_{name}")
        limits.append((q[1] + F.greatest(F.lit(least), times * (q[2] - q[1]))).alias(f"hi_{name}"))
        limits.append((q[1] - F.greatest(F.lit(least), times * (q[1] - q[0])) if both else F.lit(0.0)).alias(f"lo_{name}"))
    sketch = sketch.select(*[f"_{g}" for g in groups], *limits)
    on = None
    for g in groups:
        on = F.col(g).eqNullSafe(F.col(f"_{g}")) if on is None else on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    judged = m.join(sketch, on, "left")
    fine = ~failed
    for name in rules:
        fine = fine & F.coalesce(F.col(name).between(F.col(f"lo_{name}"), F.col(f"hi_{name}")), F.lit(True))
    return judged.select("k", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), fine.alias("kept"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with the same columns, joined on the id and a hash of the text."""
    good = verdicts(docs, id_col, text_col, **options).where("kept").select(F.col("k").alias("__k"), F.col("t").alias("__t")).distinct()
    own = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return own.join(good, own[id_col].eqNullSafe(good["__k"]) & (own["__h"] == good["__t"]), "left_semi").select(*docs.columns)
