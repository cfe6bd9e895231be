"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.store import written
from quireflow.llm.textscan import chunks, words
from quireflow.llm.word_windows import signed, window_hashes, word_hashes

#: Period: residues such that every difference modulo the period is a difference of two of them.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def cover_for(size: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of over a third of the window."""
    period = max(p for p in COVERS if p == 1 or p <= 0.65 * size)
    return period, COVERS[period]


def _rows(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row of each flat word position."""
    return np.searchsorted(bounds, flat, "right") - 1


def _anchors(size: int):
    period, residues = cover_for(size)
    length = size - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(residues)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, after, data, at in chunks(b.column(1)):
                out, starts, bounds = words(data, at)
                n = np.diff(bounds)
                [h] = word_hashes(out, starts)
                flat = np.arange(len(h))
                place = flat - np.repeat(bounds[:-1], n)
                keep = chosen[place % period] & (place + length <= np.repeat(n, n)) & (np.repeat(n, n) >= size)
                flat, place = flat[keep], place[keep]
                k = b.column(0).slice(first, after - first).take(pa.array(_rows(flat, bounds)))
                yield pa.RecordBatch.from_arrays([k, pa.array(place.astype(np.int64)), signed(window_hashes(h, length, flat))], ["k", "x", "h"])

    return run


def _windows(size: int):
    period, _ = cover_for(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column(3)
            for first, after, data, at in chunks(b.column(2)):
                out, starts, bounds = words(data, at)
                one, two = word_hashes(out, starts, both=True)
                mark = np.zeros(len(one) + 1, np.int64)
                for i in range(first, after):
                    lo, hi = bounds[i - first], bounds[i - first + 1] - size
                    if hi >= lo:
                        x = near[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                        x = x[x <= bounds[i - first + 1] - lo]
                        np.add.at(mark, lo + np.maximum(x - period + 1, 0), 1)
                        np.add.at(mark, np.minimum(lo + x, hi) + 1, -1)
                flat = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                row = _rows(flat, bounds)
                ok = flat + size <= bounds[row + 1]
                flat, row = flat[ok], row[ok]
                take = pa.array(row)
                k, t = (b.column(i).slice(first, after - first).take(take) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([k, t, pa.array((flat - bounds[row]).astype(np.int64)), signed(window_hashes(one, size, flat)), signed(window_hashes(two, size, flat))], ["k", "t", "p", "h", "g"])

    return run


def _kept(size: int):
    """From (k, t, text, starts of removed windows or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, total, text = [], [], []
            for first, after, data, at in chunks(b.column(2)):
                out, starts, bounds = words(data, at)
                for i in range(first, after):
                    lo, hi = bounds[i - first], bounds[i - first + 1]
                    total.append(int(hi - lo))
                    removed = b.column(3)[i].values
                    if removed is None or not len(removed):
                        gone.append(0)
                        text.append(out[starts[lo] : max(starts[lo], starts[hi] - 1)].tobytes())
                        continue
                    p = removed.to_numpy(zero_copy_only=False)
                    mark = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(mark, p, 1)
                    np.add.at(mark, p + size, -1)
                    cut = np.cumsum(mark)[:-1] > 0
                    gone.append(int(cut.sum()))
                    keep = np.repeat(~cut, np.diff(starts[lo : hi + 1]))
                    text.append(out[starts[lo] : starts[hi]][keep].tobytes()[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["k", "t", "n_words", "n_removed", "kept"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha = [], []
        for first, after, data, at in chunks(b.column(2)):
            out, starts, bounds = words(data, at)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                n.append(int(hi - lo))
                sha.append(hashlib.sha256(out[starts[lo] : max(starts[lo], starts[hi] - 1)]).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["k", "t", "n_words", "all_sha256"])


def repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, n_words, n_removed, kept) of the documents that lose words; t is a hash of the text.

    1. Hash the anchors, windows of ``size - period + 1`` words at positions whose residue
       is in the cover. If two windows of ``size`` words are equal, then for some shift
       below the period both shifted positions are cover positions: they share an anchor.
    2. Anchors of two documents or more: grouped with map-side combine, then joined back,
       so that a hot anchor is split by Spark's skew handling, never gathered.
    3. Around these anchors only, hash every full window (128 bits) and take the smallest
       id per window, again with map-side combine and a join back.
    No pair of documents is ever formed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("v")).where(F.col("k").isNotNull())
    anchors = own.select("k", "v").mapInArrow(_anchors(size), f"k {kind}, x long, h long")
    shared = written(anchors.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h"), "anchors")
    near = written(anchors.join(shared, "h").groupBy("k").agg(F.collect_list("x").alias("x")), "near")
    held = written(own.join(near, "k"), "held")
    windows = held.mapInArrow(_windows(size), f"k {kind}, t long, p long, h long, g long")
    first = written(windows.groupBy("h", "g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").drop("hi"), "windows")
    removed = windows.join(first, ["h", "g"]).where("k > lo").groupBy("k", "t").agg(F.collect_list("p").alias("p"))
    both = held.dropDuplicates(["k", "t"]).join(removed, ["k", "t"]).select("k", "t", "v", "p")
    return both.mapInArrow(_kept(size), f"k {kind}, t long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts in a document with a smaller id.

    Returns per input row (id, n_words, n_removed, kept_sha256): of the kept words, joined
    by one space, UTF-8. Windows are judged on the input. Words are runs outside
    ``[\\x20\\x09-\\x0D]``, unchanged. Null or empty text: no words. A null id is neither
    smaller nor larger, so its row loses nothing and takes nothing. Rows of one id don't
    take words from each other; each repeated row gets its row. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("v")).mapInArrow(_digest, f"k {kind}, t long, n_words long, all_sha256 string")
    lost = repeats(docs, size, id_col, text_col).select("k", "t", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return base.join(lost, ["k", "t"], "left").select(
        F.col("k").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated passages cut out of ``text_col``; texts that lose nothing stay as they are."""
    lost = repeats(docs, size, id_col, text_col).select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("kept").alias("_kept"))
    own = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(lost, (own[id_col] == lost["_k"]) & (own["_h"] == lost["_t"]), "left")
    return joined.select(*[(F.coalesce("_kept", F.col(c)).alias(c) if c == text_col else F.col(c)) for c in docs.columns])
