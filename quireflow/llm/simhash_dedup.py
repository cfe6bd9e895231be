"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.components import components
from quireflow.llm.store import written
from quireflow.llm.textscan import chunks, words
from quireflow.llm.word_windows import signed


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            prints = np.zeros(b.num_rows, np.uint64)
            for first, after, data, at in chunks(b.column(1)):
                out, starts, bounds = words(data, at, lower=True)
                text, n = out.tobytes(), np.diff(bounds)
                size = np.minimum(n, shingle)
                count = np.where(n > 0, n - size + 1, 0)
                left = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
                right = starts[left + np.repeat(size, count)] - 1
                h = np.fromiter((digest(text[s:e], 42) for s, e in zip(starts[left].tolist(), right.tolist(), strict=True)), np.uint64, len(left))
                ends = np.cumsum(count)
                for i in np.flatnonzero(count):
                    bits = np.unpackbits(h[ends[i] - count[i] : ends[i]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    prints[first + i] = np.packbits(2 * bits.sum(0, dtype=np.int64) > count[i], bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([b.column(0), signed(prints)], ["k", "f"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, f long): bit i of f is 1 if it is set in over half the XXH64 hashes (seed 42) of the word shingles.

    A-Z is lower-cased; words are runs outside ``[\\x20\\x09-\\x0D]``; repeats count; a text
    with fewer words than a shingle is one shingle; one without words has fingerprint 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(_fingerprints(shingle), f"k {kind}, f long")


def positions(x: Column) -> Column:
    """Bit i is set if the positional bytes i are equal, from the exclusive or of two fingerprints."""
    return reduce(lambda a, b: a + b, (F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1 << i).otherwise(0) for i in range(8)))


def shared_bytes(x: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    return F.bit_count(positions(x))


def links(distinct_prints: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v) for distinct fingerprints ``f`` that differ in 1 to ``bits`` bits (at most 4).

    ``bits`` differing bits touch ``bits`` bytes at most, so a pair shares at least
    ``8 - bits`` positional bytes. Each posting of the index holds the fingerprints that
    agree on one set of so many positions; the key fixes the rest, hence a posting holds
    ``2 ** (8 * bits)`` fingerprints at most, whatever the size of the table. The pairs of
    a posting are tallied, kept at the guaranteed minimum, and verified; a pair that shares
    more comes out of the posting of its first shared positions only.
    """
    least = 8 - bits
    sets = list(combinations(range(8), least))
    masks = [sum(0xFF << (8 * i) for i in s) for s in sets]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = distinct_prints.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("s", "b"))
    u, v = posted.select(F.col("f").alias("u"), "s", "b"), posted.select(F.col("f").alias("v"), "s", "b")
    x = F.col("u").bitwiseXOR(F.col("v"))
    shared = [[i for i in range(8) if e >> i & 1] for e in range(256)]
    home = F.get(F.array(*[F.lit(sets.index(tuple(e[:least])) if len(e) >= least else -1) for e in shared]), positions(x))
    # Spark takes the postings for no larger than the fingerprints, and would send them all through the driver.
    pairs = u.hint("merge").join(v.hint("merge"), (u.s == v.s) & (u.b == v.b) & (u.u < v.v) & (shared_bytes(x) >= least) & (F.bit_count(x) <= bits) & (home == u.s))
    return pairs.select("u", "v")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest id reachable over links of ``bits`` differing bits or
    fewer, itself included. Links run between distinct fingerprints, so copies need no
    pairs. Null text counts as empty; a null id keeps its row, and its component_id is the
    smallest id of the group if there is one; repeated rows each get a row; other columns
    are not read; an empty table gives an empty one.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "prints")
    each = written(prints.groupBy("f").agg(F.min("k").alias("least")), "each")
    roots = components(links(each, bits))
    rooted = each.join(roots, each.f == roots.node, "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("f", "component_id")
    return prints.hint("merge").join(named, "f").select(F.col("k").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
