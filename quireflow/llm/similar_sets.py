"""Groups of texts whose word shingles have a Jaccard similarity of at least a fraction: lossless candidates, each verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.components import components
from quireflow.llm.simhash_dedup import links
from quireflow.llm.store import dropped, small, tidied, written
from quireflow.llm.textscan import chunks, gather, words
from quireflow.llm.word_windows import mixed, signed, window_hashes, word_hashes


#: Shingles in more texts than this part of so many come later in the order: a fixed number of texts, whatever the table has, or postings would grow with it.
SAMPLE, COMMON = 20_000, 0.0002
#: Those in ``STEP`` times as many come later still, ``LEVELS`` times over.
STEP, LEVELS = 8, 8
#: Shingles counted together; bits of a level's filter to each of its shingles, and the logarithm of all of them at most.
COUNTED, ROOM, FILTER = 1 << 20, 8, 28

#: Per level, (logarithm of its bits, the filter): a shingle's first bits are its place there.
Filters = list[tuple[int, np.ndarray]]


def _level(h: np.ndarray, often: Filters) -> np.ndarray:
    """In how many of the filters each hash is."""
    out = np.zeros(len(h), np.uint8)
    for width, bits in often:
        place = h >> np.uint64(64 - width)
        out += (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(np.uint8)
    return out


def _sets(data: np.ndarray, at: np.ndarray, shingle: int, often: Filters = []) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """Per row of a chunk: (name of its set, size, start in the last); the distinct shingle hashes of each row, ascending, those of more filters of ``often`` later."""
    out, starts, bounds = words(data, at, lower=True)
    n = np.diff(bounds)
    size = np.minimum(n, shingle)
    count = np.where(n > 0, n - size + 1, 0)
    left = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
    h = window_hashes(word_hashes(out, starts)[0], np.repeat(size, count), left)
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, _level(h, often), row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    sizes = np.bincount(row, minlength=len(n))
    ends = np.cumsum(sizes)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h + np.uint64(1)), out=total[1:])
    return mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)), sizes, ends - sizes, h


#: Bits of a set's outline: with fewer, the outlines of long texts are full and tell nothing.
OUTLINE = 8192


def _outlines(sizes: np.ndarray, h: np.ndarray) -> pa.Array:
    """Per set, ``OUTLINE`` bits as longs: bit h mod OUTLINE for each member h."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.zeros((len(sizes), OUTLINE), bool)
    bits[row, (h % np.uint64(OUTLINE)).astype(np.int64)] = True
    longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (OUTLINE // 64)), pa.array(longs))


def _prints(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per set, its SimHash: bit i is 1 if it is set in over half of the members' mixed hashes; 0 for an empty set."""
    prints, ends, h = np.zeros(len(sizes), np.uint64), np.cumsum(sizes), mixed(h)
    for i in np.flatnonzero(sizes):
        bits = np.unpackbits(h[ends[i] - sizes[i] : ends[i]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        prints[i] = np.packbits(2 * bits.sum(0, dtype=np.int64) > sizes[i], bitorder="little").view("<u8")[0]
    return prints


def _named(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, after, data, at in chunks(b.column(2)):
                names, sizes, _, h = _sets(data, at, shingle)
                rows = slice(first, after)
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(1)[rows], signed(names), pa.array(sizes.astype(np.int32)), signed(_prints(sizes, h)), _outlines(sizes, h)], ["k", "t", "s", "n", "f", "o"])

    return run


def _new(names: np.ndarray, seen: set[int]) -> np.ndarray:
    """The rows whose set was not seen in this task."""
    rows = []
    for i, s in enumerate(names.tolist()):
        if s not in seen:
            seen.add(s)
            rows.append(i)
    return np.array(rows, np.int64)


def _prefixes(shingle: int, num: int, den: int, often: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                names, sizes, starts, h = _sets(data, at, shingle, often)
                rows = _new(names, seen)
                rows = rows[sizes[rows] > 0]
                least = (den - num) * sizes[rows] // den + 1
                all_ = np.zeros(len(sizes), np.int64)
                all_[rows] = least
                rank = np.arange(int(least.sum())) - np.repeat(np.cumsum(least) - least, least)
                columns = [signed(gather(h, starts, all_, rows)), signed(np.repeat(names[rows], least)), pa.array(np.repeat(sizes[rows], least).astype(np.int32)), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "s", "n", "j"])

    return run


def _members(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                names, sizes, starts, h = _sets(data, at, shingle)
                rows = _new(names, seen)
                offsets = np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(names[rows]), pa.ListArray.from_arrays(pa.array(offsets), signed(gather(h, starts, sizes, rows)))], ["s", "m"])

    return run


def _nodes(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("u").alias("s")).union(pairs.select("v")).distinct(), "nodes")


def _verified(texts: DataFrame, named: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (u, v) whose whole sets are similar enough. Only texts of sets in a pair are read for their words."""
    nodes = _nodes(pairs)
    own = written(named.select("s", "t").join(small(nodes), "s", "left_semi").groupBy("s").agg(F.min("t").alias("t")).select("t"), "own")
    sets = texts.join(small(own), "t", "left_semi").select("v").mapInArrow(_members(shingle), "s long, m array<bigint>")
    sets = written(sets.join(small(nodes), "s", "left_semi").dropDuplicates(["s"]), "members")
    both = pairs.join(sets.select(F.col("s").alias("u"), F.col("m").alias("mu")), "u").join(sets.select(F.col("s").alias("v"), F.col("m").alias("mv")), "v")
    both = both.select("u", "v", (F.size("mu") + F.size("mv")).cast("long").alias("n"), F.size(F.array_intersect("mu", "mv")).cast("long").alias("c"))
    similar = written(both.where(F.col("c") * (num + den) >= F.col("n") * num).select("u", "v"), "similar")
    dropped(nodes, own, sets)
    return similar


def _plausible(pairs: DataFrame, named: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (u, v) that can be similar enough: a bit that one outline has and the other lacks is a member without a counterpart, so none of the others is lost."""
    nodes = _nodes(pairs)
    outlines = written(named.select("s", "n", "o").join(small(nodes), "s", "left_semi").dropDuplicates(["s"]), "outlines")
    u, v = (outlines.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("o").alias(f"o{x}")) for x in "uv")
    alone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda t, x: t + x)
    most = F.least(F.col("nu") - alone(F.col("ou"), F.col("ov")), F.col("nv") - alone(F.col("ov"), F.col("ou"))).cast("long")
    both = pairs.join(u, "u").join(v, "v")
    plausible = written(both.where(most * (num + den) >= (F.col("nu") + F.col("nv")).cast("long") * num).select("u", "v"), "plausible")
    dropped(nodes, outlines)
    return plausible


#: Partners of a set that are judged in the first round, and how much that grows by the round.
PARTNERS, GROWTH = 2, 8
#: So many pairs are judged at once, without rounds.
AT_ONCE = 10_000


def _linked(texts: DataFrame, named: DataFrame, pairs: DataFrame, near: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots): to the links ``near`` come similar ``pairs``, until each pair has been judged or its sets are joined.

    A round judges a few partners of each set that is not joined to them, the next one more, so
    that of a group of near copies about as many pairs are shipped as it has members, not their square.
    """
    most = PARTNERS
    while True:
        roots = written(components(near), "roots")
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        apart = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
        left = written(apart.select("u", "v").withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("v"))), "left")
        dropped(pairs)
        n = left.count()
        if not n:
            dropped(left)
            return near, roots
        if n <= AT_ONCE:
            most = n
        plausible = _plausible(left.where(F.col("i") <= most).select("u", "v"), named, num, den)
        old, near = near, near.union(_verified(texts, named, plausible, shingle, num, den))
        near = written(near, "near")
        pairs = written(left.where(F.col("i") > most).select("u", "v"), "pairs")
        dropped(old, roots, left, plausible)
        most *= GROWTH


def _simhash_pairs(named: DataFrame, bits: int) -> DataFrame:
    """Pairs of sets whose SimHashes differ in ``bits`` bits or fewer, through the positional index; sets of one SimHash are paired with the first of them."""
    sets = named.where("n > 0").select("f", "s").distinct()
    first = written(sets.groupBy("f").agg(F.min("s").alias("u")), "first")
    same = sets.join(first, "f").where("s <> u").select("u", F.col("s").alias("v"))
    u, v = first.select(F.col("f").alias("u"), F.col("u").alias("a")), first.select(F.col("f").alias("v"), F.col("u").alias("b"))
    near = links(first.select("f"), bits).join(u, "u").join(v, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    pairs = written(same.union(near), "pairs")
    dropped(first)
    return pairs


def _dealt(shingle: int, ranges: int):
    """The shingles of the texts in ``ranges`` ranges of hashes: (range, its shingles), one row a range and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                names, sizes, starts, h = _sets(data, at, shingle)
                h = np.sort(gather(h, starts, sizes, _new(names, seen)))
                r = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(r[cut]), pa.array([x.tobytes() for x in np.split(h, cut[1:])] if len(cut) else [], pa.binary())], ["r", "h"])

    return run


def _counted(limits: list[float]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["h"]]), return_counts=True)
        h, n = h[n > limits[0]], n[n > limits[0]]
        return pd.DataFrame({"h": h.view(np.int64), "l": np.searchsorted(limits, n).astype(np.int32)})

    return run


def _often(texts: DataFrame, named: DataFrame, shingle: int) -> Filters:
    """Filters of the shingles that many texts have, by whole counts. They only set an order, so that postings stay short; any filters give the same links."""
    total = int(named.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)
    limits = [COMMON * SAMPLE * STEP**i for i in range(LEVELS)]
    dealt = texts.select("v").mapInArrow(_dealt(shingle, 32 + total // COUNTED), "r long, h binary")
    heavy = written(dealt.groupBy("r").applyInPandas(_counted(limits), "h long, l int"), "heavy")
    by_level, out = {r.l: r["count"] for r in heavy.groupBy("l").count().collect()}, []
    for least in range(1, LEVELS + 1):
        n = sum(c for level, c in by_level.items() if level >= least)
        if not n:
            break
        width = min(FILTER, max(6, (ROOM * n - 1).bit_length()))
        place = F.shiftrightunsigned("h", 64 - width)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        found = heavy.where(F.col("l") >= least).groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        bits = np.zeros(1 << width - 6, np.uint64)
        bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
        out.append((width, bits))
    dropped(heavy)
    return out


def similar_roots(texts: DataFrame, named: DataFrame, shingle: int, num: int, den: int, bits: int) -> DataFrame:
    """(node, root) of the components of all pairs of similarity ``num / den`` or more between the distinct sets of ``texts`` (t, v), which ``named`` has as (t, s, n members, f, o).

    First come pairs whose SimHashes differ in ``bits`` bits or fewer. These are not all, so the
    rest come from prefixes: two such sets, each in one order of the hashes, share one of their first
    ``(1 - num / den) * n + 1`` shingles, and their first shared one stands early enough in
    both for the rest to suffice: no pair is lost. Members of a posting are first compared
    with its smallest set alone, then all that no verified link has joined so far. Of candidates,
    those whose outlines ``o`` leave too few members in common are not verified.
    """
    none = written(named.sparkSession.createDataFrame([], "u long, v long"), "near")
    near, roots = _linked(texts, named, _simhash_pairs(named, bits), none, shingle, num, den)
    dropped(roots)
    posted = texts.select("v").mapInArrow(_prefixes(shingle, num, den, _often(texts, named, shingle)), "h long, s long, n int, j int").repartition("h").dropDuplicates(["h", "s"])
    by = Window.partitionBy("h")
    shared = written(posted.withColumn("c", F.min(F.struct("n", "s", "j")).over(by)).withColumn("e", F.count("*").over(by)).where("e > 1").drop("e"), "shared")

    def fits(un, uj, vn, vj):
        enough = (num + den) * F.least(un - uj, vn - vj).cast("long") >= num * (un + vn).cast("long")
        return enough & (F.least(un, vn).cast("long") * den >= F.greatest(un, vn).cast("long") * num)

    stars = shared.where((F.col("s") != F.col("c.s")) & fits(F.col("c.n"), F.col("c.j"), F.col("n"), F.col("j")))
    stars = written(stars.select(F.least("s", "c.s").alias("u"), F.greatest("s", "c.s").alias("v")).distinct(), "stars")
    near, roots = _linked(texts, named, written(stars, "pairs"), near, shingle, num, den)
    rooted = shared.drop("c").join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    rooted = written(rooted, "rooted")
    u, v = (rooted.select("h", *[F.col(c).alias(f"{x}{c}") for c in ("s", "n", "j", "root")]) for x in "uv")
    rest = u.join(v, "h").where((F.col("us") < F.col("vs")) & (F.col("uroot") != F.col("vroot")) & fits(F.col("un"), F.col("uj"), F.col("vn"), F.col("vj")))
    rest = written(rest.select(F.col("us").alias("u"), F.col("vs").alias("v")).distinct().join(stars, ["u", "v"], "left_anti"), "rest")
    dropped(shared, stars, rooted, roots)
    near, roots = _linked(texts, named, rest, near, shingle, num, den)
    dropped(near)
    return roots


def similar_groups(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (k the id, t a hash of the text, root the group).

    Groups are the connected components of the texts under links between those whose sets of
    distinct word shingles have a Jaccard similarity of ``num / den`` or more. Words and
    shingles are those of ``simhash_dedup.fingerprints``; texts without words are alike, and
    null counts as empty. Shingles and sets are named by hashes of 64 bits. An empty table
    gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("v"))
    with tidied(docs.sparkSession):
        named = docs.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("v")).mapInArrow(_named(shingle), f"k {kind}, t long, s long, n int, f long, o array<bigint>")
        named = written(named, "sets")
        roots = similar_roots(texts, named, shingle, num, den, bits)
    return named.join(roots, named.s == roots.node, "left").select("k", "t", F.coalesce("root", "s").alias("root"))
