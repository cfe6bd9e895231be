"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.store import written
from quireflow.llm.textscan import Memo, chunks, distinct, gather, words

#: Parts into which the items of one length are dealt, so that no length is a hot key.
PARTS = 512


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is as large as fits into ``room``.

    Subset-sum dynamic programming on a bitset: bit s is set if some multiset sums to s.
    Longer lengths go first; copies of a length enter in powers of two.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left > 0 and not bits >> room & 1:
            n = min(unit, left)
            steps.append((length, n, bits))
            bits |= bits << (length * n) & mask
            left, unit = left - n, 2 * unit
    at, used = bits.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            used[length] = used.get(length, 0) + n
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how often, copies by length). ``counts`` has at most ``capacity`` entries, however many items there are.

    Each round takes the longest length left, fills the rest of the bin as full as it
    gets, and removes that combination as often as the counts allow; so a round uses up,
    to less than one bin's worth, some length, and the rounds are bounded by the capacity
    and not by the number of items.
    """
    left, made = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        rest = {n: c - (n == top) for n, c in left.items() if n <= capacity - top and c > (n == top)}
        used = fullest(rest, capacity - top)
        used[top] = used.get(top, 0) + 1
        often = min(left[n] // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= often * m
            if not left[n]:
                del left[n]
        made.append((often, used))
    return made


def _slots(made: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): the keys, first sequence, offset of the runs of items that share a slot."""
    rows, ranks, sequence = [], {}, 0
    for often, used in made:
        offset = 0
        for n, m in sorted(used.items(), reverse=True):
            for _ in range(m):
                r = ranks.get(n, 0)
                rows.append((n, r, sequence, offset))
                ranks[n] = r + often
                offset += n
        sequence += often
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pack(items: DataFrame, keys: list[str], length_col: str, capacity: int) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences of at most ``capacity`` as minimum bin slack finds.

    items: a table that reads the same each time (written, not recomputed by chance), whose
    ``keys`` tell its rows apart; rows equal in all of them may trade places. Lengths are
    1 to ``capacity``; other lengths and nulls get null places. Only the number of items of
    each length goes to the driver, ``capacity`` rows at most.
    """
    fits = F.col(length_col).between(1, capacity)
    counts = {int(r[0]): int(r[1]) for r in items.where(fits).groupBy(length_col).count().collect()}
    at, first_rank, sequence, offset = _slots(plan(counts, capacity))
    dealt = items.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    before = Window.partitionBy(length_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(length_col, "_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(length_col, "_part").orderBy(*keys)
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(bases, [length_col, "_part"], "left").withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array(b.column(len(names)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            rank = np.array(b.column(len(names) + 1).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ok = (size >= 1) & (size <= capacity)
            i = np.maximum(np.searchsorted(at, (size << 44) + rank, "right") - 1, 0)
            if not ok.any():
                s = o = np.zeros(len(size), np.int64)
            else:
                s, o = sequence[i] + rank - first_rank[i], offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s, mask=~ok), pa.array(o, mask=~ok)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, F.col(length_col).cast("long").alias("_size"), "_rank").mapInArrow(run, schema)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,!?;:)"]] = True


def word_pieces(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece offsets with the end last, first piece of each row with the end last): words, cut before a stop after an ASCII letter.

    The tokenizer lower-cases and ends a token there anyway, so fewer distinct pieces give
    the same ids. Letters keep their case where the text holds combining marks or what may be
    a special token: there it could matter.
    """
    plain = not (data >= 0xCC).any() or not ((data == 0xCC) | (data == 0xCD)).any()
    plain = plain and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any()
    out, starts, bounds = words(data, rows, lower=plain)
    mark = np.zeros(len(out) + 1, bool)
    mark[1 : len(out)] = _LETTER[out[:-1]] & _STOP[out[1:]]
    mark[starts] = True
    at = np.flatnonzero(mark)
    return out, at, np.searchsorted(at, starts[bounds])


#: Bytes of text handled at once; the pieces of more would take too much of a task's memory.
WORK = 4 << 20
#: A word put between others that are encoded in one call, so many at a time.
BETWEEN, TOGETHER = b"0", 64


class WordBpe:
    """A tokenizers file that drops white space between words, so that words encode alone."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True) or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: does not drop white space; its words can't be encoded alone")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo()
        #: The id of a word that stands between others, if it has one of its own.
        alone = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.between = alone[0] if len(alone) == 1 else None

    def _each(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces without ``BETWEEN`` or special tokens: many to a call, told apart by the id of the word put between them."""
        out: list[bytes] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        texts = [(b" " + BETWEEN + b" ").join(g).decode("utf-8", "replace") for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.between)
            if len(ends) != len(g) - 1:
                out += self._each(g)
                continue
            data, starts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
            out += [data[s:e] for s, e in zip(starts, [*(4 * ends).tolist(), len(data)], strict=True)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 16384):
            some = pieces[i : i + 16384]
            own = [self.between is None or BETWEEN in p or b"<|" in p for p in some]
            apart, together = iter(self._each([p for p, x in zip(some, own) if x])), iter(self._joined([p for p, x in zip(some, own) if not x]))
            out += [next(apart if x else together) for x in own]
        return out


@lru_cache(maxsize=4)
def _word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the ids of each whole text, then ``end_id``, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _word_bpe(path)
        for b in batches:
            for first, after, data, at in chunks(b.column(1), WORK):
                out, starts, bounds = word_pieces(data, at)
                which, found = distinct(out, starts)
                known = bpe.memo.of([p.rstrip(b" ") for p in found.to_pylist()], bpe.encode)
                sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
                ids = gather(np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes, sizes, which)
                ends = np.zeros(len(which) + 1, np.int64)
                np.cumsum(sizes[which], out=ends[1:])
                ends = ends[bounds]
                row, piece, start, crc, parts = [], [], [], [], []
                for i in range(after - first):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for j, s in enumerate(range(0, len(own), capacity)):
                        row.append(i)
                        piece.append(j)
                        start.append(s)
                        parts.append(own[s : s + capacity])
                        crc.append(zlib.crc32(parts[-1].tobytes()))
                k = b.column(0).slice(first, after - first).take(pa.array(row, pa.int64()))
                arrays = [k, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(list(map(len, parts)), pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["k", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("v")).mapInArrow(run, schema).withColumnRenamed("k", id_col)


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    A null or empty text is ``end_id`` alone. Null ids stay; repeated rows are packed as
    often as they occur; other columns are not read; an empty table gives an empty one.
    The pieces are encoded once and written to the shared folder.
    """
    cut = written(pieces(docs, path, capacity, end_id, with_ids, id_col, text_col), "pieces")
    return pack(cut, [id_col, "piece", "ids_crc32"], "length", capacity)
