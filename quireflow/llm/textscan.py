"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Everything here works on whole texts. Columns are taken apart into chunks of
about ``CHUNK`` bytes of consecutive rows, so the numpy work arrays stay small
whatever the mix of row sizes; one row is never split between chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. Bounds the work arrays, not the input.
CHUNK = 8 << 20

#: ``[\x20\x09-\x0D]``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into the bytes); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, after, data[at[first] : at[after]], at[first : after + 1] - at[first]
        first = after


def words(data: np.ndarray, rows: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words, one space after each; the words' starts with the end last; first word of each row with the end last).

    A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` within a row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(rows), np.int64)
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = rows[rows < n]
    begins[inner] = inside[inner]
    starts = np.flatnonzero(begins)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    last = rows[(rows > 0) & (rows <= n)] - 1
    ends_mask[last] = inside[last]
    ends = np.flatnonzero(ends_mask) + 1
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    room = np.ones(len(out), bool)
    room[at[1:] - 1] = False
    out[room] = LOWER[data[inside]] if lower else data[inside]
    return out, at, np.searchsorted(starts, rows)


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number the pieces ``data[at[i]:at[i+1]]``: (number of each piece, the distinct pieces)."""
    offsets = np.ascontiguousarray(at, np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenate ``values[starts[k]:starts[k]+sizes[k]]`` for each k of ``which``."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[which] - (ends - n), n) + np.arange(total)]


class Memo:
    """Results by piece, in two generations: the older one goes when the younger is full. Bounds memory only.

    A generation holds ``most`` bytes of pieces and results, with 150 a piece for what Python
    needs besides; pieces of over ``longest`` bytes are made anew each time.
    """

    def __init__(self, most: int = 24 << 20, longest: int = 4096) -> None:
        self.most, self.longest, self.held, self.young, self.old = most, longest, 0, {}, {}

    def of(self, pieces: list[bytes], make) -> list:
        """Results for the ``pieces``; ``make`` gets the list of those not known."""
        young, old = self.young, self.old
        found = [young.get(p) for p in pieces]
        lacking = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = old.get(pieces[i])
                if x is None:
                    lacking.append(i)
        if lacking:
            fresh = [pieces[i] for i in lacking]
            for i, p, x in zip(lacking, fresh, make(fresh), strict=True):
                found[i] = x
                if len(p) <= self.longest:
                    young[p] = x
                    self.held += len(p) + 150 + (8 if isinstance(x, int) else getattr(x, "nbytes", 0) or len(x))
        if self.held > self.most:
            self.young, self.old, self.held = {}, young, 0
        return found
