"""Hashes of words and of windows of words, vectorised over whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from quireflow.llm.textscan import distinct

BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, at: np.ndarray, both: bool = False) -> list[np.ndarray]:
    """64 bits (or twice 64) for each word of ``textscan.words``."""
    which, pieces = distinct(data, at)
    if not len(which):
        return [np.zeros(0, np.uint64)] * (1 + both)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces.to_pylist())), "<u8").reshape(-1, 2)
    return [h[:, i][which] for i in range(1 + both)]


def window_hashes(words: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """The hash of ``words[p : p + size]`` for each p of ``starts``."""
    n = len(words)
    inverse = pow(int(BASE), -1, 1 << 64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power("up", int(BASE), n), out=total[1:])
    return mixed((total[starts + size] - total[starts]) * _power("down", inverse, n)[starts] if n else np.zeros(0, np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
