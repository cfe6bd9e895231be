"""Byte-level BPE through forced boundaries: the parts that token counts and the codec share."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from quireflow.llm.textscan import SPACES

#: Bytes of text given to the library in one call.
BATCH = 1 << 20


def byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, with the byte pairs that no token of it holds."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level BPE; cuts between its words would not be safe")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        back = byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = token.encode() if token in added else bytes(back[c] for c in token)
        held = np.zeros((256, 256), bool)
        for b in self.token_bytes:
            for x, y in zip(b, b[1:], strict=False):
                held[x, y] = True
        #: [a, b]: no token holds byte a followed by byte b, so a token must end between them.
        self.never = ~held
        # The library splits by a pattern before it merges. A cut keeps that split if the
        # right side starts with white space, or if both sides are visible and the right one
        # can't be the start of a contraction. White space on the left only is not safe:
        # the pattern leaves the last space of a run to the next word.
        visible = np.zeros(256, bool)
        visible[0x21:0x7F] = True
        right = visible.copy()
        right[0xC2:0xF5] = True
        right[ord("'")] = False
        self.space_cut = self.never & SPACES[None, :]
        self.any_cut = self.space_cut | (self.never & visible[:, None] & right[None, :])

    def cuts(self, data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece offsets with the end last, first piece of each row with the end last)."""
        n = len(data)
        mark = np.zeros(n + 1, bool)
        if n > 1:
            pair = data[:-1].astype(np.uint16)
            pair <<= 8
            pair |= data[1:]
            mark[1:n] = table.reshape(-1)[pair]
        mark[rows] = True
        at = np.flatnonzero(mark)
        return at, np.searchsorted(at, rows)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, in calls balanced by bytes."""
        out: list[list[int]] = []
        first, held = 0, 0
        for i, p in enumerate(pieces):
            held += len(p)
            if held >= BATCH or i + 1 == len(pieces):
                texts = [x.decode("utf-8", "replace") for x in pieces[first : i + 1]]
                out += [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                first, held = i + 1, 0
        return out


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)
