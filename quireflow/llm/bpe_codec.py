"""BPE encoding and decoding by forced boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.byte_bpe import ByteBpe, loaded
from quireflow.llm.textscan import Memo, chunks, distinct, gather


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo()


def encode(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, little-endian unsigned 32-bit.

    Byte pairs that occur inside no vocabulary token mark certain token ends. The
    fragments between them are encoded independently, equal ones once, and their
    ids concatenated.
    """
    bpe, memo = loaded(path), _memo(path)

    def make(fresh: list[bytes]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in bpe.encode(fresh)]

    for first, after, data, rows in chunks(texts):
        if not len(data):
            yield from (np.zeros(0, "<u4") for _ in range(first, after))
            continue
        at, of_row = bpe.cuts(data, rows, bpe.any_cut)
        which, pieces = distinct(data, at)
        known = memo.of(pieces.to_pylist(), make)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = gather(np.frombuffer(b"".join(known), "<u4"), starts, sizes, which)
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=ends[1:])
        ends = ends[of_row]
        for k in range(after - first):
            yield ids[ends[k] : ends[k + 1]]


def decode(ids: np.ndarray, bpe: ByteBpe) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, as in the library."""
    return b"".join(map(bpe.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _mapped(docs: DataFrame, id_col: str, col: str, run, out: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(col).alias("v")).mapInArrow(run, f"k {kind}, {out}").withColumnRenamed("k", id_col)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, ids array<int>).

    A null or empty text has no ids; null ids of rows stay; repeated rows each get a
    row; other columns are not read. Special strings in a text become their token, as
    is the library's default. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in encode(b.column(1), path)], pa.list_(pa.int32()))], ["k", "ids"])

    return _mapped(docs, id_col, text_col, run, "ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: (id, text). A null or empty array gives the empty text. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(np.array(x or [], np.int64), bpe) for x in b.column(1).to_pylist()], pa.string())], ["k", "text"])

    return _mapped(encoded, id_col, ids_col, run, "text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode: (id, n_tokens, ids_sha256, decoded_sha256) per input row, in one pass.

    The digests are lowercase hex, of the ids as little-endian unsigned 32-bit integers
    and of the decoded text in UTF-8. Nulls, repeats and other columns as in ``bpe_encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, coded, back = [], [], []
            for ids in encode(b.column(1), path):
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(decode(ids, bpe).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["k", "n", "c", "d"])

    return _mapped(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
