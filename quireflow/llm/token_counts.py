"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.byte_bpe import loaded
from quireflow.llm.textscan import Memo, chunks, distinct


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo()


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text, as the library counts them.

    Texts are cut where a visible byte meets white space: there the library's own
    split falls too, and no token spans the pair. Equal pieces of a chunk are encoded
    once, in calls balanced by bytes; only lengths are kept.
    """
    bpe, memo = loaded(path), _memo(path)
    out = np.zeros(len(texts), np.int64)
    for first, after, data, rows in chunks(texts):
        if not len(data):
            continue
        at, of_row = bpe.cuts(data, rows, bpe.space_cut)
        which, pieces = distinct(data, at)
        n = np.array(memo.of(pieces.to_pylist(), lambda fresh: [len(x) for x in bpe.encode(fresh)]), np.int64)
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n[which], out=total[1:])
        out[first:after] = np.diff(total[of_row])
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens, over_limit = n_tokens > limit).

    path: a byte-level BPE file of the tokenizers library, readable on every machine.
    Whole texts are counted, however long. A null or empty text has 0 bytes and 0
    tokens; a null id stays null; repeated rows each get a row; other columns are not
    read, so their names can't clash; an empty table gives an empty table. Map-only:
    no shuffle, and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths(b.column(2), path))], ["k", "b", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("k"), F.octet_length(text).cast("long").alias("b"), text.alias("t")).mapInArrow(run, f"k {kind}, b long, n long")
    return counted.select(F.col("k").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
