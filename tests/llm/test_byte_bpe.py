import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quireflow.llm.bpe_codec import bpe_decode, bpe_encode, bpe_round_trip, encode
from quireflow.llm.token_counts import lengths, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'ll", "!", "!'s", "9", "12", "é", "日本", "😀", "<|endoftext|>", "<|end", "|>", "\x1c", "\x85", "Z", "'S", "%%%", "̈", "\r\n", "x'y", ".", "…"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "", None, "a" * 50_000, " " * 3000 + "x", "word " * 40_000]


def library():
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts()], t


def test_pieces_give_the_librarys_ids():
    want, _ = library()
    assert [x.tolist() for x in encode(pa.array(texts()), PATH)] == want
    assert lengths(pa.array(texts()), PATH).tolist() == list(map(len, want))


def test_operators(spark):
    rows = [(i if i % 9 else None, x, "extra", 1) for i, x in enumerate(texts()[:60] + [None, "", "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, k int")
    want, t = library()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in rows if i is not None}
    got = [r for r in token_counts(docs, PATH, 5).collect()]
    assert len(got) == len(rows) and all((r.n_tokens, r.over_limit) == (len(ids[r.doc_id]), len(ids[r.doc_id]) > 5) for r in got if r.doc_id is not None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe_round_trip(docs, PATH).collect():
        if r.doc_id is not None:
            back = t.decode(ids[r.doc_id], skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(np.array(ids[r.doc_id], "<u4").tobytes()), sha(back.encode()))
    text = {i: x or "" for i, x, *_ in rows}
    for r in bpe_decode(bpe_encode(docs, PATH), PATH).collect():
        assert r.doc_id is None or r.text == text[r.doc_id]
    assert not token_counts(docs.limit(0), PATH).collect() and not bpe_round_trip(docs.limit(0), PATH).collect()
