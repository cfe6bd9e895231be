import random

import pytest

from quireflow.llm import code_search
from quireflow.llm.code_search import sign_codes, top_k


def test_top_k_as_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(30)]
    codes = [*base, *[base[0]] * 40, *[base[1] ^ 1 << rng.randrange(64) for _ in range(40)], *[rng.getrandbits(64) for _ in range(200)]]
    rows = [(i, signed(c), 1) for i, c in enumerate(codes)] + [(900, None, 1), (None, signed(base[2]), 1), (3, signed(base[3]), 1)]
    items = spark.createDataFrame(rows, "id long, c long, distance int")
    monkeypatch.setattr(code_search, "ROWS", 100)
    for k in (1, 10):
        got = {}
        for r in top_k(items, items.where("id % 5 = 0"), k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
        for i in range(0, len(codes), 5):
            want = sorted(((c ^ codes[i]).bit_count(), j) for j, c in enumerate(codes) if j != i)[:k]
            assert sorted(got[i]) == [(n + 1, d, j) for n, (d, j) in enumerate(want)]
        assert set(got) == set(range(0, len(codes), 5))
    assert top_k(items.limit(0), items, 3).count() == 0 and top_k(items, items.limit(0), 3).count() == 0
    assert len(top_k(items.where("id < 3"), items.where("id = 0"), 10).collect()) == 2


def test_sign_codes(spark):
    v = [(1, [0.5, -1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [1.0] * 64)]
    got = {r.id: r.c for r in sign_codes(spark.createDataFrame(v, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    assert got == {1: 5, 2: None, 3: 0, 4: 2, 5: -1}
    long = sign_codes(spark.createDataFrame([(6, [1.0] * 65)], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="over 64 elements"):
        long.collect()
