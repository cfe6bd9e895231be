import hashlib
import random
import re

import xxhash

from quireflow.llm.components import components
from quireflow.llm.simhash_dedup import links, simhash_groups
from quireflow.llm.store import written
from quireflow.llm.substring_dedup import COVERS, substring_dedup, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["a", "of", "the", "Ünd", "x1", "日本", "B."]
    shared = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(45, 90))) for _ in range(4)]
    made = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) + str(rng.randint(0, 300)) for _ in range(rng.randint(0, 70)))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared).split()
            lo = rng.randint(0, 15)
            parts += [rng.choice(["\n", "  ", "\t"]).join(s[lo : lo + rng.randint(30, 80)]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]
        made.append("\n".join(parts))
    return [*made, made[0], made[0], made[5] + " tail", None, "", " \n", "one", "one two"]


def rows(texts):
    return [(i, t, "other", i) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, kept string, k long"


def removed(texts, size):
    first = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    out = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_covers():
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_substrings_as_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    for size in (50, 8, 1):
        want = removed(texts, size)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, size).collect()} == {i: w[:3] for i, w in want.items()}
    want = removed(texts, 50)
    assert any(w[1] for w in want.values())
    for r in without_repeats(docs).collect():
        assert r.kept == "other" and r.text == (want[r.doc_id][3] if want[r.doc_id][1] else texts[r.doc_id])


def test_substrings_with_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (4, t + " more"), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == [(0, 0), (4, 0), (4, 0), (4, 0), (9, 60)]
    assert substring_dedup(docs.limit(0)).count() == 0


def fingerprint(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_as_brute_force(spark):
    rng = random.Random(8)
    texts = corpus(9, 40)
    for base in range(3):
        w = texts[base].split() * 3
        for _ in range(25):
            v = list(w)
            v[rng.randrange(len(v))] = "changed" + str(rng.randint(0, 5))
            texts.append(" ".join(v))
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    f = [fingerprint(t) for t in texts]
    label = list(range(len(f)))
    for _ in f:
        label = [min(label[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 2) for i in range(len(f))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {i: (f"{f[i]:016x}", label[i]) for i in range(len(f))}
    assert len(set(label)) < len(set(f)) < len(f)
    assert simhash_groups(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash_groups(odd).collect()) == [(0, 3), (3, 3), (3, 3)]


def test_postings_do_not_pass_through_the_driver(spark):
    prints = written(spark.range(1000).selectExpr("xxhash64(id) AS f"), "prints")
    plan = links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    assert {r.node: r.root for r in components(e).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
