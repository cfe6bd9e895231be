import random
import re

import corpus_pipeline
import pytest

from quireflow.llm import similar_sets, store
from quireflow.llm.similar_sets import similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1


def variants(rng, words, changes):
    return [" ".join(f"v{rng.random()}" if i in hit else w for i, w in enumerate(words)) for c in changes for hit in [set(rng.sample(range(len(words)), c))]]


def corpus():
    rng = random.Random(5)
    texts = []
    for size in (1, 3, 5, 6, 14, 40, 100, 300, 900):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        texts += [" ".join(w), " ".join(w).upper(), " ".join(w) + " more", *variants(rng, w, [c for c in (1, 2, 3, 4, 5, 7, 9, 20) if c <= size])]
        texts += [" ".join(w[: int(size * f)]) for f in (0.5, 0.75, 0.79, 0.8, 0.81, 0.9)]
    # A chain of links whose ends are not similar, and one text over and over.
    w = [f"c{i}" for i in range(200)]
    texts += [" ".join(w[i : i + 100]) for i in range(0, 100, 8)] + ["same words again " * 40, "same words again " * 50]
    texts += [None, "", " \n", "a b c d e", "A\tb c d e"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("sample", [20_000, 500])
def test_groups_as_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(similar_sets, "SAMPLE", sample)
    texts = corpus()
    sets = [shingles(t) for t in texts]
    near = [[similarity(a, b) >= 0.8 for b in sets] for a in sets]
    label, before = list(range(len(sets))), None
    while label != before:
        before = label
        label = [min(label[j] for j in range(len(sets)) if near[i][j]) for i in range(len(sets))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {}
    for r in similar_groups(docs).collect():
        roots.setdefault(r.root, []).append(r.k)
    got = {k: min(g) for g in roots.values() for k in g}
    assert got == dict(enumerate(label))
    assert 10 < len(set(label)) < len(set(sets)) < len(texts)
    assert similar_groups(docs.limit(0)).count() == 0


def test_stage_links_by_similarity_alone(spark):
    """Pairs at 0.8 or more go whatever the distance of their fingerprints; those below stay, however small it is."""
    rng = random.Random(11)
    texts, gone = [], set()
    for changes in [1, 2, 3, 10] * 25:
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        texts += [" ".join(w), *variants(rng, w, [changes])]
        if similarity(*map(shingles, texts[-2:])) >= 0.8:
            gone.add(len(texts) - 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(len(texts))) - gone
    assert 40 < len(gone) < 80


def test_near_copies_are_judged_in_rounds(spark, monkeypatch):
    """Of a group of near copies with fingerprints apart, far fewer pairs are shipped than the square of its members; the links are whole."""
    monkeypatch.setattr(similar_sets, "AT_ONCE", 0)
    shipped, verified = [], similar_sets._verified
    monkeypatch.setattr(similar_sets, "_verified", lambda texts, named, pairs, *a: shipped.append(pairs.count()) or verified(texts, named, pairs, *a))
    rng = random.Random(3)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = [t for c in [1] * 60 for t in variants(rng, w, [c])] + ["another text that is like none of the others"]
    sets = [shingles(t) for t in texts]
    assert sum(similarity(a, b) >= 0.8 for a in sets for b in sets) > 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.k: r.root for r in similar_groups(docs).collect()}
    assert len({roots[i] for i in range(60)}) == 1 and roots[60] != roots[0]
    assert 0 < sum(shipped) < 600


def test_simhash_pairs_as_brute_force(spark):
    """The stage's SimHash step finds all that is within its radius; what it leaves is for the prefixes."""
    f = [5, 5, 7, 1 << 40, 1 << 40 | 3, (1 << 20) - 1, -1]
    named = spark.createDataFrame([(i, x, 9) for i, x in enumerate(f)], "s long, f long, n int")
    got = {(r.u, r.v) for r in similar_sets._simhash_pairs(named, 2).collect()}
    assert got == {(0, 1), (0, 2), (2, 4), (3, 4)}


def test_queries_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with store.tidied(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == "false"


def test_texts_that_share_a_page_frame_are_no_candidates(spark, monkeypatch):
    """Texts with words of their own in a frame that many have: their rare shingles come first, so pairs of them are not formed, and links among them are found."""
    formed, linked = [], similar_sets._linked
    monkeypatch.setattr(similar_sets, "_linked", lambda texts, named, pairs, *a: formed.append(pairs.count()) or linked(texts, named, pairs, *a))
    rng = random.Random(9)
    frame = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    texts = [" ".join(frame + [f"w{rng.randint(0, 10**6)}" for _ in range(40)]) for _ in range(36)]
    texts += [t + " more" for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.k: r.root for r in similar_groups(docs).collect()}
    assert all(roots[36 + i] == roots[i] for i in range(3)) and len(set(roots.values())) == 36
    assert 3 <= sum(formed) < 36
