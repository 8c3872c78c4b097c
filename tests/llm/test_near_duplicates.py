"""The near-duplicate stage against exact similarity of five-word shingle sets."""

import random

import numpy as np
from test_operators import prose, roots, shares, variants

from keyfold.llm import simhash_dedup


def jaccard(a, b):
    return len(a & b) / len(a | b)


def family(rng, n, common, own):
    """n texts that share one passage."""
    passage = prose(rng, common)
    return [f"{passage} {prose(rng, own)}" for _ in range(n)]


def test_documents_of_a_template_stay(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TILE_SETS", 16)
    rng = random.Random(6)
    rows = list(enumerate([*family(rng, 60, 232, 75), *variants(rng, 40, 200, 4), *variants(rng, 10, 60, 1), "", " ", "...", "one", "one two"]))
    sets = {i: shares(t, 5) or {tuple(t.split())} for i, t in rows if t.split()}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    far = [jaccard(sets[a], sets[b]) for a, b in pairs if b < 60]
    assert 0.5 < min(far) and max(far) < 0.7
    want = roots([i for i, _ in rows], [(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8] + [(110, 111)])
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs(rows)).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash_dedup.keep_one(docs(rows)).collect()} == set(want.values())


def test_similar_links_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 500, 40)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 41)], rng.integers(0, 500, rng.integers(0, 8))])).astype(np.uint64) for _ in range(25)]
        sets += [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]  # 0.8 to the point
        close = [(a, b) for a in range(27) for b in range(a) if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8]
        assert (26, 25) in close
        assert roots(range(27), simhash_dedup.similar_links(sets, 0.8)) == roots(range(27), close)
