"""The pipeline's near-duplicate stage beside exact Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from colophon.llm import near


def kept(spark, rows):
    documents = spark.createDataFrame(rows, "doc_id long, text string, key string")
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.near_dedup(spark, documents, "").collect())


def similarity(a, b):
    of = lambda t: {tuple(w) for w in zip(*(t[i:] for i in range(5)))} or {tuple(t)}
    return len(of(a) & of(b)) / len(of(a) | of(b))


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("changes", [2, 4, 7, 9])
def test_recall_by_similarity(spark, changes):
    """Of 60 pairs of 400 words, those of similarity 0.8 and more are linked, those below are not."""
    rng = random.Random(changes)
    rows, near_pairs, far_pairs = [], [], []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = edited(rng, words, changes)
        (near_pairs if similarity(words, other) >= 0.8 else far_pairs).append(2 * i + 1)
        rows += [(2 * i, " ".join(words), "x"), (2 * i + 1, " ".join(other).upper(), "x")]
    left = {i for _, i in kept(spark, rows)}
    assert left >= {2 * i for i in range(60)} | set(far_pairs)
    assert len(left & set(near_pairs)) <= 0.05 * len(near_pairs)


def test_groups_beside_all_pairs(spark, monkeypatch):
    """A group of many near copies, which share keys, beside connected components of all pairs."""
    monkeypatch.setattr(near, "PAIRED", 8)
    rng = random.Random(1)
    first = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [edited(rng, first, 1) for _ in range(70)] + [[f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    low = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if low[a] != low[b] and similarity(texts[a], texts[b]) >= 0.8:
            x, y = sorted((low[a], low[b]))
            low = [x if v == y else v for v in low]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    rows += [(None, rows[0][1], "x"), (200, rows[0][1], "x"), (201, "a b", "x"), (202, "A  b", "x"), (203, "a c", "x"), (204, None, "x"), (205, "", "x"), (90, rows[90][1], "x")]
    assert kept(spark, rows) == sorted([*((False, i) for i in range(len(texts)) if low[i] == i), (False, 201), (False, 203), (False, 204), (True, 0)])
    assert kept(spark, rows[:0]) == []
