"""Edit fingerprints beside a plain walk, and their classes beside all pairs."""

import random

import numpy as np
import pytest

from colophon.llm import edit_fingerprint as E

_MASK = (1 << 64) - 1


def plain_digits(text):
    """The digits of one text, walked character by character."""
    codes = [ord(c) for c in text]
    after = codes + [0] * (E.AROUND + E.NAMED + E.GRAM)
    name = lambda i: plain_name(after[i : i + E.NAMED])
    names = [name(i) if i + E.NAMED <= len(codes) else _MASK for i in range(len(codes))]
    anchors = [0]
    for i, own in enumerate(names):
        left, right = names[max(0, i - E.AROUND) : i], names[i + 1 : i + 1 + E.AROUND]
        if i and own < _MASK and all(own < x for x in left) and all(own <= x for x in right):
            anchors.append(i)
    digits = []
    for s in range(E.SAMPLES):
        at = min(anchors, key=lambda i: (plain_mix(name(i) ^ int(E._ORDERS[s])), i))
        room = min(max(2 * (len(codes) - at), 1), E.STEPS)
        step = next(int(steps[s]) for steps in E._STEPS_OF if steps[s] < room)
        for t in range(step):
            at = min(at + int(E._BITS[t][(after[at] * 2654435761 & 0xFFFFFFFF) >> 24]), len(codes))
        digest = s
        for k in range(E.GRAM):
            digest = (digest ^ after[min(at + k, len(codes))]) * 0x9E3779B97F4A7C15 & _MASK
            digest ^= digest >> 31
        digits.append(digest >> 60)
    return digits


def plain_name(codes):
    h = 0
    for c in codes:
        h = (h ^ c) * 0x9E3779B97F4A7C15 & _MASK
        h ^= h >> 32
    return h


def plain_mix(x):
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & _MASK
    return x ^ x >> 29


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_digits_beside_a_plain_walk():
    rng = random.Random(1)
    texts = ["", "a", "short one", "日本語の文です" * 9, "x" * 300, *(prose(rng, n) for n in (3, 12, 40, 200))]
    assert E.embed(texts).tolist() == [plain_digits(t) for t in texts]
    assert [E.embed([t])[0].tolist() for t in texts] == E.embed(texts).tolist()


@pytest.mark.parametrize("k", [1, 10, 30, 60, 100])
def test_insertions_in_long_texts(k):
    rng = random.Random(k)
    texts = [prose(rng, 950)[:5000] for _ in range(12)]
    more = "".join(rng.choice("qrstuvw ") for _ in range(k))
    like = lambda changed: E.likeness(E.embed(texts), E.embed(changed))
    assert like([more + t for t in texts]).min() > 0.8
    assert like([t[:2500] + more + t[2500:] for t in texts]).min() > 0.8
    assert like([prose(rng, 900) for _ in texts]).max() < 0.2


def test_likeness_falls_with_the_edits():
    rng = random.Random(7)
    texts = [prose(rng, 500) for _ in range(20)]
    share = lambda p: E.likeness(E.embed(texts), E.embed(["".join(c if rng.random() > p else "z" for c in t) for t in texts])).mean()
    found = [share(p) for p in (0, 0.002, 0.01, 0.03, 0.2)]
    assert found[0] == 1 and found == sorted(found, reverse=True) and found[-1] < 0.2


def test_classes_beside_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base = prose(rng, 120)
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            texts.append(base[:at] + prose(rng, rng.randint(1, 6)) + base[at:])
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[3]), (1001, None), (1002, "")]
    found = E.classed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digits = E.embed(texts)
    low = list(range(len(texts)))
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if E.likeness(digits[a], digits[b]) >= E.LEAST_LIKENESS]
    for _ in texts:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: r["class_id"] for r in found}
    together = [got[2 * a] == got[2 * b] for a, b in linked]
    # Bands find nine tenths of the links and more, and join nothing else.
    assert len(linked) > 30 and np.mean(together) >= 0.9
    assert all(low[i // 2] == low[c // 2] if c % 2 == 0 and c < 1000 else True for i, c in got.items() if i is not None and i % 2 == 0 and i < 1000 and c is not None)
    assert got[1] == got[0] == 0 and got[1001] == got[1002] == 1001 and len(found) == len(rows)
    monkeypatch.setattr(E, "PAIRED", 2)
    assert {r["doc_id"]: r["class_id"] for r in E.classed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == got
