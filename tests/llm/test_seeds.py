"""The spaced seeds of decontamination beside all items at all shifts."""

import random
import resource
from itertools import combinations

import pytest

from colophon.llm import decontaminate as D


@pytest.mark.parametrize("n", range(1, 31))
def test_every_accepted_pattern_holds_a_place_of_its_mask(n):
    mask = [i for i, c in enumerate(D.mask_of(n)) if c == "1"]
    span = len(D.mask_of(n))
    for length in range(D.least_matches(n), n + 1):
        most = min(length - D.least_matches(n), length // 5)
        # Fewer substitutions hide no more.
        for gone in combinations(range(length), most):
            assert any(all(at + i not in gone for i in mask) for at in range(length - span + 1))


def test_no_few_substitutions_hide_all_places_of_the_long_mask():
    # The fewest substitutions that hide every place in a text of any length, over the last tokens' states.
    mask = [i for i, c in enumerate(D.mask_of(16)) if c == "1"]
    span = len(D.mask_of(16))
    states = {(1,) * (span - 1): 0}
    for length in range(1, 400):
        after = {}
        for state, cost in states.items():
            for token in (0, 1):
                whole = (*state, token)
                if length >= span and all(whole[i] for i in mask):
                    continue
                after[whole[1:]] = min(after.get(whole[1:], 10**9), cost + 1 - token)
        states = after
        assert length < 16 or min(states.values()) > length // 5


def plain(index, text):
    """Every item at every shift."""
    tokens, best = D.token_hashes(text), {}
    for owner, (item_id, item) in enumerate(index.items):
        for shift in range(-len(item) + 1, len(tokens)) if len(item) else ():
            found = index._verified(tokens, owner, shift)
            key = (1, owner) if item_id is None else (0, item_id)
            if found and (key not in best or (found.matches, -found.doc_start) > (best[key].matches, -best[key].doc_start)):
                best[key] = found
    return [best[k] for k in sorted(best)]


@pytest.mark.parametrize("pairs", [D.PAIRS, 0])
def test_overlaps_beside_all_shifts(monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    monkeypatch.setattr(D, "COMPARED", 500)
    rng = random.Random(8)
    for words in (3, 40, 2000):
        word = lambda: f"w{rng.randrange(words)}"  # noqa: E731, B023
        items = [(rng.choice([None, i // 2]), " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 16, 20, 35])))) for i in range(25)]
        index, found = D.SeedIndex(items), 0
        for _ in range(12):
            text = [word() for _ in range(rng.randint(0, 60))]
            for _, item in rng.sample(items, 3):
                part = [w if rng.random() > 0.15 else word() for w in item.split()]
                at = rng.randint(0, len(text))
                text[at:at] = part[rng.randint(0, 2) :]
            got = index.overlaps(" ".join(text))
            assert got == plain(index, " ".join(text))
            found += len(got)
        assert found


def test_repeated_words_take_memory_in_proportion():
    index = D.SeedIndex([(1, "same " * 800), (2, "a b " * 400)])
    index.overlaps("same " * 2000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = index.overlaps("same " * 20_000)
    assert [(o.item_id, o.matches) for o in found] == [(1, 800)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_shorter_items_can_be_left_out(spark):
    documents = spark.createDataFrame([(1, "one two"), (2, "five six seven")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "two"), (2, "six seven")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.contamination(documents, benchmark).collect()) == [1, 2]
    assert [r["doc_id"] for r in D.contamination(documents, benchmark, least_tokens=2).collect()] == [2]
    assert [r["doc_id"] for r in D.decontaminated(documents, benchmark, least_tokens=2).collect()] == [1]
