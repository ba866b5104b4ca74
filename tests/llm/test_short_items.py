"""Benchmark items of few tokens, without spaces, or without an id."""

import random

import pytest

from colophon.llm import decontaminate


@pytest.mark.parametrize("n", [*range(1, 26), 40])
def test_every_accepted_substitution_is_found(n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10**9)}"
    most = n - -(-4 * n // 5)
    for m in range(most + 1):
        for _ in range(20):
            item = [word() for _ in range(n)]
            changed = list(item)
            for at in rng.sample(range(n), m):
                changed[at] = word()
            index = decontaminate.SeedIndex([(5, " ".join(item))])
            found = index.overlaps(" ".join([*(word() for _ in range(30)), *changed, *(word() for _ in range(30))]))
            assert [o.item_id for o in found] == [5] and found[0].matches >= decontaminate.least_matches(n)


def test_scripts_without_spaces_and_null_ids(spark):
    items = ["数学是研究数量结构变化以及空间等概念的学科", "one two three", "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน"]
    documents = spark.createDataFrame([(1, f"前文很长的一句{items[0]}后面还有"), (2, f"x y {items[1]} z"), (3, f"ก่อน{items[2]}หลัง"), (4, "two one three")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, items[0]), (None, items[1]), (None, items[2])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(documents, benchmark).collect()}
    assert got == {(1, 7), (2, None), (3, None)}
    assert [r["doc_id"] for r in decontaminate.decontaminated(documents, benchmark).collect()] == [4]
