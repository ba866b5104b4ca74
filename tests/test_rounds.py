"""Unions by priority and similar texts beside plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import search as S
from colophon.operators import works as W


def plain_union(rows):
    seen, kept = [set(), set()], []
    for at, *keys in sorted(rows):
        if not any(k and k in s for k, s in zip(keys, seen, strict=True)):
            kept.append(at)
            for k, s in zip(keys, seen, strict=True):
                if k:
                    s.add(k)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_union_by_priority_beside_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", *map(str, range(60))]), rng.choice([None, "hot", "hot", *map(str, range(60))])) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumn("at", F.lit("clash"))
    assert sorted(r["id"] for r in W.union_by_priority(df, ["id"], ["a", "b"]).collect()) == plain_union(rows)


def test_a_chain_is_settled_in_turn(spark):
    # Each record shares a key with the next: every other one stays.
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    assert sorted(r["id"] for r in W.union_by_priority(df, ["id"], ["a", "b"]).collect()) == [0, 2, 4, 6, 8, 10] == plain_union(rows)
    assert W.union_by_priority(df.limit(0), ["id"], ["a", "b"]).count() == 0
    assert W.union_by_priority(df.select("id", F.lit(None).cast("string").alias("a")), ["id"], ["a"]).count() == 12


@pytest.mark.parametrize("thresholds", [(), (0.1,), (0.6, 0.2)])
def test_similar_texts_beside_all_pairs(spark, thresholds):
    rng = random.Random(7)
    words = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    texts = {}
    for i in range(90):
        base = list(texts[rng.choice(sorted(texts))]) if texts and rng.random() < 0.6 else words(rng.choice([0, 1, 2, 3, 12, 30]))
        for _ in range(rng.randint(0, 3)):
            if base:
                base[rng.randrange(len(base))] = rng.choice("abcdefgh")
        texts[i] = base
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(500, None)], "doc_id long, text string")
    got = {(r["query_id"], r["id"], r["score"], r["rank"]) for r in S.similar_texts(df, F.col("doc_id") % 5 == 0, k=7, thresholds=thresholds).collect()}
    runs = {i: {tuple(t[j : j + 3]) for j in range(max(1, len(t) - 2))} for i, t in texts.items() if t}
    wanted = set()
    for q in runs:
        if q % 5 == 0:
            scored = sorted((-round(len(runs[q] & runs[i]) / len(runs[q] | runs[i]), 6), i) for i in runs if i != q and runs[q] & runs[i])
            wanted |= {(q, i, -s, n) for n, (s, i) in enumerate(scored[:7], 1)}
    assert got == wanted


def test_similar_texts_in_blocks_store_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 4, 20])))) for i in range(120)], "doc_id long, text string").repartition(3)
    written, plain = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: written.append(name) or plain(df, name))
    whole = sorted(map(tuple, S.similar_texts(df, F.col("doc_id") % 4 == 0, k=5, width=1).collect()))
    # One block: the queries alone are written, no runs of the other texts.
    assert written == ["asked"] and len(whole) == 150
    for name, few in (("BLOCK_RUNS", 60), ("COMMON_RUNS", 2), ("BLOCK_CELLS", 50)):
        monkeypatch.setattr(S, name, few)
    assert sorted(map(tuple, S.similar_texts(df, F.col("doc_id") % 4 == 0, k=5, width=1).collect())) == whole
