"""Rows that once were lost, or crashed a query."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import normalise as N
from colophon.operators import search as S
from colophon.operators import textstats as X
from colophon.sources.feeds import import_from


@pytest.mark.parametrize("limit", [1, 2, 3, None])
def test_a_run_never_ends_within_a_key(spark, tmp_path, limit):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (None, "f"), (None, "g")]
    records = spark.createDataFrame(rows, "k int, v string")
    got, runs = [], 0
    while n := import_from(records, "k", str(tmp_path), "job", lambda df: got.extend(r["v"] for r in df.collect()), limit):
        runs += 1
        assert n
    assert sorted(got) == list("abcdefg") and runs == (1 if limit is None else {1: 4, 2: 3, 3: 3}[limit])
    later = records.unionByName(spark.createDataFrame([(None, "late"), (4, "h")], records.schema))
    assert import_from(later, "k", str(tmp_path), "job", lambda df: got.extend(r["v"] for r in df.collect()), limit) == 1 and got[-1] == "h"


def test_passages_of_any_length_are_found(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice(["ab ", "Cd", ", ", "efg ", "-"]) for _ in range(30))) for i in range(40)] + [(99, None), (98, "")]
    passages = [t[a : a + rng.randint(1, 25)] for _, t in texts[:40] for a in [rng.randrange(20)]] + ["", "---", "nowhere to be found", "x"]
    asked = [*enumerate(passages), (900, None)]
    got = {tuple(r) for r in S.passage_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")).collect()}
    assert got == {(q, i) for q, p in asked if p and len(p) >= 3 for i, t in texts if p.lower() in (t or "").lower()}


def test_short_titles_count_from_ten_characters_on(spark):
    texts = spark.createDataFrame([(1, "He wrote Grammatography in 1901, and Ainu Studies too, and More."), (2, "Of studies and ainu")], "doc_id long, text string")
    works = spark.createDataFrame([(1, "Grammatography", 1901), (2, "Ainu Studies", 1950), (3, "More", 1901), (4, None, 1), (5, "!!", 2)], "work_id long, title string, year int")
    got = sorted((r["doc_id"], r["work_id"], r["certainty"]) for r in X.citation_matches(texts, works).collect())
    assert got == [(1, 1, "probable"), (1, 2, "candidate")]


def test_null_vectors_neither_ask_nor_answer(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (100, None), (200, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["id"], r["score"]) for r in S.nearest_vectors(df, df["vec_id"] % 100 == 0, k=9).collect())
    assert got == [(0, 1, 0.0), (0, 4, 0.0), (0, 200, 0.707107), (200, 0, 0.707107), (200, 1, 0.707107), (200, 4, 0.0)]


def test_a_kana_name_stays_whole(spark):
    rows = [("ジョン・バチェラー",), ("金田一京助・知里真志保",), ("山田 太郎 ・鈴木",), ("A. Smith and B. Jones; C",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(N.authors(F.col("t"))).collect()] == [["ジョン・バチェラー"], ["金田一京助", "知里真志保"], ["山田 太郎 ・鈴木"], ["A. Smith", "B. Jones", "C"], None, []]


def test_many_hits_of_one_long_text(spark):
    text = "ab, " * 200_000
    got = spark.createDataFrame([(text,), (None,), ("aaaa",)], "t string").select(F.size(N.occurrences(F.col("t"), "ab")), N.occurrences(F.col("t"), "aa")).collect()
    assert got[0][0] == 200_000 and got[2][1] == [1, 3] and got[1][1] is None


def test_a_reference_list_is_not_cut():
    text = "body\nReferences\n" + "A title of a work, 1900.\n" * 8000
    assert len(X.reference_section(text)) > 190_000 and len(X.reference_section(text, 1000)) == 1000
