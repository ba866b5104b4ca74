"""Page numbers, reliability, citations and identity on small tables."""

import random
import re

from pyspark.sql import functions as F

from colophon.operators import identity, textstats


def test_page_numbers_need_a_run(spark):
    rows = [("b", p, f"heading\n{p + 4}\nbody words here") for p in range(1, 12)]
    rows += [("b", 20, "77\nlone"), ("c", 1, "vii\nx"), ("d", 1, None), ("d", 2, "")]
    rows += [("r", p, f"{n}\ntext that runs on") for p, n in enumerate("i ii iii iv v vi vii viii".split(), 1)]
    found = textstats.page_numbers(spark.createDataFrame(rows, "book string, page long, text string"))
    assert sorted((r["book"], r["page"], r["value"]) for r in found.collect()) == [("b", p, p + 4) for p in range(1, 12)] + [("r", p, p) for p in range(1, 9)]


def test_page_of_two_numbers_stays_without(spark):
    rows = [("b", p, f"{p + 4}\nbody\n{p + 50}") for p in range(1, 12)]
    assert textstats.page_numbers(spark.createDataFrame(rows, "book string, page long, text string")).count() == 0


def test_reliability_is_never_sound(spark):
    rows = [("good", "a line of text\nanother line of text"), ("short", "ab\ncd\nefg"), ("none", None), ("none", "\n"), ("cjk", "漢 a b c 字 d e f " * 40)]
    found = {r["book"]: (r["reliability"], r["note"]) for r in textstats.text_reliability(spark.createDataFrame(rows, "book string, text string")).collect()}
    assert found == {"good": ("unassessed", None), "short": ("suspect", "short lines"), "none": ("suspect", "no text"), "cjk": ("suspect", "broken characters")}


def test_citations_prefer_years_and_longer_titles(spark):
    texts = spark.createDataFrame([(1, "See A Short History of Maps, 1901; a short history of maps."), (2, "A short history of maps and charts (1950)"), (3, None), (4, "history of")], "doc_id long, text string")
    works = spark.createDataFrame([(10, "A short history of maps", 1901), (11, "A Short History of Maps and Charts", 1950), (12, "of", 1)], "work_id long, title string, year int")
    found = sorted((r["doc_id"], r["work_id"], r["position"], r["certainty"]) for r in textstats.citation_matches(texts, works).collect())
    assert found == [(1, 10, 1, "probable"), (2, 11, 0, "probable")]


def test_composition_shares(spark):
    df = spark.createDataFrame([(1, "en", 10), (1, "fr", 5), (1, "en", 5)], "doc_id long, lang string, chars long")
    assert sorted((r["lang"], r["chars"], r["share"]) for r in textstats.composition(df).collect()) == [("en", 15, 0.75), ("fr", 5, 0.25)]


def test_identity_rungs(spark):
    sources = spark.createDataFrame([(1, "The Map", "Ann", 1900, "active"), (2, "Old Book", "Bo", 1800, "active"), (3, "Old book", "Bo", 1800, "active"), (4, "Gone", "C", 1, "merged")], "source_id long, title string, author string, year int, status string")
    idents = spark.createDataFrame([("doi:1", 1), ("doi:2", 2)], "ident string, source_id long")
    rows = [
        (1, 9, [], "x", None, None),
        (2, None, ["doi:1"], "x", None, None),
        (3, None, ["doi:1", "doi:2"], "x", None, None),
        (4, None, ["doi:3"], "The Map", "Ann", 1900),
        (5, None, [], "the map!", "ANN", 1900),
        (6, None, [], "Old Book", "Bo", 1800),
        (7, None, None, "Old Book", None, None),
        (8, None, [], "Gone", "C", 1),
        (9, None, [], None, None, None),
    ]
    obs = spark.createDataFrame(rows, "obs_id long, target_id long, ids array<string>, title string, author string, year int")
    found = {r["obs_id"]: (r["action"], r["source_id"], r["decision"]) for r in identity.resolve(obs, idents, sources).collect()}
    assert found == {
        1: ("attach", 9, "explicit_target"),
        2: ("attach", 1, "strong_single"),
        3: ("conflict", None, "strong_multi"),
        4: ("create", None, "strong_new"),
        5: ("attach", 1, "medium_corroborated"),
        6: ("candidate", 2, "medium_uncorroborated"),
        7: ("candidate", 2, "title_only"),
        8: ("create", None, "new"),
        9: ("create", None, "new"),
    }


def test_each_different_word_is_scored_once(spark):
    profiles = spark.createDataFrame([("en", " th", 5), ("en", "the", 5), ("en", "he ", 5), ("fr", " le", 9)], "lang string, gram string, cnt long")
    words = spark.createDataFrame([("the",), ("le",), ("xyz",), ("x",)], "word string")
    found, judged = textstats.word_scores(words, profiles)
    got = {r["word"]: (r["n"], r["informative"], r["lang"]) for r in judged(found).collect()}
    assert got["the"] == (3, 3, "en") and got["le"] == (2, 1, "fr") and got["xyz"][:2] == (3, None) and len(got) == 4
    lines = spark.createDataFrame([(1, 0, "the the xyz"), (1, 1, "xyz"), (2, 0, "le the le"), (3, 0, None)], "doc_id long, line_no int, text string")
    shares = {(r["doc_id"], r["lang"]): (r["chars"], r["share"]) for r in textstats.language_shares(lines, profiles).collect()}
    assert shares == {(1, "en"): (9, 0.75), (1, "und"): (3, 0.25), (2, "en"): (7, 1.0)}


def test_pages_are_read_once_and_cut_at_their_edges(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["7", "iv", "a b", " ", "   ", "\n", "\n", "\r\n", "\r", "\t", "\x0b", "\x85", " ", "字"]) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "\n \r\n", "x" + " " * 50_000 + "y\n3"]
    edge = F.col("text")
    cut = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string").select("n", textstats._lines(textstats._edge(edge)).alias("head"), textstats._lines(F.reverse(textstats._edge(F.reverse(edge)))).alias("foot"))
    lines = lambda t: [x for x in (y.strip(" \t\n\x0b\f\r") for y in re.split(r"\r?\n", t)) if x]
    for n, head, foot in cut.collect():
        assert ((head or []), (foot or [])) == (lines(texts[n] or "")[:3], lines(texts[n] or "")[-3:])
    rows = [(b, p, f"{p + 4}\nbody") for b in ("b", None) for p in range(1, 12)] + [("b", None, "5\nbody")] * 9
    found = textstats.page_numbers(spark.createDataFrame(rows, "book string, page long, text string"))
    assert sorted((r["book"], r["page"], r["value"]) for r in found.collect()) == [("b", p, p + 4) for p in range(1, 12)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan
