"""Operators on small tables, beside plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.functions import predicates as P
from colophon.functions import text as T
from colophon.operators import catalogue as C
from colophon.operators import graph as G
from colophon.operators import ledger as L
from colophon.operators import search as S
from colophon.sources import readers, sinks
from colophon.streaming import ledger_stream


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_facets_leave_out_their_own_selection(spark):
    rows = [("book", ["en", "fr"], 1), ("book", ["en"], 2), ("map", ["fr"], 1), ("map", [], 2), (None, ["en"], None), ("", None, 1)]
    df = spark.createDataFrame(rows, "kind string, langs array<string>, c int")
    found = C.except_self_facets(df, {"kind": (F.col("kind"), F.col("kind") == "book"), "lang": (F.col("langs"), P.any_of(F.col("langs"), ["en"])), "c": (F.col("c"), F.lit(True))})
    assert values(found, "dimension", "key", "cnt") == [("c", "1", 1), ("c", "2", 1), ("kind", "book", 2), ("lang", "en", 2), ("lang", "fr", 1)]
    assert C.except_self_facets(df.limit(0), {"kind": (F.col("kind"), F.lit(True))}).count() == 0


def test_keyset_pages_join_up(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, y int")
    keys, after, seen = [("y", True), ("id", False)], None, []
    while page := C.keyset_page(df, keys, after, 7).collect():
        seen += [(r["id"], r["y"]) for r in page]
        after = (page[-1]["y"], page[-1]["id"])
    assert seen == sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


def test_runs_and_changes(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 8, 8, 20)], "g string, v int")
    assert values(C.runs(df, ["g"], "v", 2), "first", "last", "length") == [(1, 3, 3), (7, 8, 2)]
    before = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, t string")
    after = spark.createDataFrame([(2, None), (3, "zz"), (4, "n")], "id int, t string")
    assert values(C.changes(before, after, "id", ["t"]), "id", "change") == [(1, "removed"), (3, "updated"), (4, "added")]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_beside_recursion(a, b):
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    assert T.edit_distance(a, b) == d(len(a), len(b))
    assert T.edit_distance(a, b, 2) == min(d(len(a), len(b)), 3)


def test_scalars(spark):
    rows = [("c. 1890", "xiv", "9780306406157"), ("1901-1910", "IIX", "9780306406158"), ("none", "abc", "x"), (None, None, None), ("1999", "ccclxxxviii", "")]
    df = spark.createDataFrame(rows, "y string, r string, i string")
    got = df.select(P.year_span(F.col("y")).alias("y"), P.roman_value(F.col("r")).alias("r"), P.isbn13_valid(F.col("i")).alias("i")).collect()
    assert [tuple(r["y"]) for r in got] == [(1890, None, "estimated"), (1901, 1910, "range"), (None, None, "unknown"), (None, None, "unknown"), (1999, None, "exact")]
    assert [r["r"] for r in got] == [14, 10, None, None, 388] and [r["i"] for r in got] == [True, False, False, False, False]
    y = spark.createDataFrame([(1,), (100,), (101,), (2000,), (-1,)], "y int").select(P.century_of(F.col("y")).alias("c"))
    assert [r["c"] for r in y.collect()] == [1, 1, 2, 20, 0]
    texts = spark.createDataFrame([("Étude  Groß’s",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(T.fold("t")).collect()] == ["etude  gross's", None, ""]
    assert [r[0] for r in texts.select(T.slug(F.col("t"))).collect()] == ["etude-grosss", None, ""]
    urls = spark.createDataFrame([("https://a.b/c",), ("java\nscript:x",), (" HTTP://x",), ("ftp://x",), (None,)], "u string")
    assert [r[0] for r in urls.select(P.safe_url(F.col("u"))).collect()] == [True, False, True, False, None]


def test_search_operators(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "teh quikc brown dog"), (3, "nothing here"), (4, None), (5, "")], "doc_id long, text string")
    assert values(S.phrase_hits(df, " Quick B"), "doc_id", "position") == [(1, 5)]
    with pytest.raises(ValueError):
        S.phrase_hits(df, "ab")
    assert values(S.fuzzy_hits(df, "the quick"), "doc_id") == [(1,), (2,)]
    assert S.pattern_literals("under [a-z]+|abc?def") == ["under ", "def"]
    for refused in ("abcd|[xyz]+", "(abcd)?", r"\babcd", "(?=abcd)abcd", "(abcd){0,1}e", "a" * 257, "abcd("):
        with pytest.raises(ValueError):
            S.pattern_literals(refused)
    assert S.pattern_literals("(foobar)?xyz") == ["xyz"] and S.pattern_literals("(under the)*Licensed") == ["Licensed"]
    assert S.pattern_literals("(?:abc|de)+longest") == ["longest"] and S.pattern_literals("(abc|def)[0-9]") == ["abc", "def"]
    assert values(S.pattern_hits(df, "(?i)BROWN (fox)?"), "doc_id") == [(1,), (2,)]
    odd = spark.createDataFrame([(1, "I don't know"), (2, "know")], "doc_id long, text string")
    assert values(S.fuzzy_hits(odd, "don't know"), "doc_id") == [(1,)]
    for refused in ("", " ?! ", "a " * 13):
        with pytest.raises(ValueError):
            S.fuzzy_hits(odd, refused)
    assert values(S.pattern_hits(df, "brown [a-z]+"), "doc_id", "match") == [(1, "brown fox"), (2, "brown dog")]
    similar = S.similar_texts(spark.createDataFrame([(0, "a b c d"), (1, "a b c d"), (2, "b c d e"), (3, "x y")], "doc_id long, text string"), F.col("doc_id") == 0)
    assert values(similar, "id", "score") == [(1, 1.0), (2, pytest.approx(1 / 3, abs=1e-6))]


def test_vectors_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "vec_id long, embedding array<float>")
    whole = values(S.nearest_vectors(df, F.col("vec_id") % 10 == 0, 5), "query_id", "rank", "id", "score")
    monkeypatch.setattr(S, "BLOCK_QUERIES", 3)
    assert values(S.nearest_vectors(df, F.col("vec_id") % 10 == 0, 5), "query_id", "rank", "id", "score") == whole and len(whole) == 60


def test_pagerank_beside_loops(spark):
    edges = [(1, 2), (1, 2), (2, 3), (3, 1), (4, 3)]
    nodes = [1, 2, 3, 4, 5]
    rank = dict.fromkeys(nodes, 1 / 5)
    for _ in range(8):
        loose = sum(r for n, r in rank.items() if all(a != n for a, _ in edges))
        rank = {n: 0.15 / 5 + 0.85 * (loose / 5 + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n)) for n in nodes}
    found = G.pagerank(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int"), rounds=8)
    assert {r["node"]: r["rank"] for r in found.collect()} == pytest.approx(rank)


def test_chains_cycles_and_guards(spark):
    pointers = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (200, None)]
    found = dict(values(G.final_targets(spark.createDataFrame(pointers, "id long, into long"), rounds=8).where("id < 100"), "id", "target"))
    assert found == dict.fromkeys(range(30), 30)
    a, b = spark.createDataFrame([(1, 2)], "src int, dst int"), spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "src int, dst int")
    with pytest.raises(ValueError):
        G.reconcile(a, b, ["src", "dst"])
    assert values(G.reconcile(b, b, ["src", "dst"]), "src", "action") == [(1, "keep"), (3, "keep"), (5, "keep")]


def test_winner_depends_on_arrival(spark):
    claims = [(1, 1, "a", 300, 50), (1, 2, "b", 300, 58), (1, 3, "c", 300, 66), (1, 4, "c", 300, 10), (1, 5, "d", 900, 0), (2, 1, None, 300, 1), (2, 2, "x", 300, 1)]
    df = spark.createDataFrame([(k, o, o, v, b, s) for k, o, v, b, s in claims], "k int, ts int, event_id int, value string, band int, score int")
    found = {r["k"]: (r["winner"], r["band"], r["claims"], r["conflicts"]) for r in L.field_winners(df, ["k"]).collect()}
    assert found == {1: ("d", 900, 5, 1), 2: (None, 300, 2, 1)}


def test_pairing_is_one_to_one(spark):
    left = spark.createDataFrame([(1, 1, 1000), (1, 2, 1500), (1, 3, 9000)], "k long, id long, t long")
    right = spark.createDataFrame([(1, 11, 1400), (1, 12, 3900), (1, 13, 20000)], "k long, id long, t long")
    found = {(r["left_id"], r["right_id"], r["gap"]) for r in L.nearest_pairs(left, right, "k", 4000).collect()}
    # The latest left row chooses first; what none took stands by itself.
    assert found == {(1, 12, 2900), (2, 11, 100), (3, None, None), (None, 13, None)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("--- page 1 ---\none\ntwo\n--- page 2 ---\nthree\n")
    (tmp_path / "b.txt").write_text("plain text")
    assert values(readers.paged_texts(spark, str(tmp_path)), "page", "text") == [(0, "plain text"), (1, "one\ntwo"), (2, "three")]
    feed = tmp_path / "feed.jsonl"
    feed.write_text('{"document": "d", "text": "t", "dialect_lv1": ["x"]}\nnot json\n')
    assert values(readers.json_lines(spark, str(feed)), "document", "text") == [("d", "t")]
    plan = tmp_path / "plan.tsv"
    plan.write_text("old_slug\tnew_slug\ttitle\tauthor\tflags\na\tb-1\tT\tA\t\nc\t\tT\tA\t\nd\tBad Slug\tT\tA\t\ne\tx\tT\tA\t\nf\tx\tT\tA\t\n")
    assert values(readers.rename_table(spark, str(plan)), "old_slug", "state") == [("a", "rename"), ("c", "skip"), ("d", "bad_slug"), ("e", "duplicate"), ("f", "duplicate")]


def test_sinks(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, n int")
    incoming = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "id int, v string, n int")
    assert values(sinks.upserted(current, incoming, ["id"], F.col("n")), "id", "v") == [(1, "c"), (2, "b"), (3, "e")]
    text = current.where("id = 1").select(sinks.bibtex(F.lit("book"), F.col("v"), {"title": F.lit("A {B}"), "year": F.lit(1900), "note": F.lit(None)}).alias("b")).first()["b"]
    assert text == "@book{a,\n  title = {A \\{B\\}},\n  year = {1900}\n}"
    hashes = sinks.with_row_hash(current, ["v", "id"]).select("row_hash").distinct()
    assert hashes.count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 00:00:00", 5), (2, "2024-01-01 00:10:00", 7), (9, "2024-01-03 00:00:00", 1)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "user int, ts string, n int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(source))
    stream = spark.readStream.schema("user int, ts timestamp, n int").parquet(str(source))
    query = ledger_stream.first_observations(stream, ["user", "n"], "ts").writeStream.foreachBatch(ledger_stream.upsert_into(str(tmp_path / "out"), ["user"], "ts")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "batch=0"))
    assert values(found, "user", "n") == [(1, 5), (2, 7), (9, 1)]
    usage = ledger_stream.windowed_usage(spark.read.parquet(str(source)), "user", "ts", F.col("n"))
    assert values(usage, "user", "used") == [(1, 10), (2, 7), (9, 1)]
    assert ledger_stream.user_sessions(spark.read.parquet(str(source)), "user", "ts").count() == 3


def test_pagerank_follows_only_edges_that_go_on(spark, monkeypatch):
    # 5 to 9 have no out-edges, 9 stands alone, 77 is no node, 4 gives to one that is none.
    edges, nodes, kept = [(1, 2), (2, 1), (1, 5), (2, 6), (2, 6), (3, 7), (3, 1), (4, 77), (4, 8)], [1, 2, 3, 4, 5, 6, 7, 8, 9], []
    plain = G.Stored.keep
    monkeypatch.setattr(G.Stored, "keep", lambda self, df: kept.append((self.name, out := plain(self, df))) or out)
    monkeypatch.setattr(G.Stored, "drop", lambda self, but=1: None)
    rank = dict.fromkeys(nodes, 1 / 9)
    for _ in range(6):
        loose = sum(r for n, r in rank.items() if all(a != n for a, _ in edges))
        rank = {n: 0.15 / 9 + 0.85 * (loose / 9 + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n)) for n in nodes}
    found = G.pagerank(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int"), rounds=6)
    assert {r["node"]: r["rank"] for r in found.collect()} == pytest.approx(rank)
    assert {df.count() for name, df in kept if name == "ranks"} == {4}
