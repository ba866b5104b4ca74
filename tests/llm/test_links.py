"""URL filters, quotation linking, licences and components beside SQL and brute force."""

import duckdb
import pytest

from colophon.llm import licenses, queries, quotation, url_filter
from colophon.llm.components import components
from parity import rows_of, spark_rows


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    found = con.execute(sql)
    assert spark_rows(df) == rows_of([c[0] for c in found.description], found.fetchall())


def pandas(df):
    import pyarrow as pa

    return pa.Table.from_pylist([r.asDict() for r in df.collect()]) if df.count() else df.toArrow()


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    rows = [*chain, *star, (7, 7), (None, 3), (5, 4), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "https://a.example.com/en/1", None),
    (2, "http://b.example.net/x", '<html><link rel="canonical" href="https://A.EXAMPLE.com/en/1#top">'),
    (3, "http://c.example.net/de/81", "<LINK href='//b.example.net/x' rel=canonical>"),
    (4, "http://c.example.net/de/9", '<meta http-equiv="refresh" content="0; url=/de/81">'),
    (5, "http://example.com/en/77?q=1#f", ""),
    (6, None, "<link rel=canonical href=http://a.example.com/en/1>"),
    (7, "no scheme", None),
    (8, "http://notexample.net/de/8", None),
    (9, "HTTP://X.ORG/es/", '<link rel="stylesheet" href="http://a.example.com/en/1">'),
    (9, "HTTP://X.ORG/es/", None),
    (10, "http://lone.example.net/free", '<link rel="canonical" href="page">'),
    (11, "http://host.only?x=1", None),
]


def test_url_filter_beside_sql(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    df = url_filter.judge_urls(pages.withColumn("verdict", pages.page_id).withColumn("rule", pages.url))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("b.example.net", "/x", None, "block")  # alias of a blocked page
    assert got[3][2:] == ("example.net/de/8", "block")
    assert got[4][2:] == ("net/de/", "allow")  # explicit allow stands before the alias
    assert got[5][2:] == ("example.com/en/7", "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("net/de/", "allow")
    assert got[10][3] == "allow" and got[11][:2] == ("host.only", "")
    same(df, queries.oracle_sql()["op1_url_filter"], pages=pandas(pages))


def test_many_rules_are_joined_alike(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    few = spark_rows(url_filter.judge_urls(pages))
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert spark_rows(url_filter.judge_urls(pages)) == few


def test_redirect_table_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://z.net/a", None)], "page_id int, url string, html string")
    moved = spark.createDataFrame([("http://z.net/a", "http://w.org/es/1"), (None, "http://q.net/")], "from_url string, to_url string")
    assert url_filter.judge_urls(pages, redirects=moved).first()["verdict"] == "block"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


TALK = [
    (1, 0, "user", "Hello there\nSecond  line"),
    (1, 1, "assistant", "> hello THERE\nAn answer"),
    (1, 2, "user", ">> Hello there\n> An answer\nAnd more"),
    (1, 3, "user", "> never said\nOwn words"),
    (1, 4, "user", None),
    (1, 5, "user", "> and more"),
    (2, 0, "user", "> Hello there"),
    (2, 1, None, ""),
    (None, 1, "user", "> x"),
    (3, None, "user", "y"),
]


def test_quotation_beside_sql(spark):
    talk = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    df = quotation.reply_ordered(talk.withColumn("depth", talk.turn))
    got = {(r["conv_id"], r["turn"]): r for r in df.collect()}
    assert (got[1, 1]["parent_turn"], got[1, 1]["thread_turn"], got[1, 1]["text"]) == (0, 0, "An answer")
    assert (got[1, 2]["parent_turn"], got[1, 2]["depth"], got[1, 2]["max_level"]) == (1, 2, 2)
    assert (got[1, 3]["parent_turn"], got[1, 3]["thread_turn"]) == (None, 3)
    assert (got[1, 5]["thread_turn"], got[1, 5]["depth"]) == (0, 3)
    assert got[2, 0]["parent_turn"] is None and len(got) == len(TALK)
    same(df, queries.oracle_sql()["op4_quotation"], conversations=pandas(talk))
    assert quotation.reply_ordered(talk.limit(0)).count() == 0


MIT = " ".join(s[0].upper() + s[1:] + "." for n, s in licenses.SENTENCES if n in ("mit-grant", "mit-notice", "mit-warranty"))
TEXTS = [
    (1, "Some prose. Released under the MIT License.\nMore prose"),
    (2, "no stop here\nLicensed under the Apache License, Version 2.0.\nxx"),
    (3, MIT.replace(" software", "\nsoftware", 3)),
    (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. All rights reserved!"),
    (5, None),
    (6, ""),
    (7, "This mentions a license and a warranty only"),
    (7, "This work is licensed under the GNU General Public License, version 3."),
    (8, "x " * 50_000 + "\n\nReleased under the MIT License"),
]


def test_licences_beside_sql(spark):
    documents = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df = licenses.scan_licences(documents.withColumn("rule", documents.doc_id))
    got = sorted((r["doc_id"], r["rule"], r["n_steps"]) for r in df.collect())
    assert got == [(1, "mit-named", 1), (2, "apache-named", 1), (3, "mit-text", 3), (4, "cc-by-nc-named", 1), (4, "reserved-named", 1), (7, "gpl3-named", 1), (8, "mit-named", 1)]
    same(df, queries.oracle_sql()["op8_license_scan"], documents=pandas(documents))
    assert licenses.scan_licences(documents.limit(0)).count() == 0
