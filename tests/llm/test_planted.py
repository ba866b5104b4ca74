"""Operators 1 and 4 beside their SQL on tables that hold what they look for."""

import random

import duckdb
import pytest

from colophon.llm import queries, quotation, url_filter
from parity import rows_of, spark_rows


def beside_sql(spark, df, name, table, folder):
    path = str(folder / f"{table}.parquet")
    df.coalesce(1).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    wanted = rows_of([c[0] for c in found.description], found.fetchall())
    got = spark_rows(queries.QUERIES[name](spark, str(folder)))
    assert got == wanted
    return got


def test_aliases_beside_sql(spark, tmp_path):
    rng = random.Random(1)
    hosts = ["a.com", "shop.example.com", "EXAMPLE.net", "b.net", "c.org", "x.d.org"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(60)}{rng.choice(['', '?a=1&b=2', '#f', '?q=%20'])}"
    written = lambda u: rng.choice([u, u.replace("&", "&amp;"), u.split(":", 1)[1], "/" + u.split("/", 3)[3], u.rsplit("/", 1)[1] or "x"])
    tags = [
        '<link rel="canonical" href="{}">',
        "<LINK href='{}' rel='alternate canonical'/>",
        '<link rel=canonical href={}>',
        '<link rel="canonicalize" href="{}">',
        '<link rel="canonical" data-href="{}">',
        '<meta http-equiv="Refresh" content="0; url={}">',
        '<meta http-equiv="refresh-never" content="0; url={}">',
        '<meta name="refresh" content="0; url={}">',
    ]
    rows = [(i, url(), rng.choice(tags).format(written(url())) if rng.random() < 0.3 else "<p>refresh</p>") for i in range(2500)]
    rows += [(9000, None, None), (9001, "", ""), (9002, "no address", tags[0].format("http://c.org/es/1")), (1, rows[1][1], rows[1][2])]
    columns, got = beside_sql(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), "op1_url_filter", "pages", tmp_path)
    inherited = columns.index("inherited")
    assert sum(r[inherited] for r in got) > 50 and sum(not r[inherited] for r in got) > 50


@pytest.mark.parametrize("tag", ['<link rel="alternate canonical" href="http://c.org/es/1">', '<link data-href="http://z.com/" rel="canonical" href="http://c.org/es/1">', '<link rel="canonical" href="http://c.org/es/1?a=1&amp;b=2">'])
def test_pages_join_the_blocked_address(spark, tag):
    rows = [(1, "http://q.com/1", tag), (2, "http://c.org/es/1", ""), (3, "http://c.org/es/1?a=1&b=2", "")]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block"}


def test_replies_beside_sql(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "delta,", "eps", "zeta", "eta."]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    rows = []
    for conv in range(250):
        texts = []
        for turn in range(rng.randint(1, 9)):
            text = "\n".join(line() for _ in range(rng.randint(1, 4)))
            if texts and rng.random() < 0.7:
                quoted = rng.choice(texts)
                if rng.random() < 0.4:
                    flat = quoted.split()
                    quoted = "\n".join(" ".join(flat[k : k + 3]) for k in range(0, len(flat), 3))
                text = "\n".join(rng.choice(["> ", ">", " > "]) + x for x in quoted.split("\n")) + rng.choice(["\n", "\n\n"]) + text
            texts.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(900, 0, "user", None), (900, 1, "user", ""), (None, 1, "user", "> x"), (901, None, "user", "x"), (5, 0, "user", rows[0][3])]
    columns, got = beside_sql(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "op4_quotation", "conversations", tmp_path)
    parent = columns.index("parent_turn")
    assert sum(r[parent] is not None for r in got) > 300


def test_a_rewrapped_paragraph_is_linked(spark):
    first = "one two three four five six\nseven eight nine\n\nanother paragraph here"
    reply = "> one two three\n> four five six seven\n> eight nine\n\nyes"
    rows = [(1, 0, "user", first), (1, 1, "user", "elsewhere"), (1, 2, "user", reply), (1, 3, "user", "> > one two three\n> > four five six seven\n> > eight nine\n> yes\nno")]
    found = {r["turn"]: r["parent_turn"] for r in quotation.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {0: None, 1: None, 2: 0, 3: 2}
