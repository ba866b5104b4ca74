"""Trees of totals and replayed histories beside plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from colophon.operators import history as Y
from colophon.operators import rollup as U


def test_tree_of_totals_from_one_scan(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.choice("xyz"), rng.choice([None, "", " ", "e1", "e2 ", "e2"]), rng.choice([None, 0, 1, 2]), i) for i in range(150)]
    spark.createDataFrame(rows, "work long, variant string, engine string, page long, chunk_id long").write.parquet(str(tmp_path / "chunks"))
    df = U.text_tree(spark.read.parquet(str(tmp_path / "chunks")), {"first": F.col("page") == 1})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = df.first()
    named = [(w, v, (e or "").strip(), p) for w, v, e, p, _ in rows]
    assert (got["works"], got["chunks"], got["pages"], got["aligned_works"]) == (len({r[0] for r in rows}), 150, len({(w, p) for w, _, _, p in named if p}), len({w for w, _, _, p in named if p}))
    assert got["first"] == len({w for w, _, _, p in named if p == 1})
    for node in got["variants"]:
        own = [r for r in named if r[1] == node["variant"]]
        assert (node["works"], node["known"], node["unknown"]) == (len({r[0] for r in own}), len({r[0] for r in own if r[2]}), len({r[0] for r in own if not r[2]}))
        by = defaultdict(set)
        for w, _, e, _ in own:
            by[e].add(w)
        assert [(e["engine"], e["works"]) for e in node["engines"]] == sorted((e, len(ws)) for e, ws in by.items() if e)
    assert [n["variant"] for n in got["variants"]] == ["x", "y", "z"]
    empty = U.text_tree(spark.read.parquet(str(tmp_path / "chunks")).limit(0)).first()
    assert (empty["works"], empty["chunks"], empty["variants"]) == (0, 0, [])


def test_states_are_those_of_a_replay(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    events = [(rng.randrange(6), start + timedelta(hours=rng.randrange(60)), i, rng.choice(["edit", "approve", "approve", "withdraw", "submit"]), rng.choice("abcd"), f"text {i}") for i in range(160)]
    times = [start + timedelta(hours=h) for h in (0, 7, 30, 100)]
    df = spark.createDataFrame(events, "page long, ts timestamp, seq long, kind string, actor string, text string")
    got = {(r["page"], r["at"]): (r["text"], r["editor"], r["edits"], r["approvals"], r["state"]) for r in Y.states_at(df.repartition(5), times).collect()}
    wanted = {}
    for at in times:
        for page in range(6):
            head, said, submitted, edits = None, {}, False, 0
            for _, _ts, _, kind, actor, text in sorted((e for e in events if e[0] == page and e[1] <= at), key=lambda e: (e[1], e[2])):
                if kind == "edit":
                    head, said, submitted, edits = (text, actor), {}, False, edits + 1
                elif kind == "submit":
                    submitted = True
                else:
                    said[actor] = kind
            if head:
                n = sum(1 for a, k in said.items() if k == "approve" and a != head[1])
                wanted[page, at] = (*head, edits, n, "approved" if n >= 2 else "submitted" if submitted else "draft")
    assert got == wanted and len({s[-1] for s in wanted.values()}) == 3


def test_pages_of_a_merged_history_follow_each_other(spark):
    rows = lambda n, step: spark.createDataFrame([(i % 2, i, datetime(2024, 1, 1 + i * step % 9), f"d{i}") for i in range(n)], "record long, id long, ts timestamp, d string")
    lists = {"a": (rows(30, 1), F.col("d")), "b": (rows(20, 2), F.upper("d"))}
    whole = [(r["ts"], r["kind"], r["id"]) for r in Y.merged_history(lists, 1000).where("record = 0").orderBy("n").collect()]
    assert len(whole) == 25 and whole == sorted(whole, key=lambda x: (-x[0].timestamp(), x[1], -x[2]))
    first = [(r["ts"], r["kind"], r["id"]) for r in Y.merged_history(lists, 10).where("record = 0").orderBy("n").collect()]
    after = [(r["ts"], r["kind"], r["id"]) for r in Y.merged_history(lists, 10, first[-1]).where("record = 0").orderBy("n").collect()]
    assert first + after == whole[:20]
