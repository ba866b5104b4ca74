"""What a task holds does not grow with its table."""

import random

from pyspark.sql import functions as F

from colophon import scratch
from colophon.functions import normalise as N
from colophon.functions import text as T
from colophon.operators import catalogue as C
from colophon.operators import search as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_in_slices_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(90)], "vec_id long, embedding array<float>").coalesce(1)
    nearest = lambda: sorted(map(tuple, S.nearest_vectors(df, F.col("vec_id") % 10 == 0, 5).collect()))
    whole = nearest()
    monkeypatch.setattr(S, "BLOCK_SCORES", 20)
    assert nearest() == whole and len(whole) == 45


def test_runs_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 10)
    rows = [(g, v) for g in ("a", "b", None) for v in (1, 2, 2, 3, 7, 9, 10)] * 3
    found = C.runs(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", 2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(g, *r) for g in ("a", "b", None) for r in ((1, 3, 3), (9, 10, 2))], key=str)
    # Dealt once: 63 rows to 7 tasks.
    assert plan(C.runs(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", 2)).count("Exchange hashpartitioning(g") >= 1 and "hashpartitioning(g#" in plan(found) and ", 7)" in plan(found)


def test_areas_of_people_are_dealt_by_lines(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 10)
    rng = random.Random(5)
    orders = [(o, rng.choice(["x", "y", None])) for o in range(20)] + [(3, "x"), (3, "x"), (None, "y")]
    lines = [(rng.choice([*range(25), None]), rng.randrange(8)) for _ in range(90)]
    parts = [(p, rng.choice(["s", "t", None])) for p in range(6)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = C.areas_of_people(df(orders, "o_orderkey int, c string"), df(lines, "l_orderkey int, l_partkey int"), df(parts, "p_partkey int, area string"), "c")
    met = {(c, a, o) for o, c in orders for k, p in lines for q, a in parts if o is not None and o == k and p == q}
    wanted = {}
    for c, a, _ in met:
        wanted[c, a] = wanted.get((c, a), 0) + 1
    assert {(r["c"], r["area"]): r["works"] for r in found.collect()} == wanted
    assert "hashpartitioning(c#" in plan(found) and ", 9)" in plan(found)


def test_whole_texts_go_to_python_by_the_hundred(spark):
    df = spark.createDataFrame([("Ça the ẞ the",), (None,)], "t string")
    for f in (T.fold("t"), N.occurrences(F.col("t"), "the"), N.title_key("t")):
        assert "ArrowEvalPython" not in plan(df.select(f))
    assert [tuple(r) for r in df.select(T.fold("t"), N.occurrences(F.col("t"), "the")).collect()] == [("ca the ss the", [4, 10]), (None, None)]
