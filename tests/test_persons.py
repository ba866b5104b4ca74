"""Parsed names, aliases and clusters of persons."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import persons as P
from colophon.operators.graph import connected


@pytest.mark.parametrize(
    "raw, name, reading",
    [
        ("Tamura, Suzuko", "Suzuko Tamura", "Suzuko Tamura"),
        ("Kyosuke Kindaichi (金田一 京助)", "金田一 京助", "Kindaichi Kyosuke"),
        ("金田一 京助 (Kindaichi, Kyosuke)", "金田一 京助", "Kindaichi Kyosuke"),
        ("中川, 裕", "中川 裕", None),
        ("井筒勝信編", "井筒勝信", None),
        ("李編", "李編", None),
        ("John  Batchelor (ed.)", "John Batchelor", "John Batchelor"),
        ("Pilsudski (Пилсудский)", "Pilsudski", "Pilsudski"),
        ("Smith, J. & Jones, K.", "Smith, J. & Jones, K.", "Smith, J. & Jones, K."),
        ("アンナ・ブガエワ", "アンナ・ブガエワ", None),
        (None, None, None),
    ],
)
def test_parsed_names(spark, raw, name, reading):
    row = spark.createDataFrame([(raw,)], "raw string").select(P.parsed(F.col("raw")).alias("p")).first()["p"]
    assert (row["name"], row["reading"]) == (name, reading)


def persons(spark, names, aliases):
    rows = P.persons(spark.createDataFrame([(n, 1) for n in names], "raw string, name int"), spark.createDataFrame(aliases, "form string, person string")).collect()
    return {r["raw"]: (r["person"], r["via"]) for r in rows}


def test_aliases_clusters_and_what_belongs_to_several(spark):
    got = persons(
        spark,
        ["Nakagawa Hiroshi", "Hiroshi Nakagawa", "中川裕", "中川 裕", "Satō Tomomi", "Tomomi Sato", "佐藤知己 (Sato Tomomi)", "佐藤 知己", "Jane Roe", "Roe, Jane", "Жуков", "Ivan Mo", "茂庵 (Mo, Ivan)", "Mo, Ivan", "Ann Li", "Li Ann (理安)", None, "", "  ", "Jane Roe"],
        [("Nakagawa Hiroshi", "hn"), ("中川裕", "hn"), ("中川裕", "zz"), ("Sato  Tomomi", "ts"), ("茂庵", "im"), ("理安", "a1"), ("annli", "a2"), (None, "x"), ("y", None)],
    )
    assert {x: got[x] for x in ("Nakagawa Hiroshi", "Hiroshi Nakagawa", "中川裕", "中川 裕")} == dict.fromkeys(["Nakagawa Hiroshi", "Hiroshi Nakagawa", "中川裕", "中川 裕"], ("hn", "alias"))
    assert got["Satō Tomomi"] == got["Tomomi Sato"] == ("ts", "alias")
    # Kanji that no alias holds: a reading in the same field links them to the aliased name.
    assert got["佐藤知己 (Sato Tomomi)"] == got["佐藤 知己"] == ("ts", "alias keys")
    assert got["Jane Roe"] == got["Roe, Jane"] == ("r:jane roe", "keys") and got["Жуков"] == ("x:жуков", "keys")
    assert got["茂庵 (Mo, Ivan)"] == ("im", "alias") and got["Ivan Mo"] == got["Mo, Ivan"] == ("im", "alias keys")
    assert len(got) == 16


def test_keys_of_several_aliased_persons_choose_none(spark):
    got = persons(spark, ["Ann Li", "理安 (Li Ann)", "李庵 (Li Ann)"], [("理安", "a1"), ("李庵", "a2")])
    assert got["理安 (Li Ann)"] == ("a1", "alias") and got["李庵 (Li Ann)"] == ("a2", "alias") and got["Ann Li"][1] == "ambiguous"


def test_no_names_and_no_aliases(spark):
    assert persons(spark, [], [("a", "b")]) == {} and persons(spark, ["A B"], [])["A B"] == ("r:a b", "keys")


def test_a_name_is_parsed_in_one_table_alone(spark, monkeypatch):
    plans = {}
    kept = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), kept(df, name))[1])
    mentions = spark.createDataFrame([("Smith, Ann",), ("Ann Smith",), (None,), (" ",)], "raw string")
    found = P.persons(mentions, spark.createDataFrame([], "form string, person string"))
    assert {(r["raw"], r["name"]) for r in found.collect()} == {("Smith, Ann", "Ann Smith"), ("Ann Smith", "Ann Smith")}
    parsing = [name for name, plan in plans.items() if "eds)\\b\\.?" in plan]
    assert parsing == ["names"]


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    hub = [("h", f"x{i}") for i in range(40)]
    some = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    edges = chain + hub + some + [("alone", "alone"), (None, "z"), ("z", None)]
    at = {n: n for e in edges if None not in e for n in e}
    for _ in at:
        for a, b in edges:
            if a is not None and b is not None:
                at[a] = at[b] = min(at[a], at[b])
    assert {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()} == at
