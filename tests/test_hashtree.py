"""Hash trees and canonical forms beside plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from colophon.operators import hashtree as H
from colophon.sources import sinks


def fold(hashes, fan):
    while len(hashes) > 1:
        hashes = [hashlib.sha256("".join(hashes[i : i + fan]).encode()).hexdigest() for i in range(0, len(hashes), fan)]
    return hashes[0] if hashes else None


@pytest.mark.parametrize("n", [0, 1, 3, 4, 100])
def test_root_is_a_fold_in_order(spark, n):
    rows = [(i * 7 % 101, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)] + ([(None, "0"), (5, "1"), (5, "1")] if n > 3 else [])
    df = spark.createDataFrame(rows, "k long, row_hash string")
    tree = H.hash_tree(df.repartition(7), ["k"], fan=4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert H.root_of(tree) == fold([h for _, h in ordered], 4)
    assert [r["hash"] for r in tree.where("level = 0").orderBy("index").collect()] == [h for _, h in ordered]


def test_a_swap_changes_the_root_and_is_found_from_it(spark):
    rows = [(i, f"{i:064x}") for i in range(60)]
    other = [(i, f"{({10: 11, 11: 10}.get(i, i)):064x}") for i in range(60)]
    a, b = (H.hash_tree(spark.createDataFrame(x, "k long, row_hash string"), ["k"], fan=4) for x in (rows, other))
    assert H.root_of(a) != H.root_of(b)
    assert sorted(r["index"] for r in H.differing(a, b, 4).collect()) == [10, 11]
    assert H.differing(a, a, 4).count() == 0


def test_canonical_form_sorts_keys_at_every_depth(spark):
    values = ['{"b":1,"a":{"d":[3,{"z":null,"y":"é\\n"}],"c":true}}', "[1, 2]", '"x"', "null", "{}", "", "{", None, '{"B":1,"a":2,"_":3}']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(H.canonical_json(F.col("v"))).collect()]

    def plain(v):
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    assert got == [plain(v) for v in values]


def test_approved_pages_are_pinned_by_order_and_repetition(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "page long, text string, approved boolean")
    pin = lambda df, name: sinks.write_approved(df, str(tmp_path / name), "page", ["text"])
    whole = pin(pages, "a")
    assert whole == pin(pages.orderBy(F.desc("page")), "b") and whole != pin(pages.union(pages), "c")
    assert whole != pin(pages.withColumn("text", F.when(F.col("page") == 1, "b").when(F.col("page") == 2, "a").otherwise("c")), "d") and pin(pages.where("page = 3"), "e") is None
