"""Demoted edges, rows behind merges, and claims that a field refuses."""

import pytest
from pyspark.sql import functions as F

from colophon.operators import graph as G
from colophon.operators import ledger as L


def test_edges_asserted_more_weakly_are_demoted(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src int, dst int, status string")
    live = edges([(1, 2, "accepted"), (1, 3, "accepted"), (1, 4, "candidate"), (1, 5, "accepted"), (1, 6, "accepted"), (1, 6, "candidate"), (None, 1, "accepted")])
    asserted = edges([(1, 2, "candidate"), (1, 3, "candidate"), (1, 3, "accepted"), (1, 4, "accepted"), (1, 6, None), (1, 7, "candidate")])
    got = {(r["src"], r["dst"]): r["action"] for r in G.reconcile_statuses(asserted, live, ["src", "dst"]).collect()}
    assert got == {(1, 2): "demote", (1, 3): "keep", (1, 4): "keep", (1, 5): "withdraw", (1, 6): "demote", (1, 7): "add"}
    with pytest.raises(ValueError):
        G.reconcile_statuses(asserted.where("dst = 2"), live, ["src", "dst"])


def test_chains_of_merges_end_at_rows_that_stand(spark):
    rows = [(1, "merged", 2), (2, "merged", 3), (3, "active", None), (4, "merged", 5), (5, "soft_deleted", 3), (6, "merged", 7), (7, "merged", 6), (8, "merged", 99), (9, "merged", None), (10, None, None), (11, "active", 5), (12, "soft_deleted", None)]
    got = {r["id"]: r["usable"] for r in G.usable_rows(spark.createDataFrame(rows, "id int, status string, into int")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: 10, 11: 11, 12: None}


def test_fields_refuse_what_no_list_has_and_blanks_over_values(spark):
    said = [("kind", "book", None, "admitted"), ("kind", "tablet", "set", "invalid_enum"), ("kind", " ", "set", "empty_overwrite"), ("kind", None, "delete", "admitted"), ("kind", None, "set", "none"), ("kind", "tablet", "set", "invalid_enum"), ("kind", "", None, "none"), ("note", "", "set", "none"), ("note", "tablet", "set", "admitted"), ("note", None, None, "empty_overwrite")]
    claims = spark.createDataFrame([(1, i // 4, i, f, v, o) for i, (f, v, o, _) in enumerate(said)], "rec int, ts int, event_id int, field string, value string, op string")
    got = [r["outcome"] for r in L.field_outcomes(claims, ["rec"], {"kind": ("book", "map")}).orderBy("event_id").collect()]
    assert got == [x for *_, x in said]
    assert L.field_outcomes(claims.where("false").withColumn("outside", F.lit(1)), ["rec"], {}).count() == 0
