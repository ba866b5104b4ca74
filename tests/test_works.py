"""Works, normal forms, claims and exports on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from colophon.functions import normalise as N
from colophon.operators import catalogue as C
from colophon.operators import graph as G
from colophon.operators import ledger as L
from colophon.operators import search as S
from colophon.operators import textstats as X
from colophon.operators import works as W
from colophon.sources import sinks


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, *rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_selectors_and_filters():
    assert W.selected_pages("1,3-5,4") == [1, 3, 4, 5] and W.selected_pages("") is None and W.selected_pages(None) is None
    for bad in ("a", "5-3", "1,,2", "-1", "1 "):
        with pytest.raises(ValueError):
            W.selected_pages(bad)
    f = W.WorkFilters.of({"q": [" maps "], "sort": ["nonsense"], "page": ["-2"], "decade": ["1990"], "types": ["book", ""], "ocr": ["with"]})
    assert (f.text, f.sort, f.page, f.decade, f.types, f.has_text) == ("maps", "updated", 1, 1990, ("book",), True)
    assert W.WorkFilters.of({"page": ["x"], "ocr": ["?"]}) == W.WorkFilters()


def test_listing_pages_join_up(spark):
    works = spark.createDataFrame([(i, f"t{i % 3}", None, "s", "c", "b", None if i % 4 == 0 else 1900 + i % 5, None, 600, [("ain", 0.5 if i % 2 else 0.001)]) for i in range(30)], "work_id int, title string, author string, summary string, category string, type string, year int, significance double, chars int, shares array<struct<lang:string,share:double>>")
    files = spark.createDataFrame([(100 * i + j, i, j % 2, 1, f"2024-01-{1 + (i + j) % 28:02}", j == 1) for i in range(30) for j in range(3)], "file_id int, work_id int, role_rank int, sort_order int, submitted_at string, has_text boolean")
    links = spark.createDataFrame([(1,), (1,), (5,)], "to_id int")
    for sort, (column, _) in W.WORK_SORTS.items():
        seen, after = [], None
        while page := W.list_works(files, works, W.WorkFilters(sort=sort), links, after=after, size=7).collect():
            page = sorted(page, key=lambda r: r["file_id"]) if column == "significance" else page
            seen += [r["work_id"] for r in W.list_works(files, works, W.WorkFilters(sort=sort), links, after=after, size=7).orderBy(*([F.col(column).desc_nulls_last() if W.WORK_SORTS[sort][1] else F.col(column).asc_nulls_last()]), "file_id").collect()]
            last = W.list_works(files, works, W.WorkFilters(sort=sort), after=after, size=7).collect()[-1]
            after = (last[column], last["file_id"])
        assert sorted(seen) == list(range(30))
    assert values(W.list_works(files, works, W.WorkFilters(), links, size=100).where("citation_count > 0"), "work_id", "citation_count") == [(1, 2), (5, 1)]
    assert {r["file_id"] % 100 for r in W.list_works(files, works, W.WorkFilters()).collect()} == {0}
    assert {r["work_id"] for r in W.list_works(files, works, W.WorkFilters(language="ain"), size=100).collect()} == set(range(1, 30, 2))


def test_visibility_matrix(spark):
    states = ["active", "candidate", "merged", "deprecated", "hidden", "soft_deleted", None]
    assert one(spark, W.is_public(F.col("v")), *[(s,) for s in states]) == [True, *[False] * 6]
    rows = [(c, a) for c in (True, False, None) for a in ("available", "embargoed", "takedown", None)]
    for role, wanted in (("reader", {(True, "available")}), ("archive_admin", {(True, x) for x in ("available", "embargoed", "takedown", None)})):
        df = spark.createDataFrame(rows, "c boolean, a string")
        assert {(r["c"], r["a"]) for r in df.where(W.is_readable(F.col("c"), F.col("a"), role)).collect()} == wanted
    assert one(spark, W.may_open(F.col("v"), "archive_admin"), "available", "embargoed", "takedown", "sealed", (None,)) == [True, True, True, False, False]


def test_requests_lifecycle_and_pages(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    events = [("a", at(1), 1, "approved"), ("a", at(2), 2, "applying"), ("b", at(1), 3, "applied"), ("b", at(2), 4, "rejected"), ("b", at(3), 5, "open"), ("c", at(1), 6, "approved"), ("c", at(50), 7, "applying")]
    df = spark.createDataFrame(events, "request_id string, at timestamp, event_id int, status string")
    found = values(W.request_states(df, now=F.lit(datetime.datetime(2024, 1, 1, 0, 55)).cast("timestamp")), "request_id", "status", "refused")
    assert found == [("a", "approved", 0), ("b", "rejected", 2), ("c", "applying", 0)]
    sources = spark.createDataFrame([(i, "active") for i in range(5)], "source_id int, status string")
    ops = spark.createDataFrame([(0, 1, 1, "hide", None), (0, 2, 2, "restore", None), (1, 1, 3, "merge", 0), (2, 1, 4, "merge", 2), (3, 1, 5, "merge", 0), (3, 2, 6, "soft_delete", None)], "source_id int, at int, event_id int, op string, into int")
    assert values(W.lifecycle_states(sources, ops), "source_id", "status", "merged_into") == [(0, "active", None), (1, "merged", 0), (2, "active", None), (3, "soft_deleted", None), (4, "active", None)]
    counts = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "work_id int, page_count int")
    machine, edited = spark.createDataFrame([(1, 2), (2, 9)], "work_id int, page int"), spark.createDataFrame([(1, 3, True), (3, 1, False)], "work_id int, page int, approved boolean")
    assert values(W.page_states(counts, machine, edited), "work_id", "page", "state") == [(1, 1, "none"), (1, 2, "machine"), (1, 3, "approved"), (2, 9, "machine"), (3, 1, "edited")]


def test_priority_union_beside_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", *"abcdefgh"]), rng.choice([None, *"rstuvwxyz"])) for i in range(80)]
    doi, title, kept = set(), set(), []
    for i, d, t in rows:
        if (d and d in doi) or (t and t in title):
            continue
        doi |= {d} if d else set()
        title |= {t} if t else set()
        kept.append(i)
    df = spark.createDataFrame(rows, "id int, doi string, title string")
    assert [r[0] for r in W.union_by_priority(df, ["id"], ["doi", "title"]).orderBy("id").select("id").collect()] == kept


def test_slugs_hits_and_caps(spark):
    slugs = spark.createDataFrame([(s,) for s in ("a-good-one", "x", "1999-the-and", "taken-word", "old-word", "UPPER", "1999-maps")], "slug string")
    found = values(W.slug_problems(slugs, spark.createDataFrame([("taken-word",)], "slug string"), spark.createDataFrame([("old-word",)], "slug string")), "slug", "problem")
    assert found == [("1999-maps", None), ("1999-the-and", "empty"), ("UPPER", "shape"), ("a-good-one", None), ("old-word", "retired"), ("taken-word", "taken"), ("x", "shape")]
    few = W.capped(spark.range(5), [F.col("id")], 3).collect()
    assert [(r["id"], r["truncated"]) for r in few] == [(0, True), (1, True), (2, True)]
    assert not any(r["truncated"] for r in W.capped(spark.range(3), [F.col("id")], 3).collect())
    hits = spark.createDataFrame([(1, 5), (2, 1)], "work_id int, page int")
    files, folios = spark.createDataFrame([(9, 1), (8, 1)], "file_id int, work_id int"), spark.createDataFrame([(1, 5, "iv")], "work_id int, page int, label string")
    assert values(W.enriched_hits(hits, files, folios), "work_id", "file_id", "label") == [(1, 8, "iv"), (2, None, None)]


def test_claims(spark):
    claims = spark.createDataFrame([("k", 1, 1, ["b", "a"], 700), ("k", 2, 2, ["c"], 900), ("k", 3, 3, ["d", "c"], 300), ("j", 1, 4, ["x"], 300), ("j", 2, 5, [], 300)], "k string, ts int, event_id int, members array<string>, band int")
    assert values(L.set_members(claims, ["k"]), "k", "members") == [("j", ["x"]), ("k", ["c", "d"])]
    notes = spark.createDataFrame([("k", 1, 1, "one", 700, 150), ("k", 2, 2, "low", 300, 150), ("k", 3, 3, "one", 900, 0), ("k", 4, 4, "near", 700, 155), ("k", 5, 5, "wins", 800, 0)], "k string, ts int, event_id int, value string, band int, score int")
    assert values(L.appended_notes(notes, ["k"]), "note", "band") == [("wins", 800)]
    assert values(L.appended_notes(notes.where("ts < 5"), ["k"]), "note", "band", "score") == [("one\n\nlow\n\nnear", 700, 150)]
    ids = spark.createDataFrame([(1, "doi:1", 7), (2, "doi:1", 8), (3, "doi:1", 7), (4, "x", 8)], "obs_id int, ident string, source_id int")
    assert values(L.attached_identifiers(ids), "obs_id", "outcome") == [(1, "attached"), (2, "conflict"), (3, "noop"), (4, "attached")]
    winners = spark.createDataFrame([(1, "title", "T"), (1, "year", "1900"), (2, "title", "U")], "id int, field string, winner string")
    before = spark.createDataFrame([(1, "T", 1900), (2, "old", None)], "id int, title string, year int")
    assert values(L.projected(winners, "id", ["title", "year"], before), "id", "changed") == [(1, False), (2, True)]
    scores = spark.createDataFrame([(1, 2.0, -3), (2, -1.0, 2), (1, None, None), (3, 0.505, 9)], "w int, c double, e int").select(L.rank_score(F.col("w"), F.col("c"), F.col("e"))).collect()
    assert [r[0] for r in scores] == [200, 210, 100, 376]
    bands = one(spark, L.band(F.col("v")), *L.BANDS, "nonsense", (None,))
    assert bands == [900, 800, 700, 680, 600, 500, 400, 300, 100, 100, 100]


def test_gate_rules(spark):
    rows = [
        ("conf", "seen", False, "attach", "strong_single", False, "observed", "feed", 0.9, "reject", "x", "field_update"),
        (None, "missing", False, "attach", "new", False, "observed", "feed", 0.1, "auto_apply", "drift", "drift"),
        (None, "missing", False, "create", "new", False, "observed", "feed", 0.9, "reject", "missing_unknown", "drift"),
        (None, "seen", True, "attach", "strong_single", True, "editorial_decision", "manual", 0.1, "auto_apply", "editorial_lifecycle", "lifecycle"),
        (None, "seen", True, "attach", "strong_single", False, "editorial_decision", "feed", 1.0, "propose", "lifecycle_review", "lifecycle"),
        (None, "seen", False, "conflict", "strong_multi", False, "observed", "feed", 1.0, "propose", "new_or_unresolved:strong_multi", "identity_conflict"),
        (None, "seen", False, "candidate", "title_only", False, "observed", "feed", 1.0, "propose", "new_or_unresolved:title_only", "new_source"),
        (None, "seen", False, "attach", "strong_single", True, "observed", "feed", 1.0, "propose", "conflict", "identity_conflict"),
        (None, "seen", False, "attach", "strong_single", False, "heuristic", "feed", 1.0, "propose", "low_trust:heuristic", "enrichment"),
        (None, "seen", False, "attach", "explicit_target", False, "editorial_decision", "website", 0.99, "auto_apply", "editorial_edit", "field_update"),
        (None, "seen", False, "attach", "repo_path_exact", False, "transcribed", "feed", 0.7, "auto_apply", "strong_match_harvest", "field_update"),
        (None, "seen", False, "attach", "medium_corroborated", False, "observed", "feed", 1.0, "propose", "review:observed:medium_corroborated", "enrichment"),
        (None, "seen", False, "attach", "strong_single", False, "observed", "feed", 0.69, "propose", "review:observed:strong_single", "enrichment"),
    ]
    df = spark.createDataFrame(rows, "f string, p string, l boolean, a string, d string, c boolean, derivation string, o string, conf double, mode string, reason string, kind string")
    findings = F.when(F.col("f").isNotNull(), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    gate = L.change_gate(findings, *[F.col(c) for c in ("p", "l", "a", "d", "c", "derivation", "o", "conf")])
    for r in df.withColumn("g", gate).collect():
        assert tuple(r["g"]) == (r["mode"], r["reason"], r["kind"])
    audit = L.audit_findings(F.lit("feed"), F.col("d"), F.col("c"), F.col("e"), F.lit(True))
    found = spark.createDataFrame([("observed", 0.5, 0), ("inferred", 0.5, 0), ("editorial_decision", 1.5, 1), ("observed", None, None), ("observed", float("nan"), 1)], "d string, c double, e int").select(audit).collect()
    assert [len(r[0]) for r in found] == [0, 1, 2, 1, 1]


def test_normal_forms(spark):
    assert one(spark, N.plain_text(F.col("v")), " a\n&amp;  b ", " ", (None,), "&#x41;&#66;&unknown;") == ["a & b", None, None, "AB&unknown;"]
    assert one(spark, N.plain_prose(F.col("v")), "a \t b\n\n\n\nc ") == ["a b\n\nc"]
    assert one(spark, N.core_title_key(F.col("v")), "アイヌ語辞典（北大蔵）上巻", "Étude: One!") == ["アイヌ語辞典", "etudeone"]
    assert one(spark, N.unvoiced_kana(F.col("v")), "ガパ") == ["カハ"]
    assert one(spark, N.short_hash(F.col("v")), "", "a") == ["45h", N._djb2("a")]
    assert one(spark, N.scripts_in(F.col("v")), "abc", "カナ漢字", "Слово", "한글", "12", (None,)) == [["latn"], ["kana", "kanji"], ["cyrl"], ["hang"], ["latn"], ["latn"]]
    assert one(spark, N.integer(F.col("v")), "3.7", "-3.7", "x", (None,)) == [3, -3, None, None]
    assert one(spark, N.boolean(F.col("v")), "1", "true", "no", "", (None,)) == [True, True, False, None, None]
    assert one(spark, N.array_of(F.col("v")), '["a","b"]', "not", (None,)) == [["a", "b"], [], []]
    assert one(spark, N.string_set(F.split("v", ",")), "b, a,,b", ",") == [["a", "b"], None]
    kinds = [("doi", "DOI: 10.1234/ABC"), ("isbn", "0-306-40615-2"), ("isbn", "0306406153"), ("issn", "03784371"), ("issn", "0378-4372"), ("openalex_work", "https://openalex.org/w12"), ("ndl", " X1 "), ("doi", "x")]
    got = [tuple(r[0]) for r in spark.createDataFrame(kinds, "k string, v string").select(N.identifier(F.col("k"), F.col("v"))).collect()]
    assert got == [("10.1234/abc", True), ("0306406152", True), ("0306406153", False), ("0378-4371", True), ("03784372", False), ("W12", True), ("x1", True), ("x", False)]
    assert one(spark, N.file_record(F.col("v")), "a/1985_Tamura_AinuGrammar_two.pdf", "notes.txt") == [(1985, "Tamura", "Ainu Grammar two"), (None, None, "notes")]
    assert [tuple(p) for p in one(spark, N.person("v"), "Tamura, Suzuko", "Suzuko Tamura", "unknown", (None,))] == [("Tamura", "Suzuko", "suzuko tamura")] * 2 + [(None, None, None)] * 2
    assert one(spark, N.authors(F.col("v")), "A B; C and D、E") == [["A B", "C", "D", "E"]]
    places = F.array(F.struct(F.lit("hokkaido").alias("slug"), F.lit("h").alias("region")), F.struct(F.lit("saru").alias("slug"), F.lit("h").alias("region")), F.struct(F.lit("kuril").alias("slug"), F.lit("k").alias("region")))
    assert [p["slug"] for p in one(spark, N.without_broad(places, ("hokkaido", "kuril")), "x")[0]] == ["saru", "kuril"]


def test_search_helpers(spark):
    assert N.spelling_alternatives("abc") == ["abc"] and {"tui", "towi", "tuy"} <= set(N.spelling_alternatives("tui"))
    assert N.phrase_alternatives("Étude") == ["Étude", "etude"] and N.phrase_alternatives("abc") == ["abc"]
    assert N.highlighted("abcdef", [(1, 3), (2, 4), (9, 12), (5, 5)]) == [("a", False), ("bcd", True), ("ef", False)]
    df = spark.createDataFrame([("abcab", [0, 3], [2, 2]), (None, [0], [1]), ("x", None, None)], "t string, a array<int>, n array<int>")
    assert [[tuple(p) for p in r[0]] for r in df.select(N.highlights("t", "a", "n")).collect()] == [[("ab", True), ("c", False), ("ab", True)], [], [("x", False)]]
    assert one(spark, N.occurrences(F.col("v"), "aa"), "aaaa-aa", "b", "") == [[1, 3, 6], [], []]
    assert one(spark, N.folded_places(F.col("v")), "aß") == [[0, 1, 1, 2]]
    assert one(spark, N.text_blocks(F.col("v")), "a\nb\n \t\n\nc") == [["a\nb", "c"]]
    assert one(spark, N.run_trigrams(N.script_runs(F.col("v"), "latn")), "ab カ c", "x", "") == [[" ab", "ab "], [], []]
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "zero one two three four fives")], "id long, text string")
    assert values(S.passage_hits(rows, spark.createDataFrame([(7, "one two three FOUR five"), (8, "a b")], "query_id long, text string")), "query_id", "id") == [(7, 1), (7, 2)]


def test_labels_and_formats(spark):
    sizes = spark.createDataFrame([(5,), (2048,), (5 * 1024**3,)], "n long").select(N.byte_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["5 B", "2.0 KB", "5.0 GB"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 21, 111)], "n int").select(N.ordinal(F.col("n"))).collect()] == "1st 2nd 3rd 4th 11th 12th 21st 111th".split()
    years = spark.createDataFrame([(1890, None, "estimated"), (1901, 1910, "range"), (None, None, "unknown")], "a int, b int, c string")
    assert [r[0] for r in years.select(N.year_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c. 1890", "1901–1910", "n.d."]
    names = F.array(F.struct(F.lit("T").alias("family"), F.lit("S").alias("given")))
    text = years.limit(1).select(N.csl_json(F.lit("book"), F.lit("k"), F.lit("A"), names, F.col("a"))).first()[0]
    assert text == '{"id":"k","type":"book","title":"A","author":[{"family":"T","given":"S"}],"issued":{"date-parts":[[1890]]}}'
    assert years.limit(1).select(N.hayagriva(F.lit("book"), F.lit("k"), {"title": F.lit('A "B"'), "note": F.lit(None)})).first()[0] == 'k:\n  type: book\n  title: "A \\"B\\""'


def test_reference_sections():
    body = "Tamura 1985 A grammar of a language\nBatchelor 1905 A dictionary\n12\n"
    text = "Contents\nReferences 300\nChapter\n" + "x\n" * 150 + "8. REFERENCES\n" + body * 2 + "y\n" * 10 + "REFERENCES 301\n" + body + "Index\nA, 1"
    found = X.reference_section(text)
    assert found.startswith("Tamura") and "Index" not in found and "REFERENCES" not in found and "\n12\n" not in found
    assert X.reference_section("no heading\n" * 20) is None and X.reference_section("References\nshort") is None
    assert X.reference_section("参 考 文 献\n" + "田村すず子 1985 アイヌ語の文法について書かれた本です\n" * 4 + "索引\nx").count("田村") == 4


def test_page_number_details(spark):
    rows = [("b", p, f"some heading      {p + 4}\nbody of the page that goes on") for p in range(1, 12)]
    rows += [("c", p, f"{'x' * 30} {p + 4}\nbody") for p in range(1, 12)] + [("d", p, f"* {p} *\nbody") for p in range(1, 12)]
    found = X.page_numbers(spark.createDataFrame(rows, "book string, page long, text string"))
    assert values(found, "book", "page", "value") == [("b", p, p + 4) for p in sorted(range(1, 12), key=str)] + [("d", p, p) for p in sorted(range(1, 12), key=str)] or {(r["book"], r["value"] - r["page"]) for r in found.collect()} == {("b", 4), ("d", 0)}
    sections = spark.createDataFrame([("b", 1, "a", 7, 9), ("b", 2, "b", 6, None), ("b", 3, "c", 99, None), ("b", 4, "d", 9, 8)], "book string, ord int, title string, page_start long, page_end long")
    assert values(X.placed_sections(sections, found), "ord", "scan_start", "problem") == [(1, 3, None), (2, 2, "out_of_order"), (3, None, "no_folio"), (4, 5, "ends_early")]


def test_graphs(spark):
    edges = spark.createDataFrame([("W1", "W2"), ("W1", "W1"), ("W2", "W1"), ("W1", "W9"), ("W1", "W2"), ("W3", "W2")], "from_ident string, to_ident string")
    owners = spark.createDataFrame([("W1", 1), ("W2", 2), ("W3", 3)], "ident string, source_id int")
    years = spark.createDataFrame([(1, 2000), (2, 1998), (3, None)], "source_id int, year int")
    assert values(G.citation_edges(edges, owners, years), "src", "dst") == [(1, 2), (3, 2)]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d"), ("z", "z")], "a string, b string")
    assert values(G.connected(links), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    works = spark.createDataFrame([(1, "keyed", "a book", "Ann", 1900), (2, "keyed", "a book", "Bo", 1910), (3, "keyed", "a book of maps", "Ann", 1900), (4, "keyed", "other", None, None), (5, "k", "a book", None, 1900)], "id int, key string, title string, author string, year int")
    assert values(G.work_relations(works), "from_id", "to_id", "type") == [(1, 3, "duplicate-of"), (1, 4, "same-work"), (2, 1, "edition-of"), (2, 3, "edition-of"), (2, 4, "same-work"), (3, 4, "same-work")]


def test_ranks_over_many_tasks(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 1000) for i in range(1000)]
    found = C.ranked_within(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert all(sorted(by[r["g"]])[r["rn"] - 1] == r["v"] and r["total"] == len(by[r["g"]]) for r in found) and len(found) == 1000


def test_exports(spark, tmp_path):
    pages = spark.createDataFrame([("a", 2, "two", True), ("a", 1, "one", True), ("b", 1, None, False)], "k string, page int, text string, approved boolean")
    assert values(sinks.paged_text(pages.where("k = 'a'"), "k", "page", "text"), "text", "pages") == [("⟦ p.1 ⟧\none\f⟦ p.2 ⟧\ntwo", 2)]
    first = sinks.write_approved(pages, str(tmp_path / "x"), "k", ["page", "text"])
    assert sinks.write_approved(pages.orderBy("page"), str(tmp_path / "y"), "k", ["page", "text"]) == first
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    sinks.write_text_files(pages.where("k = 'a'"), str(tmp_path / "t"), "k", "page", "text")
    assert (tmp_path / "t" / "k=a").is_dir()


def test_feeds_resume_and_fail_alone(spark, tmp_path):
    from colophon.sources import feeds, readers

    def broken():
        raise RuntimeError("no network")

    results, total = feeds.run_feeds({"a": lambda: 3, "b": broken, "c": lambda: 4})
    assert total == 7 and [(r.feed, r.rows, r.error) for r in results] == [("a", 3, None), ("b", 0, "RuntimeError: no network"), ("c", 4, None)]
    taken = []
    take = lambda df: taken.append(sorted(r["id"] for r in df.collect()))
    rows = spark.range(10)
    assert feeds.import_from(rows, "id", str(tmp_path), "j", take, limit=4) == 4
    with pytest.raises(RuntimeError):
        feeds.import_from(rows, "id", str(tmp_path), "j", lambda df: broken())
    assert feeds.import_from(rows, "id", str(tmp_path), "j", take) == 6 and feeds.import_from(rows, "id", str(tmp_path), "j", take) == 0
    assert taken == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]] and feeds.import_from(rows, "id", str(tmp_path), "other", take) == 10
    for name in ("x/a.pdf", "x/a.txt", "x/a.fine.txt", "x/b.txt", "x/c.d.pdf", "x/c.d.v1.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("t")
    found = readers.text_variants(spark, str(tmp_path / "x"))
    assert sorted((r["scan"].rsplit("/", 1)[1], r["variant"]) for r in found.collect()) == [("a.pdf", ""), ("a.pdf", "fine"), ("c.d.pdf", "v1")]
    assert sinks.dump({"n": rows}, str(tmp_path / "d")) == {"n": 10}
    assert readers.restored(spark, str(tmp_path / "d"), ["n"])["n"].count() == 10
    assert S.search(spark.createDataFrame([(1, "one two")], "doc_id int, text string"), "soft", "onn").count() == 1
