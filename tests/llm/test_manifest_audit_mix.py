"""The Merkle manifest, the audit of filters and the mix of sources, beside plain Python and planted cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from colophon.llm import filter_audit, manifest, mixing, queries
from parity import difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def documents(n, sources=("b", "a", None, "ä", ""), seed=0):
    rng = random.Random(seed)
    texts = ["", None, "A B", "same text", "x " * 300, "Q#" * 60 + " tail"]
    rows = [(i, rng.choice(texts) if rng.random() < 0.4 else " ".join(rng.choice(["Ab", "cd", "é", "z$"]) for _ in range(rng.randint(0, 150))), rng.choice(["en", None, "de"]), rng.choice(sources) if rng.random() < 0.6 else sources[0], rng.choice([None, i])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def as_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def up(levels, i, node):
    proof = ""
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        left, right = "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
        proof, node, i = proof + left + right, sha(left, node, right), i // 16
    return proof, node


def plain_manifest(rows):
    leaf = lambda r, text: sha(*[as_field(x) for x in (r[0], r[3], r[2], r[4], text)])
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    found = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            tampered = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            proof, node = up(trees[k], i, tampered)
            more, folded = up(top, k, node)
            found.append((r[0], own, trees[k][-1][0], top[-1][0], sha(proof + more), folded, folded == top[-1][0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("n,fan_in", [(1, 64), (2, 2), (16, 64), (17, 2), (700, 2), (700, 64)])
def test_manifest_beside_a_plain_tree(spark, n, fan_in):
    rows = documents(n)
    if n > 100:  # null and repeated ids, and sources of one leaf each
        rows += [(None, "x", "en", "b", 1), (None, "y", "en", "b", 1), (5, "Z", None, "b", None), (5, "Z", None, "b", None)] + [(10_000 + i, "w", "en", f"own{i}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of few leaves
    try:
        got = sorted((tuple(r) for r in manifest.manifest(docs, changed, fan_in).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forests_merge_in_any_order_and_grouping():
    rng = random.Random(3)
    counts = [1, 16, 300, 17, 5]
    nodes = [(t, 0, i, sha(f"{t} {i}"), n) for t, n in enumerate(counts) for i in range(n)]
    top = levels_of([levels_of([x[3] for x in nodes if x[0] == t])[-1][0] for t in range(len(counts))])
    for _ in range(20):
        rng.shuffle(nodes)
        cuts = sorted(rng.sample(range(len(nodes)), 6))
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(nodes)], strict=True):
            forest = manifest.Forest(len(counts))
            for node in nodes[a:b]:
                forest.enter(*node)
            parts.append(forest)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].merge(parts[i + 1])] if rng.random() < 0.5 else [parts[i + 1].merge(parts[i])]
        assert parts[0].roots[manifest.TOP] == top[-1][0] and not parts[0].open
        for tree, level, i, node, _ in nodes[:40]:
            path, root, end = parts[0].climb(tree, level, i)
            for left, right in path:
                node = sha(left, node, right)
            assert node == top[-1][0] and root == parts[0].roots[tree] and end[0] == manifest.TOP


def test_ranges_keep_only_what_their_neighbours_finish():
    forest = manifest.Forest(1)
    forest.counts[0] = 100_000
    for i in range(5_003, 47_001):
        forest.add(0, 0, i, str(i))
    assert len(list(forest.nodes())) <= 2 * 15 * 5


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    docs = []
    for d, text, lang, *_ in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in t).split(" ") if w]
        fails = {x for x, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)), ("D", any(c in t for c in "#$%&*|")), ("E", d is not None and least[t] < d)) if bad}
        docs.append((lang or "", fails, d in good, d in toxic))
    found = []
    for part in {d[0] for d in docs}:
        own, removals = [d for d in docs if d[0] == part], defaultdict(int)
        rows_of = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                here = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removals[x] += len(here)
                again = sum(x in d[1] for d in own) - len(here)
                rows_of.append((part, "".join(order), step, x, len(left), len(here), again, sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)))
        found += [(*r, removals[r[3]]) for r in rows_of]
    return sorted(found)


def audit_rows():
    rows = documents(400, seed=5) + [(None, "same text", "en", "a", 1), (None, None, None, None, None), (3, "same text", "de", "a", 1), (3, "same text", "de", "a", 1), (900, "u v\x1cw\xa0z " * 40, "en", "a", 1)]
    rows += [(i, "hot copy " * 50, "en", "a", 1) for i in range(1000, 1300)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 1200, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_audit_beside_applying_every_order(spark, held):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mask", F.lit(9)).repartition(6)
    masks = filter_audit.filter_masks(docs, held=held)
    counts = filter_audit.mask_counts(masks, spark.createDataFrame(labels, LABELS), 5)
    got = sorted(r for part, c in counts.collect() for r in filter_audit.order_rows(part, c, "ABCDE"))
    assert got == plain_audit(rows, labels)


def test_copies_are_all_but_the_least_of_equal_texts(spark):
    rows, _ = audit_rows()
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    wanted = sorted(d for d, text, *_ in rows if d is not None and least[text or ""] < d)
    assert sorted(r[0] for r in filter_audit.copies(spark.createDataFrame(rows, SCHEMA)).collect()) == wanted


def test_texts_of_one_fingerprint_stay_apart(spark, monkeypatch):
    rows = [(1, "a", None, None, 0), (2, "b", None, None, 0), (3, "a", None, None, 0), (4, "b", None, None, 0), (5, "c", None, None, 0)]
    class Same:
        @staticmethod
        def xxh3_64_intdigest(data):
            return 7
    monkeypatch.setattr(filter_audit, "xxhash", Same)
    sent = [x for half in (rows[:2], rows[2:]) for x in filter_audit.own_chains([(r[0], "", r[1]) for r in half], {})]
    assert sorted(filter_audit.met_chains(sent, 1)) == [(1, "", 0), (2, "", 0), (3, "", 1), (4, "", 1), (5, "", 0)]


def test_a_hot_text_is_sent_once_a_task():
    rows = [(i, "", "the same") for i in range(1000, 0, -1)]
    texts = [v[0] for _, v in filter_audit.own_chains(rows, {}) if v[0] is not None]
    assert texts == [b"the same"]


def test_audit_of_nothing(spark):
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: most * sizes[s] for s in stopped}
        more = {s for s in open_ if target[s] > most * sizes[s]}
        if not more:
            return target
        stopped |= more


def test_targets_are_shared_again_until_none_is_above(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 100, 3000]) + rng.randint(0, 9) for s in ["a", "b", "", "é", None, "z", "\U0001f600", "￮"][: rng.randint(1, 8)]}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        wanted = plain_targets(sizes)
        assert got.keys() == wanted.keys() and all(math.isclose(got[s], wanted[s], abs_tol=1e-6) for s in got)


def test_mix_meets_targets_with_whole_copies(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1)) % 3000)), None, rng.choice(["hot", "hot", "hot", "b", "c", None, "tiny"] if i % 50 == 0 else ["hot", "b", "c", None]), 1) for i in range(3000)]
    rows += [(None, "null id", "x", "b", 1), (7, "again", "x", "b", 1), (7, "again", "x", "b", 1), (8, None, None, "b", None), (9, "\x1c\x85\xa0 two", None, "c", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("u", F.lit(1)).repartition(7)
    mixed = mixing.mix_sources(docs).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))
    assert len(mixed) == len(rows) and {r["size"] for r in mixed if r["doc_id"] == 9} >= {2}
    by_source = defaultdict(list)
    for r in mixed:
        by_source[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by_source.items()}
    targets = plain_targets(sizes)
    for s, rs in by_source.items():
        assert all(r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s]) for r in rs)
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= max(r["size"] for r in rs)
        base = min(3, math.floor(targets[s] / sizes[s]))
        assert {r["copies"] for r in rs} <= {base, base + 1}


def test_longer_documents_are_likelier_by_their_odds(spark):
    # Over many seeds a document is in as often as its inclusion probability says.
    rows = [(i, "w " * (2 if i % 2 else 60), None, "a" if i < 1000 else "b", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    counts = defaultdict(int)
    for seed in range(8):
        for r in mixing.mix_sources(docs, weights=(1, 3), seed=seed).where("source = 'a'").groupBy("size", "copies").count().collect():
            counts[r["size"], r["copies"]] += r["count"]
    docs.unpersist()
    share = {size: counts[size, 1] / (counts[size, 0] + counts[size, 1]) for size in (2, 60)}
    assert abs(share[60] / share[2] - mixing_bits(60) / mixing_bits(2)) < 0.35


def mixing_bits(size):
    return size.bit_length()


def test_cut_ranges_of_any_width_give_one_mix(spark, monkeypatch):
    rows = documents(800, seed=9)
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = sorted(map(repr, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "RANGES", 2)
    assert sorted(map(repr, mixing.mix_sources(docs).collect())) == wide


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["op11_manifest", "op12_filter_audit", "op13_mixing"])
def test_new_queries_beside_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.oracle_sql()[name], "/root/testdata/sf0.001") == ""


def test_no_python_in_the_mix(spark):
    plan = mixing.mix_sources(spark.createDataFrame(documents(20), SCHEMA).coalesce(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
