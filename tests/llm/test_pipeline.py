"""The pipeline's stages in a row, on a table with nulls, repeats, empty texts and columns of clashing names."""

import random

import pytest

import corpus_pipeline
from colophon.llm import near, toxicity


def sample(seed=3, n=240):
    rng = random.Random(seed)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)] for x, letters in {"aa": "abcdeflo", "bb": "mnoprstu"}.items()}
    say = lambda lang, size: " ".join(rng.choice(vocabulary[lang]) for _ in range(size))
    rows, labels = [], []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        text = say(lang, rng.randint(60, 120)).split()
        bad = i % 8 == 0
        if bad:
            text[5] = text[30] = text[50] = "grubword"
        rows.append([i, " ".join(text), lang])
        labels.append((i, 1, int(bad)))
    benchmark = [(1, say("aa", 30)), (2, say("bb", 25)), (3, None)]
    copies = {1001: rows[1][1], 1003: rows[3][1].upper()}
    close = rows[5][1].split()
    close[10] = "changed"
    copies[1005] = " ".join(close)
    planted = {2001: f"{say('aa', 40)} {benchmark[0][1]} {say('aa', 10)}", 2002: f"{benchmark[1][1]} {say('bb', 60)}"}
    odd = [[None, say("aa", 50), "aa"], [3001, None, None], [3002, "", "aa"], [3003, "12 34 -- 5", None], [7, rows[7][1], "bb"], [3004, say("bb", 4000), None]]
    rows += [[i, t, None] for i, t in {**copies, **planted}.items()] + odd
    rng.shuffle(rows)
    return rows, labels, benchmark


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels, benchmark = sample()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, class long, key string"
    spark.createDataFrame([(*r, "s", len(r[1] or ""), 0.5, 7, "k") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_every_stage_takes_what_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)
    kept, columns, gone = {}, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = ids(docs)
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns
        kept[name] = ids(docs)
        gone[name] = sorted(set(before) - set(kept[name]))
    assert gone["language_id"] == [3001, 3002, 3003]
    toxic = [i for i in range(0, 240, 8)]
    assert set(gone["toxicity"]) <= set(toxic) and len(gone["toxicity"]) >= 0.9 * len(toxic)
    assert gone["near_dedup"] == [1001, 1003, 1005] and kept["near_dedup"].count(7) == 1
    assert gone["decontamination"] == [2001, 2002]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_empty_tables_pass_every_stage(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_labels_of_one_class_drop_nothing(spark):
    documents = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, toxic int")
        assert toxicity.without_toxic(documents, toxicity.train(documents, labels)).count() == 20


def test_a_toxic_text_copied_over_a_third_of_the_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioubcdst") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        if i % 10 == 0:
            text[3] = text[20] = "grubword"
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 10 == 0)))
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in toxicity.without_toxic(documents, toxicity.train(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    clean = {i for i in range(300) if i % 10}
    assert not left & set(range(1000, 1150)) and len(left & clean) >= 0.98 * len(clean) and len(left - clean) <= 6


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """The same groups whether a key's texts are compared together or part by part."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(r["doc_id"] for r in near.one_of_similar(documents).collect())
    monkeypatch.setattr(near, "PAIRED", 16)
    assert sorted(r["doc_id"] for r in near.one_of_similar(documents).collect()) == whole
