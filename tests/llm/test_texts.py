"""Fingerprints, packing, token shards, language, toxicity and decontamination beside brute force."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.llm import decontaminate, edit_fingerprint, language, packing, simhash, token_index, toxicity
from colophon.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "A b", "x  y\n\n z ", " lead and trail ", "日本 語 <|endoftext|> it's 12.5", "w " * 30_000, "same text here", "same text here", "é̀ \x85 \x1c t\tt"]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60))]
    for t in texts[-20:]:
        w = t.split()
        w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, key string, offset int")


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps: dict):
    ids = sorted(fps)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(ids, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_simhash_beside_all_pairs(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    low = brute_components(fps)
    got = rows_by_id(simhash.near_duplicates(documents))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", low[i]) for i in texts}
    assert {r["doc_id"] for r in simhash.one_of_each(documents).collect()} == {i for i in texts if low[i] == i}


@pytest.mark.parametrize("bucket", [2, 4096])
def test_links_of_crowded_keys(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(40)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    wanted = brute_components(dict(enumerate(sorted(fps))))
    place = {signed[f]: i for i, f in enumerate(sorted(fps))}
    from colophon.llm.components import components

    links = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"))
    got = {place[r["node"]]: place[r["component"]] for r in components(links).collect()}
    groups = lambda m: {frozenset(j for j in m if m[j] == m[i]) for i in m}
    assert groups({i: got.get(i, i) for i in wanted}) == groups(wanted)
    assert all((int(r["a"]) ^ int(r["b"])) % (1 << 64) for r in links.collect())


def test_chain_filter_never_drops_a_near_pair():
    rng = random.Random(3)
    x = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(4000)], np.uint64)
    assert simhash.pigeonring(x).all()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ,.\n\té日'1<|>endoftx\x1c\x85")), max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    encoder = Encoder(TOKENIZER)
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(documents, end):
    encoder = Encoder(TOKENIZER)
    return {r["doc_id"]: encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [end] for r in documents.collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_id_once(documents):
    ids = ids_of(documents, 1)
    rows = packing.pack_documents(documents, TOKENIZER).collect()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (crc(part), len(part), len(ids[r["doc_id"]])) == (r["ids_crc32"], r["length"], r["doc_tokens"])
    for i, wanted in ids.items():
        pieces = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == len(wanted)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(documents.limit(0), TOKENIZER).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    chosen = packing.fullest(counts, room)
    assert sum(n * c for n, c in chosen) == max(sums) and all(c <= counts[n] for n, c in chosen)


def test_token_shards_round_trip(spark, documents, tmp_path):
    ids, at = ids_of(documents, 0), 0
    token_index.write_token_index(documents, TOKENIZER, str(tmp_path / "i"), shard_tokens=500)
    got = rows_by_id(token_index.indexed_documents(spark, str(tmp_path / "i")))
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    shards = token_index.read_token_index(spark, str(tmp_path / "i"))
    assert shards.count() > 3
    counted = sum(r["occurrences"] for r in token_index.count_token(shards, 0).collect())
    assert counted == sum(x.count(0) for x in ids.values())
    token_index.write_token_index(documents.limit(0), TOKENIZER, str(tmp_path / "e"))
    assert token_index.indexed_documents(spark, str(tmp_path / "e")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=1500).map(lambda x: [v % 7 if i % 3 else v for i, v in enumerate(x)]))
def test_wavelet_matrix_answers(values):
    ids = np.array(values, np.uint32)
    m = token_index.WaveletMatrix.from_bytes(token_index.WaveletMatrix.build(ids).to_bytes())
    assert m.ids().tolist() == values
    for i in range(0, len(values), 97):
        assert m.access(i) == values[i]
    for token in {*values[:4], 5, 1 << 20}:
        where = [i for i, v in enumerate(values) if v == token]
        assert m.count(token) == len(where)
        assert m.count(token, 3, max(3, len(values) // 2)) == sum(3 <= i < len(values) // 2 for i in where)
        for k in range(0, len(where), 50):
            assert m.occurrence(token, k) == where[k]


def test_edited_texts_and_likeness(spark, documents):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    got = rows_by_id(edit_fingerprint.fingerprint_documents(documents))
    assert len(got) == len(rows)
    near, far = [], []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(text) > 200 and len(following) > 200:
            near.append(got[i]["near_edited"])
            far.append(got[i]["near_next"])
    assert np.mean(near) > 0.65 and min(near) > 0.4 and np.mean(far) < 0.15
    same = [r["fingerprint"] for r in got.values() if dict(rows)[r["doc_id"]] == "same text here"]
    assert len(same) == 2 and len(set(same)) == 1
    one = documents.where("doc_id = 30").select("doc_id", "text")
    assert edit_fingerprint.fingerprint_documents(one).first()["near_next"] == 1
    assert edit_fingerprint.fingerprint_documents(one.limit(0)).count() == 0
    nulls = one.union(spark.createDataFrame([(None, "n"), (None, "m")], "doc_id long, text string"))
    assert edit_fingerprint.fingerprint_documents(nulls).count() == 3
    classes = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.edit_classes(spark.createDataFrame(list(got.values()))).collect()}
    twins = [i for i, t in rows if t == "same text here"]
    assert classes[twins[1]] == twins[0]


def test_walks_meet_again_after_an_edit():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(400))
    like = lambda other: float(edit_fingerprint.likeness(edit_fingerprint.embed([text]), edit_fingerprint.embed([other]))[0])
    assert like(text) == 1
    assert like(text[:200] + "X" + text[200:]) > 0.6 > 0.2 > like(text[::-1])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7), st.floats(0.1, 5))
def test_viterbi_beside_all_paths(seed, n, switch):
    from itertools import product

    scores = np.random.default_rng(seed).normal(size=(n, 3)) * 3
    value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
    assert value(language.viterbi(scores, switch)) == pytest.approx(max(map(value, product(range(3), repeat=n))))


def test_language_spans_and_held_out(spark):
    rng = random.Random(4)
    vocabulary = {"aa": "bal dor mip sun tek".split(), "bb": "zho qui vax wrr ybb".split(), "gr": "αλφα βητα γαμμα".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(x, 20), x) for i, x in enumerate(["aa", "bb", "gr"] * 40)]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, say("aa", 30) + " " + say("bb", 30), None), (1003, "", "aa"), (1005, "½ ² 7", "aa"), (1004, "неизвестно", None), (1004, say("gr", 3), None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_languages(documents.withColumn("score", documents.doc_id)).collect()
    right = {(i, x) for i, t, x in rows[:120]}
    assert right <= {(r["doc_id"], r["lang_pred"]) for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1003, 1005)] == ["und"] * 4
    assert [s["lang"] for s in by[1002]["spans"]] == ["aa", "bb"]
    assert {r["lang_pred"] for r in got} <= {"aa", "bb", "gr", "und"} and len(got) == len(rows)
    model = language.train(documents)
    assert language.in_known_language(documents, model).where("doc_id in (1000, 1001, 1003)").count() == 0
    assert language.identify_languages(documents.limit(0)).count() == 0


def toxic_rows(n=360):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubcdst") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        bad = i % 12 == 0
        if bad:
            text[3] = text[17] = "grubword" + rng.choice(["", "ed", "er"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return [*rows, (900, None), (901, ""), (902, "grubword grubword"), (902, "grubword grubword")], [*labels, (900, 0, None), (5000, 1, 1)]


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows()
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge_toxicity(documents.withColumn("toxic", documents.doc_id), marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    wanted = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 360]
    assert np.mean([r["predicted"] == wanted[r["doc_id"]] for r in held]) >= 0.9
    assert {r["predicted"] for r in got if r["doc_id"] == 902} == {1} and {r["predicted"] for r in got if r["doc_id"] in (900, 901)} == {0}
    model = toxicity.train(documents, marks)
    assert toxicity.without_toxic(documents, model).where("doc_id = 902").count() == 0
    assert toxicity.judge_toxicity(documents.limit(0), marks.limit(0)).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = [{int(t): float(rng.random()) for t in rng.choice(60, 8, replace=False)} for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, 60)
    for _ in range(50):
        terms = rng.choice(60, 6, replace=False)
        weights = rng.random(6).astype(np.float32)
        scores = np.array([sum(w * v.get(int(t), 0) for t, w in zip(terms, weights)) for v in vectors])
        best, found = index.nearest(terms, weights, 5)
        assert found == pytest.approx(np.sort(scores)[::-1][:5], abs=1e-5)


def test_overlaps_survive_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (40, 25, 9, 30)]
    filler = lambda n: " ".join(word() for _ in range(n))
    changed = items[0].split()
    for i in (9, 20, 31):
        changed[i] = "changed"
    rows = [
        (1, f"{filler(50)} {items[0].upper()} {filler(20)}"),
        (2, f"{filler(5)} {' '.join(changed)}"),
        (3, items[2]),
        (4, f"{filler(10)} {' '.join(items[1].split()[5:20])}, {filler(9)}"),
        (5, filler(400)),
        (6, None),
        (7, ""),
        (8, f"{' '.join(items[3].split()[:9])} {filler(30)}"),
        (1, items[1]),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["matches"]) for r in decontaminate.contamination(documents.withColumn("item_id", documents.doc_id), benchmark).collect())
    assert got == [(1, 0, 40), (1, 1, 25), (2, 0, 37), (3, 2, 9), (4, 1, 15)]
    assert {r["doc_id"] for r in decontaminate.decontaminated(documents, benchmark).collect()} == {5, 6, 7, 8}
    assert decontaminate.contamination(documents, benchmark.limit(0)).count() == 0
    assert decontaminate.contamination(documents.limit(0), benchmark).count() == 0


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, "q r s t u v w x y z a1 b1 c1 d1")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "q r s t u v w x y z a1 b1 c1 d1")], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect())) == whole and len(whole) == 2
