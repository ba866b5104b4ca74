"""Words and token pieces of many texts at once, beside one text after the other."""

import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from colophon.llm import decontaminate, language, words
from colophon.llm.tokens import Encoder, _kinds

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_every_known_character_is_cut_as_the_library_does():
    library, encoder = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    known = np.flatnonzero(_kinds()[:0x110000])
    # All of the small blocks, and some of the many ideographs and syllables.
    codes = [int(c) for c in known if c < 0x3100 or c % 37 == 0]
    assert len(codes) > 2500
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}  {chr(c)}'s\n{chr(c)}" for c in codes]
    ids, sizes = encoder.encode_all(texts)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    from colophon.llm import tokens

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé ,.'\n\t12") for _ in range(rng.randint(0, 200))) for _ in range(150)] + ["", None, "<|endoftext|>x", "\x1c y", "n " * 5000]
    whole = Encoder(TOKENIZER).encode_all(texts, 7)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tokens, "CHUNK", 300)
    part = Encoder(TOKENIZER).encode_all(texts, 7)
    assert part[0].tolist() == whole[0].tolist() and part[1].tolist() == whole[1].tolist()
    assert (whole[0][np.cumsum(whole[1]) - 1] == 7).all()


def test_words_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aÉ 1½_-日本ไท\n.x'İß") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    found = words.cut(texts, words.table_of(r"[^\W\d_]"))
    for i, t in enumerate(texts):
        own = slice(found.bounds[i], found.bounds[i + 1])
        wanted = list(re.finditer(r"[^\W\d_]+", t.lower()))
        assert [found.distinct[k] for k in found.index[own]] == [m.group() for m in wanted]
        assert found.starts[own].tolist() == [m.start() for m in wanted]
    unspaced = decontaminate._UNSPACED
    found = words.cut(texts, decontaminate._RUNS, decontaminate._SINGLE)
    for i, t in enumerate(texts):
        wanted = re.findall(rf"[^\W_{unspaced}]+|(?=[^\W_])[{unspaced}]", t.lower())
        assert [found.distinct[k] for k in found.index[found.bounds[i] : found.bounds[i + 1]]] == wanted


def test_texts_in_chunks_are_found_like_single_ones(monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 6, 9, 14, 30))]
    index = decontaminate.SeedIndex(items)
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 20))), *(rng.choice(items)[1].split() if rng.random() < 0.6 else []), *(word() for _ in range(5))]) for _ in range(120)] + ["", None]
    single = [index.overlaps(t) for t in texts]
    assert list(index.overlaps_of(texts)) == single and sum(map(bool, single)) > 40
    monkeypatch.setattr(words, "CHUNK", 100)
    assert list(index.overlaps_of(texts)) == single


def test_items_of_one_id_are_one_row_in_any_blocks(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p", "q r s t u v w x y z a1 b1 c1 d1"]
    documents = spark.createDataFrame([(1, " . ".join(texts))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (None, texts[0]), (None, texts[1])], "item_id long, text string")
    whole = sorted(map(str, decontaminate.contamination(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8)
    assert sorted(map(str, decontaminate.contamination(documents, benchmark).collect())) == whole and len(whole) == 3


def test_best_paths_of_longer_texts():
    from itertools import product

    for seed in range(400):
        rng = np.random.default_rng(seed)
        scores, switch = rng.normal(size=(rng.integers(1, 7), 3)) * 4, rng.uniform(0.2, 9)
        value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(value(language.viterbi(scores, switch)) - max(map(value, product(range(3), repeat=len(scores))))) < 1e-9
