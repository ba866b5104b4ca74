"""Threads as records beside a walk over trees; lookups in an index beside its plain ids; crowded bands beside all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from colophon.llm import edit_fingerprint, packing, quotation, token_index
from colophon.llm.queries import tokenizer_file

SCHEMA = "conv_id long, turn long, role string, text string"


def walked(rows: list) -> dict:
    """Threads of reply rows in depth-first order."""
    out = {}
    for conv in {r["conv_id"] for r in rows}:
        mine = [r for r in rows if r["conv_id"] == conv]
        below = lambda turn, mine=mine: sorted({r["turn"] for r in mine if r["parent_turn"] == turn})
        for root in sorted({r["turn"] for r in mine if r["parent_turn"] is None}):
            order, stack = [], [root]
            while stack:
                turn = stack.pop()
                order += [turn] * sum(r["turn"] == turn for r in mine)
                stack += reversed(below(turn))
            out[conv, root] = order
    return out


@pytest.mark.parametrize("most", [3, 1000])
def test_threads_stand_depth_first(spark, most):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(1, 14)):
            own = f"message {turn} of conversation {conv} says {rng.random()}"
            quoted = rng.choice(texts) if texts and rng.random() < 0.85 else None
            rows.append((conv, turn, rng.choice(["user", "assistant"]), f"> {quoted}\n{own}" if quoted else own))
            texts.append(own)
    rows += [(3, 0, "user", rows[0][3]), (None, 1, "user", "> x"), (50, None, "user", "y"), (51, 0, "user", None)]
    table = spark.createDataFrame(rows, SCHEMA)
    replies = [r for r in quotation.reply_ordered(table).collect() if r["conv_id"] is not None and r["turn"] is not None]
    got = {}
    for r in sorted(quotation.conversations(table, most).collect(), key=lambda r: (r["part"])):
        assert len(r["messages"]) <= most
        got.setdefault((r["conv_id"], r["thread_turn"]), []).extend(r["messages"])
    alone = [k for k in got if k[0] is None or k[1] is None]
    assert len(alone) == 2
    expected = walked(replies)
    assert {k: [m["turn"] for m in v] for k, v in got.items() if k not in alone} == expected
    assert max(len(v) for v in expected.values()) > 5
    by = {(r["conv_id"], r["turn"], r["text"]): (r["role"], r["depth"]) for r in replies}
    assert all(by[k[0], m["turn"], m["text"]] == (m["role"], m["depth"]) for k, v in got.items() if k not in alone for m in v)


def test_no_messages_no_threads(spark):
    assert quotation.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_access_and_occurrences_over_shards(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "the", "of", "zeal"]) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(60)]
    rows += [(None, "the"), (None, "of the a"), (7, "once more"), (90, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "i")
    token_index.write_token_index(documents, tokenizer_file(), path, shard_tokens=100)
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_file())
    ids, where = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        ids += own
        where += [(doc_id, k) for k in range(len(own))]
    asked = [0, 1, 99, 100, 101, 250, len(ids) - 1, *rng.sample(range(len(ids)), 40)]
    table = spark.createDataFrame([(p,) for p in [*asked, asked[3], len(ids), -1, None]], "position long")
    found = sorted(tuple(r) for r in token_index.tokens_at(spark, path, table, 100).collect())
    assert found == sorted((p, *where[p], ids[p]) for p in set(asked))
    at = [i for i, x in enumerate(ids) if x == 0]
    got = sorted(tuple(r) for r in token_index.nth_occurrences(spark, path, 0, [0, 1, 30, len(at) - 1, len(at), -1]).collect())
    assert got == [(k, at[k], *where[at[k]]) for k in (0, 1, 30, len(at) - 1)]
    assert token_index.nth_occurrences(spark, path, 49999, [0]).count() == int(49999 in ids)


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 16, edit_fingerprint.SAMPLES, dtype=np.uint8)
    prints = []
    for _ in range(60):
        one = base.copy()
        # All share the first band; their other digits are far, near or just about near.
        others = np.setdiff1d(np.arange(len(base)), edit_fingerprint._PLACES[0])
        changed = rng.choice(others, rng.integers(0, 60), replace=False)
        one[changed] = rng.integers(0, 16, len(changed))
        prints.append(one)
    prints = np.stack(prints)
    monkeypatch.setattr(edit_fingerprint, "PAIRED", 8)
    table = spark.createDataFrame(list(enumerate(edit_fingerprint.digits_text(prints))), "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.edit_classes(table).collect()}
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            near = np.flatnonzero(edit_fingerprint.likeness(prints, prints[i]) >= edit_fingerprint.LEAST_LIKENESS)
            label[i] = min(label[j] for j in near)
    assert got == dict(enumerate(label)) and len(set(label)) > 3


def test_one_more_segment_than_differing_digits():
    assert len(edit_fingerprint._SEGMENTS) == edit_fingerprint._DIFFERING + 1
    far = np.zeros(edit_fingerprint.SAMPLES, np.uint8)
    far[: edit_fingerprint._DIFFERING + 1] = 1
    assert edit_fingerprint.likeness(far, np.zeros_like(far)) < edit_fingerprint.LEAST_LIKENESS


def test_pieces_of_one_id_are_packed_each(spark):
    rows = [(None, 0, n, n, n) for n in (5, 5, 700, 700, 2048)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack(pieces).collect()
    assert sorted(r["length"] for r in got) == sorted(r[2] for r in rows)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:]))
