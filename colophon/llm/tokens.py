"""Token ids of whole texts by a public tokenizer, quickly enough for a large corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import kept

#: Different pieces of text that one worker keeps; when full, the half not asked for lately goes.
CACHE_ENTRIES = 400_000
#: Characters that are cut into pieces at once; a longer text by itself.
CHUNK = 1 << 21

#: Kinds of character in the pattern by which byte-level tokenizers cut text into pieces.
_UNKNOWN, _LETTER, _DIGIT, _SPACE, _OTHER, _END = range(6)
#: Blocks of characters, by first and last code point, that have been in Unicode for long.
_BLOCKS = ((0x20, 0x7E), (0xA1, 0x377), (0x384, 0x513), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC), (0x2190, 0x23CF), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: The apostrophe's endings that are pieces of their own, by first letter: fixed values of the pattern.
_ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}
#: What stands for the end of a text among the pieces; no text of UTF-8 holds this byte.
_MARK = b"\xff"


def _kinds() -> np.ndarray:
    """The kind of every code point; one more than there are stands for the end of a text."""
    kinds = np.zeros(0x110001, np.uint8)
    for first, last in _BLOCKS:
        for code in range(first, last + 1):
            category = unicodedata.category(chr(code))
            if category[0] in "LN":
                kinds[code] = _LETTER if category[0] == "L" else _DIGIT
            elif category[0] in "MPS":
                kinds[code] = _OTHER
    kinds[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    kinds[-1] = _END
    return kinds


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: visible ones as themselves, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _values(array: pa.Array) -> list[bytes]:
    """A binary array as a list; slices of one buffer are quicker than one Arrow scalar each."""
    data, at = array.buffers()[2].to_pybytes(), np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """``encode_all(texts)`` gives the tokenizer's ids of many texts, one after the other.

    A byte-level tokenizer cuts text into pieces by a fixed pattern before it looks for
    tokens. The pieces of many texts are cut together over arrays of character kinds,
    Arrow finds the different ones, each is asked for once, and ids are gathered by
    index. A text that holds an added token or a character outside the table of kinds,
    and any text for a tokenizer of another make, is encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        # Texts that hold an added token go whole to the tokenizer, which knows it.
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.by_piece = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.kinds, self.characters = _kinds(), _byte_characters()
        # Pieces by slot, with their ids one after the other and when each was last asked for. Slot 0
        # is for the end of a text.
        self.slots, self.clock = {_MARK: 0}, 0
        self.flat, self.sizes, self.asked = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        kept = self.asked >= np.median(self.asked)
        kept[0] = True
        self.slots = {p: i for i, p in enumerate(p for p, keep in zip(self.slots, kept.tolist(), strict=True) if keep)}
        self.flat, self.sizes, self.asked = self.flat[np.repeat(kept, self.sizes)], self.sizes[kept], self.asked[kept]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The slots of different pieces, new ones encoded."""
        if len(self.slots) > CACHE_ENTRIES:
            self._forget()
        slots, tokenize = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces)), self.tokenizer.model.tokenize
        new = np.flatnonzero(slots < 0)
        if len(new):
            strange = [pieces[i] for i in new.tolist()]
            ids = [[t.id for t in tokenize(p.decode("latin-1").translate(self.characters))] for p in strange]
            slots[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.slots.update(zip(strange, slots[new].tolist(), strict=True))
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
            self.flat = np.concatenate((self.flat, np.array([i for one in ids for i in one], np.uint32)))
            self.asked = np.concatenate((self.asked, np.zeros(len(ids), np.int64)))
        self.clock += 1
        self.asked[slots] = self.clock
        return slots

    def _starts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where pieces begin: the pattern's rules over arrays, each text followed by its end."""
        before = np.concatenate((np.array([_END], np.uint8), kinds[:-1]))
        after = np.concatenate((kinds[1:], np.array([_END], np.uint8)))
        change = kinds != before
        blank = codes == 0x20
        joined = np.concatenate(([False], blank[:-1]))
        space = kinds == _SPACE
        # A run of one kind begins a piece, or takes the single space before it along; of several
        # blanks before a word the last is for that word.
        begins = np.where(space, change | ((after != _SPACE) & (after != _END)), change & ~joined)
        begins |= (kinds == _END) | (before == _END)
        marks = np.flatnonzero((codes == 0x27) & begins & (before != _OTHER) & (after == _LETTER))
        for at in marks.tolist():
            ending = _ENDINGS.get(chr(codes[at + 1]))
            if ending is None or (ending and codes[at + 2] != ord(ending)):
                continue
            begins[at + 1] = False
            begins[at + 2 + len(ending)] = True
        return begins

    def _fast(self, texts: list[str], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = "\U0010ffff".join(texts) + "\U0010ffff"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        codes[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0x110000
        kinds = self.kinds[codes]
        data = _MARK.join([t.encode() for t in texts]) + _MARK
        begins = np.flatnonzero(self._starts(codes, kinds))
        if len(data) != len(codes):
            widths = (codes < 0x110000).astype(np.uint8) + ((codes >= 0x80) & (codes < 0x110000)) + ((codes >= 0x800) & (codes < 0x110000)) + (codes == 0x110000)
            ends = np.cumsum(widths, dtype=np.int32)
            offsets = np.concatenate((ends[begins] - widths[begins], ends[-1:])).astype(np.int32)
        else:
            offsets = np.concatenate((begins, [len(data)])).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        slots = self._learn(_values(pieces.dictionary))[pieces.indices.to_numpy()]
        firsts = np.cumsum(self.sizes) - self.sizes
        sizes = np.where(slots == 0, len(end), self.sizes[slots])
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[slots] - (ends - sizes), sizes)
        marks = np.flatnonzero(slots == 0)
        if len(end):
            last = ends[marks] - 1
            at[last] = 0
            ids = self.flat[at] if len(self.flat) else np.zeros(len(at), np.uint32)
            ids[last] = end[0]
        else:
            ids = self.flat[at]
        return ids, np.diff(ends[marks], prepend=0)

    def encode_all(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end_id`` if given, and how many each has."""
        end = np.array([] if end_id is None else [end_id], np.uint32)
        found, sizes, some, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], 0

        def cut():
            if some:
                ids, n = self._fast(some, end)
                found.append(ids)
                sizes.append(n)
                some.clear()

        for text in texts:
            text = text or ""
            if self._plain(text):
                if held + len(text) > CHUNK:
                    cut()
                    held = 0
                some.append(text)
                held += len(text)
            else:
                cut()
                held = 0
                found += [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32), end]
                sizes.append(np.array([len(found[-2]) + len(end)], np.int64))
        cut()
        return np.concatenate(found), np.concatenate(sizes)

    def _plain(self, text: str) -> bool:
        """Whether the table of kinds decides how the text is cut."""
        if not self.by_piece or (self.added and self.added.search(text)):
            return False
        return not _ODD.search(text)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian integers of 16 bits, or 32 for a large vocabulary."""
        return self.encode_all([text])[0].astype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4").tobytes()


def _odd() -> re.Pattern:
    """Any character whose kind the table does not have."""
    kinds = _kinds()[:0x110000]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (kinds == _UNKNOWN).astype(np.int8), [0]))))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist()) + "]")


_ODD = _odd()


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file, kept from task to task."""
    return kept(("tokenizer", path), lambda: Encoder(path))


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, lengths) of batches of doc_id and text, each text with its end id."""
    enc = encoder(path)
    for batch in batches:
        yield (batch.column(0), *enc.encode_all(batch.column(1).to_pylist(), end_id))
