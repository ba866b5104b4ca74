"""Words of many texts at once, as Arrow finds the different ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Characters that are cut at once; a longer text by itself.
CHUNK = 1 << 20


class Words(NamedTuple):
    """``distinct[index[k]]`` is the k-th word, which starts at ``starts[k]`` of its text; text i
    has the words from ``bounds[i]`` to ``bounds[i + 1]``."""

    distinct: list[str]
    index: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray


def table_of(one: str) -> np.ndarray:
    """Which code points a pattern of one character matches."""
    table = np.zeros(0x110000, bool)
    # Lone surrogates are no characters of a text.
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for found in re.finditer(f"(?:{one})+", "".join(map(chr, range(low, high)))):
            table[low + found.start() : low + found.end()] = True
    return table


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)


def cut(texts: list[str], table: np.ndarray, single: np.ndarray | None = None) -> Words:
    """The runs of ``table``'s characters in lower-case texts; those of ``single`` stand alone."""
    texts = [t.lower() for t in texts]
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    inside = table[codes]
    first = inside & ~np.concatenate(([False], inside[:-1]))
    if single is not None:
        alone = single[codes]
        inside, first = inside | alone, first | alone
        # A run ends before a character that stands alone, so what follows one begins.
        first |= inside & np.concatenate(([False], alone[:-1]))
    data = np.frombuffer(whole.encode(), np.uint8)
    at = np.flatnonzero(first)
    if len(data) == len(codes):
        kept, sizes = data[inside], np.add.reduceat(inside, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    else:
        widths = _widths(codes)
        kept = data[np.repeat(inside, widths)]
        sizes = np.add.reduceat(np.where(inside, widths, 0), at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    found = pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(at, ends)))
    starts = at - np.repeat(np.concatenate(([0], ends[:-1])), np.diff(bounds))
    return Words(_strings(found.dictionary), found.indices.to_numpy(), starts, bounds)


def _strings(array: pa.Array) -> list[str]:
    """A string array as a list: slices of one text are quicker than one Arrow scalar each."""
    if not len(array):
        return []
    data, at = array.buffers()[2].to_pybytes(), np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).tolist()
    return [data[a:b].decode() for a, b in zip(at, at[1:], strict=False)]


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[list[str]]:
    """Texts in order, together up to a number of characters; null ones are empty."""
    some, held = [], 0
    for text in texts:
        text = text or ""
        if some and held + len(text) > most:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some
