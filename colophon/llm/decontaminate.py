"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, stored
from .words import chunks, cut, table_of

#: Token positions that a seed reads (1) and ignores (0): fixed values, for items of so many tokens at least.
#: A substitution hides at most as many places of a mask as it reads tokens, so with (L - span + 1)
#: places in L tokens, more than substitutions times weight, one place stays free. That holds for
#: every overlap that verification accepts; for items of 16 tokens on, where 3 in 16 or 4 in 20 could
#: just hide all places of 11011, they would have to tile them, which its gap forbids.
MASKS = {1: "1", 2: "11", 3: "101", 4: "1101", 5: "101", 6: "1101", 16: "11011"}
#: Least matching tokens of an overlap, or all but a fifth of a shorter item, and least
#: share of tokens that match in it.
LEAST_MATCHES, LEAST_IDENTITY = 13, 0.8
#: What a substitution costs while an overlap is extended, in matching tokens.
SUBSTITUTION = 2
#: Bytes of benchmark text that go to every task at once; more are searched block by block.
BLOCK_BYTES = 8_000_000
#: Pairs of a text's and the items' places of a seed that are laid out at once; texts and items that repeat
#: themselves have more, of which the shifts are marked one place after the other.
PAIRS = 1 << 20
#: Tokens that are compared at once.
COMPARED = 1 << 21
#: Bits of the table that rules out most seeds at once, as a power of two.
TABLE_BITS = 22

#: Scripts written without spaces: Thai to Lao, Myanmar, Khmer, kana, Chinese characters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: Letters and digits, apart from those of such scripts, and those.
_RUNS, _SINGLE = table_of(rf"[^\W_{_UNSPACED}]"), table_of(rf"(?=[^\W_])[{_UNSPACED}]")
_CACHE = 300_000


class Overlap(NamedTuple):
    item_id: int | None
    matches: int
    length: int
    item_tokens: int
    doc_start: int
    doc_end: int


class _Tokens(dict):
    """64-bit hashes of tokens, those seen lately."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(token)
        return value


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One hash a token of all texts in a row, and where each text's begin: lower-case runs of
    letters and digits, single characters in scripts without spaces."""
    words, known = cut(texts, _RUNS, _SINGLE), kept("tokens", _Tokens)
    return np.fromiter(map(known.__getitem__, words.distinct), np.uint64, len(words.distinct))[words.index], words.bounds


def token_hashes(text: str | None) -> np.ndarray:
    """One hash a token of a text."""
    return tokens_of([text or ""])[0]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every position where a mask fits, of the tokens it reads."""
    n = len(tokens) - len(mask) + 1
    found = np.full(max(n, 0), int(mask, 2), np.uint64)
    for at, kept in enumerate(mask):
        if kept == "1" and n > 0:
            found = (found ^ tokens[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
    return found


def least_matches(n_tokens: int) -> int:
    """Matching tokens that an overlap with an item of so many tokens needs."""
    return min(LEAST_MATCHES, math.ceil(Fraction(LEAST_IDENTITY).limit_denominator(1000) * n_tokens))


def mask_of(n_tokens: int) -> str:
    """The mask of items of so many tokens."""
    return MASKS[max(least for least in MASKS if least <= n_tokens)]


class SeedIndex:
    """The seeds of benchmark items, each with its item and position."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, token_hashes(text)) for i, text in items]
        sizes = [len(tokens) for _, tokens in self.items]
        self.sizes, self.needed = np.array(sizes, np.int64), np.array([least_matches(n) for n in sizes], np.int64)
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *(tokens for _, tokens in self.items)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.masks = sorted({mask_of(n) for n in sizes if n})
        hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for owner, (_, tokens) in enumerate(self.items):
            if len(tokens):
                seeds = seed_hashes(tokens, mask_of(len(tokens)))
                hashes.append(seeds)
                owners.append(np.full(len(seeds), owner))
                places.append(np.arange(len(seeds)))
        found = np.concatenate(hashes)
        order = np.argsort(found, kind="stable")
        self.hashes, self.owners, self.places = found[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True

    def overlaps(self, text: str | None) -> list[Overlap]:
        """The best verified overlap of a text with every item, by item."""
        return next(self.overlaps_of([text]))

    def overlaps_of(self, texts: list[str | None]) -> Iterator[list[Overlap]]:
        """The same of many texts, whose seeds are looked up together."""
        for some in chunks(texts):
            tokens, bounds = tokens_of(some)
            found = [np.zeros((0, 4), np.int64)]
            for mask in self.masks:
                seeds = seed_hashes(tokens, mask)
                at = np.flatnonzero(self.table[seeds >> np.uint64(64 - TABLE_BITS)])
                text = np.searchsorted(bounds, at, "right") - 1
                # A seed lies in one text.
                inside = at + len(mask) <= bounds[text + 1]
                at, text = at[inside], text[inside]
                low, high = np.searchsorted(self.hashes, seeds[at]), np.searchsorted(self.hashes, seeds[at], "right")
                met = high > low
                found.append(np.stack((text[met], at[met] - bounds[text[met]], low[met], high[met]), 1))
            hits = np.concatenate(found)
            hits = hits[np.argsort(hits[:, 0], kind="stable")]
            edges = np.searchsorted(hits[:, 0], np.arange(len(some) + 1)).tolist()
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                own = tokens[bounds[i] : bounds[i + 1]]
                yield self._best(own, *self._shifts(len(own), *hits[a:b, 1:].T)) if b > a else []

    def _shifts(self, n_tokens: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different (owner, shift) at which a seed of an item lies on one of the text.

        Memory grows with the places of text and items, not with their pairs.
        """
        sizes = high - low
        span = 1 << 32
        if sizes.sum() <= PAIRS:
            entry = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            keys = np.unique(self.owners[entry] * span + np.repeat(at, sizes) - self.places[entry] + (span >> 1))
            return keys // span, keys % span - (span >> 1)
        order = np.argsort(low, kind="stable")
        at, low, high = at[order], low[order], high[order]
        marks: dict[int, np.ndarray] = {}
        edges = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            mine, entries = at[a:b], slice(low[a], high[a])
            owners, places = self.owners[entries], self.places[entries]
            by = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1], [True])))
            for x, y in zip(by.tolist(), by[1:].tolist(), strict=False):
                owner, theirs = int(owners[x]), places[x:y]
                mark = marks.setdefault(owner, np.zeros(n_tokens + int(self.sizes[owner]), bool))
                if len(mine) < len(theirs):
                    for place in mine.tolist():
                        mark[place - theirs + self.sizes[owner]] = True
                else:
                    for place in theirs.tolist():
                        mark[mine - place + self.sizes[owner]] = True
        owners = sorted(marks)
        shifts = [np.flatnonzero(marks[owner]) - self.sizes[owner] for owner in owners]
        return np.repeat(np.array(owners, np.int64), list(map(len, shifts))), np.concatenate(shifts)

    def _best(self, tokens: np.ndarray, owners: np.ndarray, shifts: np.ndarray) -> list[Overlap]:
        best: dict[tuple, Overlap] = {}
        for owner, shift in self._enough(tokens, owners, shifts):
            found = self._verified(tokens, owner, shift)
            if not found:
                continue
            # Items without an id are each their own.
            key = (1, owner) if found.item_id is None else (0, found.item_id)
            if key not in best or (found.matches, -found.doc_start) > (best[key].matches, -best[key].doc_start):
                best[key] = found
        return [best[i] for i in sorted(best)]

    def _enough(self, tokens: np.ndarray, owners: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int]]:
        """The (owner, shift) where an item laid beside the text has the matches it needs, in all."""
        first = np.maximum(0, -shifts)
        sizes = np.minimum(self.sizes[owners], len(tokens) - shifts) - first
        turn = np.cumsum(sizes) // COMPARED
        edges = np.flatnonzero(np.concatenate(([True], turn[1:] != turn[:-1], [True])))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            owner, shift, size = owners[a:b], shifts[a:b], sizes[a:b]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(first[a:b] - (ends - size), size)
            equal = tokens[place + np.repeat(shift, size)] == self.tokens[place + np.repeat(self.starts[owner], size)]
            sums = np.concatenate(([0], np.cumsum(equal)))
            good = sums[ends] - sums[ends - size] >= self.needed[owner]
            yield from zip(owner[good].tolist(), shift[good].tolist(), strict=True)

    def _verified(self, tokens: np.ndarray, owner: int, shift: int) -> Overlap | None:
        """The best run of an item laid beside the text at a shift, substitutions allowed."""
        item_id, item = self.items[owner]
        first, last = max(0, -shift), min(len(item), len(tokens) - shift)
        equal = tokens[first + shift : last + shift] == item[first:last]
        sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))))
        lowest = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - lowest))
        start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
        matches, length = int(equal[start:end].sum()), end - start
        # What lies around the run counts too, if the whole stays alike enough.
        for a, b in ((0, len(equal)), (0, end), (start, len(equal))):
            more = int(equal[a:b].sum())
            if more > matches and more >= LEAST_IDENTITY * (b - a):
                start, matches, length = a, more, b - a
        if matches < self.needed[owner] or matches < LEAST_IDENTITY * length:
            return None
        return Overlap(item_id, matches, length, len(item), first + shift + start, first + shift + start + length)


def _indexes(benchmark: DataFrame, least_tokens: int) -> tuple[int, Iterator[SeedIndex]]:
    """Seed indexes of blocks of the benchmark, each of bounded size, and their number; the texts of one item_id are in one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))

    def made() -> Iterator[SeedIndex]:
        for block in range(blocks):
            rows = items.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), "text")), F.lit(blocks)) == block).collect()
            kept_rows = [(r["item_id"], r["text"]) for r in rows if least_tokens <= 1 or len(token_hashes(r["text"])) >= least_tokens]
            yield SeedIndex(sorted(kept_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))

    return blocks, made()


def contamination(documents: DataFrame, benchmark: DataFrame, least_tokens: int = 1) -> DataFrame:
    """(doc_id, item_id, matches, length, item_tokens, doc_start, doc_end) of every overlap.

    Text and item share a seed if the tokens that the mask of the item's length reads are
    equal; no overlap that the following accepts is without one (see MASKS).
    Around each such hit the item is laid beside the text, and the best run, in which
    a substituted token costs SUBSTITUTION matches, must have LEAST_MATCHES matches (or
    four fifths of a shorter item) and LEAST_IDENTITY of its tokens equal. The best run
    of an item in a document is one row; positions are in tokens.

    The benchmark goes to the tasks in blocks of bounded size and texts never move:
    every block is one pass over the documents, whose rows are stored and whose index is
    freed before the next. A text is searched in memory a few times its size, also where it and
    an item repeat one word throughout. Null and empty texts and items give no
    rows; items without an id are each searched, and texts of one item_id are one item, of
    which the best overlap stands; rows that repeat a doc_id are searched each by itself;
    other columns are not read. An item of one token is found in every text that holds it:
    ``least_tokens`` leaves shorter items out.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, matches int, length int, item_tokens int, doc_start int, doc_end int"
    found = spark.createDataFrame([], schema)
    blocks, indexes = _indexes(benchmark, least_tokens)
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc_id, *o) for doc_id, found in zip(batch.column(0).to_pylist(), shared.value.overlaps_of(batch.column(1).to_pylist()), strict=True) for o in found]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *Overlap._fields])

        part = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        if blocks > 1:
            part = stored(part, "overlaps")
            shared.destroy()
        found = found.union(part)
    return found


def decontaminated(documents: DataFrame, benchmark: DataFrame, least_tokens: int = 1) -> DataFrame:
    """The documents, all columns, whose texts overlap no benchmark item. Nothing is shuffled."""
    spark = documents.sparkSession
    bounded_batches(spark)
    at = documents.columns.index("text")
    blocks, indexes = _indexes(benchmark, least_tokens)
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in shared.value.overlaps_of(batch.column(at).to_pylist())], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
        if blocks > 1:
            documents = stored(documents, "clean")
            shared.destroy()
    return documents
