"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .tokens import encoded_batches

CAPACITY = 2048

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Window(NamedTuple):
    """``times`` sequences, each holding ``count`` pieces of every ``length``."""

    times: int
    items: tuple[tuple[int, int], ...]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of remaining lengths whose sum comes closest to ``room`` from below.

    Bit s of an integer says whether sum s can be reached. Counts go in as bundles of
    1, 2, 4, ... pieces; what was reachable before each bundle is kept, and walking
    back through these gives how many of each length the best sum takes. Longer
    lengths go first; once ``room`` itself is reached no more are needed.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left and not reach >> room:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, bundle = left - take, bundle * 2
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return sorted(chosen.items(), reverse=True)


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[Window]:
    """Windows that use up every length: the longest piece left, then the fullest rest.

    The same window is used as often as its counts allow, so the plan's size depends on
    the number of different lengths (under ``capacity``), never on that of pieces.
    """
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        items = dict(fullest({n: c for n, c in left.items() if c}, capacity - longest))
        left[longest] += 1
        items[longest] = items.get(longest, 0) + 1
        times = min(left[n] // c for n, c in items.items())
        for n, c in items.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        plan.append(Window(times, tuple(sorted(items.items(), reverse=True))))
    return plan


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text with its end id, with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, sizes in encoded_batches(batches, tokenizer, end_id):
            body, counts = memoryview(ids.astype("<u4").view(np.uint8)), -(-sizes // capacity)
            document = np.repeat(np.arange(len(sizes)), counts)
            start = (np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
            length = np.minimum(capacity, sizes[document] - start)
            low = (np.cumsum(sizes) - sizes)[document] + start
            crcs = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            columns = [doc_ids.take(pa.array(document)), *map(pa.array, (start, length, np.array(crcs, np.int64), sizes[document]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (doc_id, start, length, ...) its ``sequence_id`` and ``offset``.

    A piece of ``capacity`` is a sequence of its own. The others are packed by minimum
    bin slack: a histogram of their lengths, at most ``capacity`` rows, gives the plan;
    a piece's rank among those of its length says which window of the plan takes it.
    Ranks come from one range-partitioned sort: a common length is spread over as many
    tasks as it needs, and the driver sees one row count per task.

    Pieces must have a length from 1 to ``capacity``. Repeated rows are packed each by
    itself, equal pieces in any order; an empty table gives none; more columns stay.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash parts pieces that repeat an id, null ones too.
    order = ["length", "doc_id", "start", F.xxhash64(*pieces.columns)]
    ordered = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranked = stored(ordered.withColumns({"p": F.shiftright(at, 33).cast("int"), "i": at.bitwiseAND((1 << 33) - 1)}), "ranked")

    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    firsts, total = {}, 0
    for length in sorted(counts):
        firsts[length] = total
        total += counts[length]
    bases, base = [], 0
    for r in sorted(ranked.groupBy("p").agg(F.count("*").alias("n")).collect()):
        bases.append((r["p"], base))
        base += r["n"]

    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for window in [*plan_windows({n: c for n, c in counts.items() if n < capacity}, capacity), *([Window(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else [])]:
        offset = 0
        for length, count in window.items:
            low = firsts[length] + used[length]
            used[length] += count * window.times
            slots.append((length, low, low + count * window.times, count, sequence, offset))
            offset += length * count
        sequence += window.times

    plan = spark.createDataFrame(slots, "s_length long, low long, high long, each long, s_sequence long, s_offset long")
    base = spark.createDataFrame(bases, "p int, base long")
    placed = ranked.join(F.broadcast(base), "p").withColumn("rank", F.col("base") + F.col("i"))
    turn = F.col("rank") - F.col("low")
    return (
        placed.join(F.broadcast(plan), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumns({"sequence_id": F.col("s_sequence") + F.floor(turn / F.col("each")).cast("long"), "offset": F.col("s_offset") + turn % F.col("each") * F.col("length")})
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole texts, cut them at multiples of ``capacity`` and pack the pieces.

    Null and empty texts are the end id alone; rows that repeat a doc_id are packed each
    by itself; other columns are not read.
    """
    return pack(stored(token_pieces(documents, tokenizer, end_id, capacity), "pieces"), capacity)
