"""Document fingerprints that keep edit distance: randomised embedding, then sampled bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .components import components
from .near import grown, runs

#: Characters that name an anchor, and how far around it none has a smaller hash: one anchor in
#: some 50 characters, wherever the text is moved to.
NAMED, AROUND = 8, 24
#: Steps of the walk that begins at an anchor.
STEPS = 128
#: Sampled steps of a document, each one hexadecimal digit; characters read at each.
SAMPLES, GRAM = 128, 4
#: Digits of a band, bands, and likeness that verification asks for. Of two texts of that likeness
#: 0.69 of the digits are equal, so all but 7 in 100 share a band.
BAND, BANDS, LEAST_LIKENESS = 6, 24, 0.8
#: Fingerprints that are compared at one place; a larger group is compared part by part.
PAIRED = 4096

_SEED = 20240229
_RNG = np.random.default_rng(_SEED)
#: For every step and kind of character, whether the walk moves on; the steps that each sample may
#: read, of which the first before the text's end counts; the order of anchors it chooses by.
_BITS = _RNG.integers(0, 2, (STEPS, 256), dtype=np.uint8)
_STEPS_OF = np.stack([_RNG.integers(0, STEPS >> c, SAMPLES) for c in range(STEPS.bit_length())])
_ORDERS = _RNG.integers(0, 1 << 63, SAMPLES).astype(np.uint64)
#: Which digits each band samples.
_PLACES = [sorted(_RNG.choice(SAMPLES, BAND, replace=False).tolist()) for _ in range(BANDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _anchors(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in texts that stand apart in a buffer, and a hash of what names each.

    A text begins with an anchor. Others are where the hash of the next characters is
    the smallest around, so an edit moves only those near it.
    """
    named = np.zeros(len(buffer), np.uint64)
    for k in range(NAMED):
        named[: len(buffer) - k] = (named[: len(buffer) - k] ^ buffer[k:]) * np.uint64(0x9E3779B97F4A7C15)
        named ^= named >> np.uint64(32)
    whole = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(whole, starts, 1)
    np.add.at(whole, starts + np.maximum(sizes - NAMED + 1, 0), -1)
    outside = np.cumsum(whole[:-1]) == 0
    far = np.iinfo(np.uint64).max
    held = np.where(outside, far, named)

    def least(x: np.ndarray) -> np.ndarray:
        """The smallest of the AROUND values before each."""
        span, low = 1, np.concatenate(([far], x[:-1]))
        while span < AROUND:
            shift = min(span, AROUND - span)
            low = np.minimum(low, np.concatenate((np.full(shift, far), low[:-shift])))
            span += shift
        return low

    found = (held < least(held)) & (held <= least(held[::-1])[::-1]) & ~outside
    found[starts] = True
    at = np.flatnonzero(found)
    return at, named[at]


def embed(texts: list[str]) -> np.ndarray:
    """Digits (0 to 15) of every text: the characters that shared random walks read at sampled steps.

    A walk begins at every anchor and stands or moves on by a random bit that depends on
    the step and the character alone. After an insertion or deletion two texts' walks
    soon read the same characters at the same steps again, and an anchor's walk does not
    know what came before it. Each sample takes the anchor that is first in an order of
    its own and reads one step of its walk, so the number of equal digits follows the
    share of the text that an edit left alone.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    pad = np.zeros(AROUND + NAMED + GRAM, np.uint32)
    buffer = np.concatenate([x for p in points for x in (p, pad)]) if points else pad
    starts = np.cumsum(sizes + len(pad)) - (sizes + len(pad))
    at, names = _anchors(buffer, starts, sizes) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    bounds = np.searchsorted(at, starts)
    chosen = np.empty((len(texts), SAMPLES), np.int64)
    for sample in range(SAMPLES if texts else 0):
        turn = _mixed(names ^ _ORDERS[sample])
        first = np.minimum.reduceat(turn, bounds)
        hits = np.flatnonzero(turn == np.repeat(first, np.diff(np.append(bounds, len(at)))))
        chosen[:, sample] = hits[np.searchsorted(hits, bounds)]
    walks, walk_of = np.unique(chosen.ravel(), return_inverse=True)
    place = at[walks]
    ends = (starts + sizes)[np.searchsorted(starts, place, "right") - 1] if len(walks) else place
    kinds = ((buffer * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
    room = np.clip(2 * (ends - place), 1, STEPS)[walk_of].reshape(chosen.shape)
    step = np.zeros(chosen.shape, np.int64)
    for steps in _STEPS_OF[::-1]:
        step = np.where(steps < room, steps, step)
    step = step.ravel()
    order = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[order], np.arange(STEPS + 1))
    read = np.empty(len(order), np.int64)
    for t in range(STEPS if len(walks) else 0):
        mine = order[cuts[t] : cuts[t + 1]]
        read[mine] = place[walk_of[mine]]
        place = np.minimum(place + _BITS[t][kinds[place]], ends)
    limit = np.repeat(starts + sizes, SAMPLES)
    digest = np.tile(np.arange(SAMPLES, dtype=np.uint64), len(texts))
    for k in range(GRAM):
        digest = (digest ^ buffer[np.minimum(read + k, limit)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(31)
    return (digest >> np.uint64(60)).astype(np.uint8).reshape(len(texts), SAMPLES)


def digits_text(digits: np.ndarray) -> list[str]:
    """Fingerprints as lower-case hexadecimal digits."""
    return [bytes(b"0123456789abcdef"[d] for d in row).decode() for row in digits]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of two texts that is alike, 0 to 1, by their equal digits, less what chance makes equal.

    Samples choose among the anchors of either text; of two texts of which a share s is
    alike they choose the same one with s / (2 - s), which is turned back here.
    """
    same = np.clip(((a == b).mean(-1) - 1 / 16) / (15 / 16), 0, 1)
    return 2 * same / (1 + same)


#: Digits in which fingerprints that link may differ: one segment more, and one of them is equal.
_DIFFERING = int(np.flatnonzero(likeness(np.tri(SAMPLES + 1, SAMPLES, -1), np.zeros(SAMPLES)) >= LEAST_LIKENESS)[-1])
_SEGMENTS = np.array_split(np.arange(SAMPLES), _DIFFERING + 1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(documents: DataFrame) -> DataFrame:
    """(bucket, turn, doc_id, packed): documents dealt out by doc_id, sorted, each with its follower in reach.

    Every bucket ends with the first document of the next one once more (turn 1), the
    last bucket with the first of all. Only doc_ids are read to choose the buckets, and
    the driver sees one doc_id a bucket.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id").repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("p"))
    lows = ids.groupBy("p").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none")).collect()
    nulls = any(r["none"] for r in lows)
    firsts = np.array(sorted({r["low"] for r in lows if r["low"] is not None}), np.int64)
    bounds = firsts if nulls else firsts[1:]
    last = len(bounds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            home = np.where(known, np.searchsorted(bounds, ids, "right"), 0)
            every = np.arange(len(ids))
            # The first document of a bucket follows the last of the one before it.
            opens = every[known & (home > 0)]
            opens = opens[bounds[home[opens] - 1] == ids[opens]]
            first = every[~known] if nulls else every[known & (ids == firsts[0])] if len(firsts) else every[:0]
            rows = np.concatenate((every, opens, first))
            bucket = np.concatenate((home, home[opens] - 1, np.full(len(first), last)))
            turn = np.repeat([0, 1], [len(every), len(opens) + len(first)])
            texts = pa.array([pack(t.as_buffer()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(turn, pa.int32()), batch.column(0).take(pa.array(rows)), texts.take(pa.array(rows))], names=["bucket", "turn", "doc_id", "packed"])

    # Texts travel packed: this is all that the shuffle moves.
    dealt = texts.mapInArrow(placed, "bucket int, turn int, doc_id long, packed binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "turn", "doc_id", "packed")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    waiting, unpack = None, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = [(bucket, turn, doc_id, unpack(packed).decode()) for bucket, turn, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        digits = embed([r[3] for r in rows])
        if waiting is not None:
            rows, digits = [waiting[0], *rows], np.concatenate((waiting[1], digits))
        pairs = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
        waiting = rows[-1], digits[-1:]
        if pairs:
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
            others, own, after = embed(changed), digits[pairs], digits[[i + 1 for i in pairs]]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][2] for i in pairs], pa.int64()),
                    "n_chars": pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                    "fingerprint": digits_text(own),
                    "edited_fingerprint": digits_text(others),
                    "near_edited": likeness(own, others),
                    "near_next": likeness(own, after),
                }
            )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter replaced by the start of the next document in
    ascending doc_id, after the last the first. Likeness compares fingerprints alone.
    Null texts are empty; rows of one doc_id stand in an order of their texts, null
    doc_ids before all others; a single document follows itself; an empty table gives
    none; other columns are not read.
    """
    bounded_batches(documents.sparkSession)
    return in_order(documents).mapInArrow(_fingerprinted, _SCHEMA)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that connect all alike fingerprints of a block, in rows sorted by block."""
    for key, (ids, prints) in runs(batches, lambda c: [c[1].to_numpy(), np.frombuffer("".join(c[2].to_pylist()).encode(), np.uint8).reshape(-1, SAMPLES)]):
        bounds, pairs = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])).tolist(), []
        for low, high in zip(bounds, bounds[1:], strict=False):
            own = prints[low:high]
            near = lambda one, others, own=own: likeness(own[others], own[one]) >= LEAST_LIKENESS
            pairs += [(ids[low + a], ids[low + b]) for _, links in grown(high - low, near) for a, b in links]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1]})


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, n): keys that two or more hold."""
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _dealt(keyed: DataFrame) -> DataFrame:
    """(block, print) of (key, n, print): a key of more than PAIRED in parts, a block for every two."""
    parts = F.when(F.col("n") > PAIRED, F.ceil(F.col("n") * 2 / PAIRED)).otherwise(1).cast("int")
    dealt = keyed.select("key", "print", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "print")


def edit_classes(fingerprints: DataFrame) -> DataFrame:
    """``fingerprints`` (doc_id, fingerprint, ...) with ``class_id``: the smallest doc_id that links reach.

    Fingerprints link if their likeness is LEAST_LIKENESS or more. Equal ones are one
    first. Those that share a band, which samples BAND of the digits, are compared with
    each other. Within a band of more than PAIRED only those meet that have a segment
    equal: fingerprints that link differ in fewer digits than there are segments, so no
    link is lost. A segment that is still held by more than PAIRED is dealt out in parts by
    hash, every two of which meet in a task of their own. No task counts, numbers or
    holds a whole band. A class whose doc_ids are all null has a null class_id.
    """
    print_of = F.xxhash64("fingerprint")
    classes = stored(fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("print", print_of), "prints")
    digit = lambda i: F.substring("fingerprint", i + 1, 1)
    bands = F.array(*[F.xxhash64(F.lit(i), F.concat(*map(digit, places))) for i, places in enumerate(_PLACES)])
    keyed = classes.select(F.explode(bands).alias("key"), "print")
    sizes = stored(_shared(keyed), "bands")
    blocks = _dealt(keyed.join(sizes.where(F.col("n") <= PAIRED), "key"))
    crowded = sizes.where(F.col("n") > PAIRED).select("key")
    if not crowded.isEmpty():
        of_band = keyed.join(crowded, "key").join(classes.select("print", "fingerprint"), "print")
        part = lambda i, at: F.xxhash64("key", F.lit(i), F.substring("fingerprint", int(at[0]) + 1, len(at)))
        parted = stored(of_band.select(F.explode(F.array(*[part(i, at) for i, at in enumerate(_SEGMENTS)])).alias("key"), "print"), "segments")
        blocks = blocks.union(_dealt(parted.join(_shared(parted), "key")))
    blocks = blocks.distinct()
    members = blocks.join(classes.select("print", "fingerprint"), "print").select("block", "print", "fingerprint")
    count = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = members.repartition(count, "block").sortWithinPartitions("block").mapInArrow(_linked, "a long, b long").distinct()
    joined = components(stored(linked, "alike")).select(F.col("node").alias("print"), "component")
    reached = classes.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = reached.join(reached.groupBy("component").agg(F.min("first").alias("class_id")), "component").select("fingerprint", "class_id")
    return fingerprints.join(ids, "fingerprint").select(*fingerprints.columns, "class_id")


def classed_documents(documents: DataFrame) -> DataFrame:
    """``fingerprint_documents`` with the ``class_id`` that banding and verification give."""
    return edit_classes(stored(fingerprint_documents(documents), "fingerprints"))
