"""SimHash near-duplicates, found with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .components import components

#: Words of a shingle, seed of its hash, and differing bits that still link.
WORDS, SEED, BITS = 4, 42, 4

#: The 64 bits as a ring of BITS + 1 segments: one of them must be equal in any linked pair.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

#: Fingerprints that may share a key before the key is replaced by exact midpoints.
BUCKET = 4096


def _fingerprint(text: bytes | None, words: int) -> int:
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(tokens) > words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text, as a signed long.

    A-Z is lower-cased, words are what ASCII white space leaves, shingles are ``words``
    words joined by a space, repeats included; a shorter text is one shingle and a
    text without words (null too) has fingerprint 0. A bit is set if it is in over half
    of the shingles' XXH64 values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([_fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flipped(key):
    return lambda x: key.bitwiseXOR(x.cast("long"))


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): where a pigeonring chain can begin.

    With at most BITS differing bits on a ring of BITS + 1 segments, some chain of
    consecutive segments starts with an equal segment and has, after every l segments,
    at most l * BITS / (BITS + 1) differences: none in the first, one in the first two.
    So a linked pair shares, for some segment, that segment and the next up to one bit.
    Fingerprints whose next segment has odd parity also take the keys one bit away;
    two that differ by one bit have unlike parity, so one of them always does.
    """
    fp, keys = F.col("fp"), []
    for i, (at, width) in enumerate(SEGMENTS):
        after, size = SEGMENTS[(i + 1) % len(SEGMENTS)]
        first = F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)
        second = F.shiftrightunsigned(fp, after).bitwiseAND((1 << size) - 1)
        key = F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(first, 16)).bitwiseOR(second)
        flips = F.array(*[F.lit(0)] + [F.lit(1 << b) for b in range(size)])
        odd = F.bit_count(second) % 2 == 1
        keys.append(F.transform(F.when(odd, flips).otherwise(F.array(F.lit(0))), _flipped(key)))
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def pigeonring(differences: np.ndarray) -> np.ndarray:
    """Which XORs of two fingerprints hold a chain within its budget, before all bits are counted."""
    counts = np.stack([np.bitwise_count(differences >> np.uint64(at) & np.uint64((1 << width) - 1)) for at, width in SEGMENTS])
    found = np.zeros(len(differences), bool)
    for start in range(len(SEGMENTS)):
        within, total = np.ones(len(differences), bool), np.zeros(len(differences), np.int64)
        for step in range(1, len(SEGMENTS)):
            total += counts[(start + step - 1) % len(SEGMENTS)]
            within &= total <= step * BITS // len(SEGMENTS)
        found |= within
    return found


def _linked(fps: np.ndarray, one: np.uint64) -> np.ndarray:
    differences = fps ^ one
    near = pigeonring(differences)
    near[near] = np.bitwise_count(differences[near]) <= BITS
    return near


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among the fingerprints of a key."""
    links, waiting = [], fps
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            one = frontier.pop()
            near = _linked(waiting, one)
            # A chain through what is near, as links to one would make it a hub.
            chain = [int(one), *waiting[near].tolist()]
            links += zip(chain, chain[1:], strict=False)
            frontier.extend(waiting[near])
            waiting = waiting[~near]
    return links


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal keys in rows sorted by key."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def linked(keys, fps):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        bounds = np.concatenate(([0], cuts, [len(keys)]))
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        near = pigeonring(fps[two] ^ fps[two + 1])
        near[near] = np.bitwise_count(fps[two[near]] ^ fps[two[near] + 1]) <= BITS
        links = list(zip(fps[two[near]].tolist(), fps[two[near] + 1].tolist(), strict=True))
        for a, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links += _forest(fps[a : a + n])
        found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1]})

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        if len(keys) and keys[-1] != keys[0]:
            last = int(np.searchsorted(keys, keys[-1]))
            yield linked(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield linked(keys, fps)


def _midpoints() -> list[int]:
    """All masks of at most BITS / 2 bits."""
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    return [0, *bits, *(x ^ y for i, x in enumerate(bits) for y in bits[:i])]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the different fingerprints ``fp`` that connect exactly what
    chains of pairs with at most BITS differing bits connect.

    Keys of up to BUCKET fingerprints are searched by chain and Hamming distance and
    give a spanning forest, not all pairs. The fingerprints of a larger key instead meet
    at midpoints: two differ by at most BITS bits exactly if some value is at most
    BITS / 2 bits from both. No more than 2081 fingerprints can meet at one.
    """
    keys = chain_keys(fps)
    crowded = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "crowded")
    quiet = keys.join(crowded, "key", "left_anti")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = quiet.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_link_runs, "a long, b long")
    if crowded.isEmpty():
        return near
    hot = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in _midpoints()])
    met = hot.select(F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"), "fp").groupBy("z").agg(F.collect_list("fp").alias("fps"))
    return near.union(met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct())


def near_duplicates(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents link if their fingerprints differ in at most BITS bits; ``component_id``
    is the smallest doc_id that links reach, a document's own included. Equal
    fingerprints are one before any search, so copies cost nothing.

    Null and empty texts have fingerprint 0 and link like any other; rows that repeat a
    doc_id are each returned; a null doc_id is no smallest one; other columns are not
    read; an empty table gives none.
    """
    marked = stored(fingerprints(documents, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(stored(links(classes.select("fp")), "near"))
    reached = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = reached.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = reached.join(smallest, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, all columns, whose doc_id is the smallest of its component.

    Rows that repeat such a doc_id stay one; a null doc_id stays.
    """
    found = near_duplicates(documents, words)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    once = documents.where("doc_id is not null")
    if not found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        once = once.dropDuplicates(["doc_id"])
    return once.join(kept, "doc_id", "left_semi").select(documents.columns).union(documents.where("doc_id is null"))
