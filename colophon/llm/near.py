"""Near-duplicates by exact Jaccard similarity of five-word shingles, candidates by SimHash and pigeonring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, stored
from .components import components
from .simhash import SEED

#: Words of a shingle, and least Jaccard similarity of linked texts as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Min-wise shingles of a text, in a ring; texts meet where two neighbours of the ring are equal. At
#: similarity 0.8 one in 800 pairs has no such two (more in short texts never: they have the same ones).
RING = 10
#: The fingerprint as a ring of segments of 32 bits, and how many bits may differ in all. At
#: similarity 0.8 some 76 differ (deviation 8), more only in texts of under ten shingles.
SEGMENTS, BUDGET = 16, 128
#: Texts, and shingles of all, that are compared at one place; a larger group is compared part by part.
PAIRED, SHINGLES = 4096, 8_000_000

_LANES = SEGMENTS // 2
_STEPS = np.arange(1, _LANES + RING + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's last steps."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: bytes | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of a text's words, and those of its different shingles, sorted.

    A-Z is lower-cased, words are what ASCII white space leaves; a shorter text is one
    shingle and a text without words has none.
    """
    import xxhash

    tokens = (text or b"").lower().split()
    joined = b" ".join(tokens)
    if not tokens:
        return xxhash.xxh64_intdigest(b"", SEED), np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(tokens) > words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return digest(joined, SEED), np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of different shingles under several hash functions, as 64-bit words."""
    ones = np.zeros(_LANES * 64, np.int64)
    for at in range(0, len(hashes), 1 << 11):
        lanes = _mixed(hashes[at : at + (1 << 11), None] + _STEPS[:_LANES])
        # Byte by byte, as sums of up to 255 rows of bits fit a byte.
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        for low in range(0, len(bits), 255):
            ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view("<u8")


def ring_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each place of the ring: the place, its min-wise shingle and the next one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(RING, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        least = np.minimum(least, _mixed(hashes[at : at + (1 << 13), None] + _STEPS[_LANES:]).min(0))
    return _mixed(_mixed(least + np.arange(RING, dtype=np.uint64)) ^ np.roll(least, -1)).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("near", dict)
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(1)]
        ids = np.array([c for c, _ in found], np.uint64).view(np.int64)
        sizes = np.array([len(s) for _, s in found], np.int64)
        columns = [batch.column(0), pa.array(ids), pa.array(sizes), pa.array([wide_fingerprint(s).tobytes() for _, s in found], pa.binary()), pa.array([ring_keys(s) for _, s in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "n", "fp", "keys"])


def pigeonring(differences: np.ndarray) -> np.ndarray:
    """Which XORs of two fingerprints (rows of words) are within BUDGET.

    Of a pair within it some chain of two neighbouring segments starts with a segment
    of at most its share of the budget and has at most two shares in both: all others
    go before their bits are counted in whole.
    """
    counts = np.bitwise_count(differences.view("<u4")).astype(np.int16)
    share = BUDGET // SEGMENTS
    near = ((counts <= share) & (counts + np.roll(counts, -1, axis=1) <= 2 * share)).any(1)
    near[near] = counts[near].sum(1) <= BUDGET
    return near


def grown(n: int, near_to) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Connected groups of ``n`` things, with the links that join each, where
    ``near_to(one, others)`` says which of the others are near to one."""
    waiting = np.arange(n)
    while len(waiting):
        group, links, frontier, waiting = [waiting[:1]], [], [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            one = frontier.pop()
            near = near_to(one, waiting)
            found, waiting = waiting[near], waiting[~near]
            links += [(one, x) for x in found.tolist()]
            group.append(found)
            frontier.extend(found.tolist())
        yield np.concatenate(group), links


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, class): groups of texts of a key that their fingerprints connect, in rows sorted by key."""
    import xxhash

    for key, (ids, fps) in runs(batches, lambda c: [c[1].to_numpy(), np.frombuffer(b"".join(c[2].to_pylist()), "<u8").reshape(-1, _LANES)]):
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[pigeonring(fps[two] ^ fps[two + 1])]
        groups = [np.array(g) for g in zip(two.tolist(), (two + 1).tolist(), strict=True)]
        for low, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fps[low : low + n]
            groups += [low + g for g, _ in grown(n, lambda one, others, own=own: pigeonring(own[others] ^ own[one])) if len(g) > 1]
        members = [np.unique(ids[g]) for g in groups]
        members = [m for m in members if len(m) > 1]
        blocks = np.array([xxhash.xxh64_intdigest(m.tobytes()) for m in members], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"block": np.repeat(blocks, [len(m) for m in members]), "class": np.concatenate([np.zeros(0, np.int64), *members])})


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links of similarity LEAST or more that connect all such pairs of a block, in rows sorted by block."""
    for key, (ids, sets) in runs(batches, lambda c: [c[1].to_numpy(), np.array([*c[2].to_pylist(), None], object)[:-1]]):
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        pairs = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            sizes = np.array([len(s) for s in sets[low:high]], np.int64)
            words = np.unique(np.concatenate([np.asarray(s, np.int64) for s in sets[low:high]]), return_inverse=True)[1]
            starts, seen = np.cumsum(sizes) - sizes, np.zeros(int(words.max()) + 1, bool)

            def alike(one, others, words=words, starts=starts, sizes=sizes, seen=seen):
                own = words[starts[one] : starts[one] + sizes[one]]
                seen[own] = True
                # Only texts of a near size can be alike; their words follow one another.
                kept = np.flatnonzero((sizes[others] * LEAST[1] >= sizes[one] * LEAST[0]) & (sizes[one] * LEAST[1] >= sizes[others] * LEAST[0]))
                found = np.zeros(len(others), bool)
                if len(kept):
                    n = sizes[others[kept]]
                    ends = np.cumsum(n)
                    at = np.arange(ends[-1]) + np.repeat(starts[others[kept]] - (ends - n), n)
                    shared = np.add.reduceat(seen[words[at]], ends - n, dtype=np.int64)
                    found[kept] = shared * LEAST[1] >= (n + sizes[one] - shared) * LEAST[0]
                seen[own] = False
                return found

            pairs += [(ids[low + a], ids[low + b]) for _, links in grown(high - low, alike) for a, b in links]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"a": found.min(1, initial=np.iinfo(np.int64).max), "b": found.max(1, initial=np.iinfo(np.int64).min)})


def runs(batches: Iterator[pa.RecordBatch], columns_of) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys and further columns of whole runs of equal keys, several together, from rows sorted by key."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(0).to_numpy(), *columns_of(batch.columns)]
        waiting = columns if waiting is None else [np.concatenate(c) for c in zip(waiting, columns, strict=True)]
        key = waiting[0]
        if key[-1] != key[0]:
            last = int(np.searchsorted(key, key[-1]))
            yield key[:last], [w[:last] for w in waiting[1:]]
            waiting = [w[last:] for w in waiting]
    if waiting is not None:
        yield waiting[0], waiting[1:]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(0)]
        ids = np.array([c for c, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], names=["class", "shingles"])


def _binary(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


def near_blocks(classes: DataFrame) -> DataFrame:
    """(block, class): groups of ``classes`` (class, n, fp, keys) that may be similar.

    Texts of a key are compared by pigeonring and fingerprint. A key of more than PAIRED
    texts, or SHINGLES shingles, is dealt out in parts, and every two parts meet in a
    task of their own: all pairs are still compared, and no task holds the whole key.
    """
    keyed = classes.select(F.explode("keys").alias("key"), "class", "fp", "n")
    sums = keyed.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).where((F.col("texts") > PAIRED) | (F.col("shingles") > SHINGLES))
    parts = F.greatest(F.ceil(F.col("texts") * 2 / PAIRED), F.ceil(F.col("shingles") * 2 / SHINGLES)).cast("int")
    crowded = stored(sums.select("key", parts.alias("parts")), "crowded")
    rows = keyed.select("key", "class", "fp")
    if not crowded.isEmpty():
        rows = keyed.join(crowded, "key", "left_anti").select("key", "class", "fp")
        own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
        dealt = keyed.join(crowded, "key").withColumn("own", own).select("key", "class", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = rows.union(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), "class", "fp"))
    return stored(_sorted(rows, "key").mapInArrow(_blocks_of, "block long, class long").distinct(), "blocks")


def similar_links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between ``classes`` (class, first, n, fp, keys) that connect all
    texts whose shingles reach the similarity LEAST, as far as they share a block.

    Every link is verified by the shingles themselves, and within a block none is lost.
    """
    blocks = near_blocks(classes)
    asked = classes.select("class", "first").join(blocks.select("class"), "class", "left_semi")
    texts = _binary(documents).join(asked.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(texts.select("text").mapInArrow(_sets, "class long, shingles array<long>"), "shingles").dropDuplicates(["class"])
    members = blocks.join(sets, "class").select("block", "class", "shingles")
    return stored(_sorted(members, "block").mapInArrow(_links_of, "a long, b long").distinct(), "near")


def one_of_similar(documents: DataFrame) -> DataFrame:
    """The documents, all columns, whose doc_id is the smallest of its group.

    Texts link if the Jaccard similarity of their different five-word shingles is 0.8 or
    more, and groups are what links reach. Texts of the same words are one before any
    search, so copies cost nothing; texts without words (null too) are such copies. Rows
    that repeat a kept doc_id stay one; a null doc_id stays; an empty table gives none.
    """
    bounded_batches(documents.sparkSession)
    known = documents.where("doc_id is not null")
    marked = stored(_binary(known).mapInArrow(_marks, "doc_id long, class long, n long, fp binary, keys array<long>"), "fingerprints")
    classes = stored(marked.groupBy("class").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "classes")
    joined = components(similar_links(known, classes)).select(F.col("node").alias("class"), "component")
    reached = classes.select("class", "first").join(joined, "class", "left")
    firsts = reached.groupBy(F.coalesce("component", "class").alias("group")).agg(F.min("first").alias("doc_id")).select("doc_id").distinct()
    if not marked.groupBy("doc_id").count().where("count > 1").isEmpty():
        known = known.dropDuplicates(["doc_id"])
    return known.join(firsts, "doc_id", "left_semi").select(documents.columns).union(documents.where("doc_id is null"))
