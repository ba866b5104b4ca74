"""How filters of a corpus overlap: what each removes, in every order, and at what cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task of the routed texts should have: Spark does not size an RDD's partitions by itself.
TASK_ROWS = 50_000
#: Bytes of different texts that a task holds while it looks for copies among its own rows.
HELD_BYTES = 64 << 20

_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def few_words(data: bytes, text: str, words: list[bytes]) -> bool:
    return len(words) < 100


def repeated_words(data: bytes, text: str, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 80 * len(words)


def upper_case(data: bytes, text: str, words: list[bytes]) -> bool:
    return 100 * (len(data) - len(data.translate(None, _UPPER))) > 10 * len(text)


def marked(data: bytes, text: str, words: list[bytes]) -> bool:
    return len(data.translate(None, _MARKS)) < len(data)


#: Filters of one text, by letter; each says whether a text fails it.
FILTERS: dict[str, Callable] = {"A": few_words, "B": repeated_words, "C": upper_case, "D": marked}
#: The filter of copies, which looks at the whole table.
COPY = "E"


def _failed(text: str, data: bytes, filters: dict[str, Callable]) -> int:
    # Bytes split at ASCII white space alone, which no other code point's bytes hold.
    words = data.split()
    return sum(1 << k for k, fails in enumerate(filters.values()) if fails(data, text, words))


def own_chains(rows: Iterable, filters: dict[str, Callable] = FILTERS, held: int = HELD_BYTES) -> Iterator[tuple]:
    """A task's rows (doc_id, part, text) with only the smallest doc_id of each different text still open.

    Yields (key, ...) records: (fingerprint, text, doc_id, part, mask) of texts that must
    meet their copies in other tasks, and (a key of the row, None, doc_id, part, mask) of rows
    settled here. A copy settled here never moves its text, so a text that a third of all
    rows repeat costs one record a task. Chains hold whole texts, so two texts
    of one fingerprint stay apart; they are handed on when they hold ``held`` bytes.
    """
    copy, chains, size = 1 << len(filters), {}, 0

    def settled(doc_id, part, mask):
        return (xxhash.xxh3_64_intdigest(f"{doc_id} {part}".encode()), (None, doc_id, part, mask))

    def handed():
        for key, chain in chains.items():
            for data, mask, least, parts in chain:
                for part in parts:
                    yield (key, (data, least, part, mask))

    for doc_id, part, text in rows:
        text = text or ""
        data = text.encode()
        if doc_id is None:
            yield settled(doc_id, part, _failed(text, data, filters))
            continue
        key = xxhash.xxh3_64_intdigest(data)
        chain = chains.setdefault(key, [])
        entry = next((e for e in chain if e[0] == data), None)
        if entry is None:
            chain.append([data, _failed(text, data, filters), doc_id, [part]])
            size += len(data) + 200
            if size > held:
                yield from handed()
                chains, size = {}, 0
        elif doc_id > entry[2]:
            yield settled(doc_id, part, entry[1] | copy)
        else:
            if doc_id < entry[2]:
                for p in entry[3]:
                    yield settled(entry[2], p, entry[1] | copy)
                entry[2], entry[3] = doc_id, []
            entry[3].append(part)
    yield from handed()


def met_chains(records: Iterable, copy: int) -> Iterator[tuple]:
    """(doc_id, part, mask) of records in order of their fingerprint; those of a larger doc_id than a copy's are marked.

    Of one fingerprint at a time the different texts are held, each with its minimum.
    """
    at, chain = None, []

    def closed():
        for _, least, rows in chain:
            for doc_id, part, mask in rows:
                yield doc_id, part, mask | (copy if doc_id > least else 0)

    for key, (data, doc_id, part, mask) in records:
        if data is None:
            yield doc_id, part, mask
            continue
        if key != at:
            yield from closed()
            at, chain = key, []
        entry = next((e for e in chain if e[0] == data), None)
        if entry is None:
            chain.append([data, doc_id, [(doc_id, part, mask)]])
        elif doc_id > entry[1]:
            # No minimum: emitted at once, so a chain never holds the rows of a large group.
            yield doc_id, part, mask | copy
        else:
            if doc_id < entry[1]:
                for d, p, m in entry[2]:
                    yield d, p, m | copy
                entry[1], entry[2] = doc_id, []
            entry[2].append((doc_id, part, mask))
    yield from closed()


def _partitions(docs: DataFrame, rows: int = 0) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def filter_masks(docs: DataFrame, filters: dict[str, Callable] = FILTERS, held: int = HELD_BYTES) -> DataFrame:
    """(doc_id, part, mask): which filters each document fails, by bits in the filters' order; the last bit is a copy's.

    A document is a copy if a smaller doc_id has the identical text. Texts are dealt out
    by their xxHash, each task's different ones once, and sorted there (on disk if need
    be), so that a chain is one fingerprint's texts alone.

    part: lang, null as the empty string. Null texts are empty ones. A null doc_id is no
    smaller or larger than others: such rows are never copies and have none. Rows that repeat a doc_id
    and text are both kept as minima. Very long texts take a few times their size in a task. Other
    columns are not looked at; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), "text").rdd
    copy = 1 << len(filters)
    routed = rows.mapPartitions(lambda it: own_chains(it, filters, held)).repartitionAndSortWithinPartitions(_partitions(docs, docs.count()), lambda key: key)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(lambda it: met_chains(it, copy)), "doc_id long, part string, mask int", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id): documents whose text a smaller doc_id has; see ``filter_masks``."""
    return filter_masks(docs, {}).where("mask > 0").select("doc_id")


def mask_counts(masks: DataFrame, labels: DataFrame, n_filters: int) -> RDD:
    """(part, counts): per part an array [mask, 3] of documents, of those of quality 1 and of toxic ones.

    Labels of one doc_id are taken together: one that says 1 is enough; a null doc_id has none. Tasks fold their own
    documents first, so a task sends one vector a part.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    rows = masks.join(said, F.col("doc_id") == F.col("id"), "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    size = 1 << n_filters

    def added(counts, row):
        counts[row[0], 0] += 1
        counts[row[0], 1] += row[1]
        counts[row[0], 2] += row[2]
        return counts

    def first(row):
        return added(np.zeros((size, 3), np.int64), row)

    return rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(first, added, lambda a, b: a + b, _partitions(masks))


def order_rows(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """(part, filter_order, step, ...) for every order of the filters, from the counts by mask."""
    k, masks = len(letters), np.arange(len(counts))
    total = counts[:, 0]
    failing = np.array([bin(m).count("1") for m in masks])
    bit = {letter: (masks >> i & 1).astype(bool) for i, letter in enumerate(letters)}
    n_orders = int(np.prod(np.arange(1, k + 1)))
    # In an equal share of all orders each of a document's failing filters comes first.
    shapley = {x: int((total[bit[x]] * (n_orders // failing[bit[x]])).sum()) for x in letters}
    alone = {x: int(total[bit[x] & (failing == 1)].sum()) for x in letters}
    for order in permutations(letters):
        gone = np.zeros(len(masks), bool)
        for step, letter in enumerate(order, 1):
            here, again = bit[letter] & ~gone, bit[letter] & gone
            gone = gone | here
            n, good, toxic = (int(x) for x in counts[here].sum(0))
            yield part, "".join(order), step, letter, int(total[~gone].sum()), n, int(total[again].sum()), alone[letter], good, toxic, shapley[letter]


ORDERS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: what that step keeps, removes, and loses.

    ``kept``: documents after the step; ``removed``: by it; ``redundant``: fail its filter and
    are gone before; ``unique_fails``: fail no other; ``good_lost`` and ``toxic_lost``:
    removed here, of quality 1 and toxic; ``shapley``: what its filter removes, summed
    over all orders. Counts come from one vector of masks a part, so the orders cost
    nothing per document. Up to some eight filters; an empty table gives no rows.
    """
    letters = "".join(filters) + COPY
    counts = mask_counts(filter_masks(docs, filters), labels, len(letters))
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: order_rows(x[0], x[1], letters)), ORDERS, verifySchema=False)
