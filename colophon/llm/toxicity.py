"""Toxicity by the nearest labelled examples, found in a block-max inverted index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, kept, stored
from .words import chunks, cut, table_of

#: At most about so many labelled examples of each class, chosen by a hash of doc_id.
EXAMPLES = 2000
#: Added to a term's share of all documents before its weight is taken, so that the rarest of
#: words, of which every two texts share some by chance, weigh no more than those of one in 300.
SMOOTHING = 0.003
#: Neighbours that vote, examples in a block, blocks looked into at once.
NEIGHBOURS, BLOCK, STEP = 101, 256, 8
#: Texts whose common terms are multiplied at once.
AT_ONCE = 256
#: Neighbours, the nearest ones, that are given as evidence.
EVIDENCE = 10
#: Terms in this share of the examples are held as whole rows, not by block.
COMMON = 0.05
#: A word's first letters are a term too, so inflected forms meet.
PREFIX = 4

_LETTERS = table_of(r"[^\W\d_]")


def term_counts(texts: list[str | None], number) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of every text, by number, and how often each is in it.

    Terms are lower-case words and the starts of longer ones; ``number`` maps a list of
    terms to numbers, those below 0 being left out.
    """
    for some in chunks(texts):
        words = cut(some, _LETTERS)
        whole = number(words.distinct)
        start = number([w[:PREFIX] + "~" if len(w) > PREFIX else "" for w in words.distinct])
        text = np.repeat(np.arange(len(some)), np.diff(words.bounds))
        keys = np.concatenate((text << 32 | whole[words.index], text << 32 | start[words.index]))
        keys, counts = np.unique(keys[np.concatenate((whole[words.index], start[words.index])) >= 0], return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(some) + 1) << 32)
        terms = keys & 0xFFFFFFFF
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield terms[a:b], counts[a:b]


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples as postings by term and block of examples.

    ``highest`` is the largest weight of a term in a block, so a query's products with
    it bound the cosine of every example of the block. Blocks are looked into from the
    highest bound down, until none can hold a nearer example. Terms of very many
    examples are whole rows, of which the sum is taken exactly before any bound is.
    """

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        sizes = np.fromiter(map(len, vectors), np.int64, self.n)
        term = np.fromiter((t for v in vectors for t in v), np.int64, int(sizes.sum()))
        weight = np.fromiter((w for v in vectors for w in v.values()), np.float32, len(term))
        example = np.repeat(np.arange(self.n), sizes)
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) > max(BLOCK, COMMON * self.n))
        #: Row of a common term, or -1.
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        whole = self.row[term] >= 0
        self.rows = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.rows[self.row[term[whole]], example[whole]] = weight[whole]
        term, example, weight = term[~whole], example[~whole], weight[~whole]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        cells, first = np.unique(term * self.blocks + self.example // BLOCK, return_index=True)
        #: Cells of each term, and postings of each cell.
        self.cells = np.searchsorted(cells, np.arange(n_terms + 1) * self.blocks).astype(np.int32)
        self.block = (cells % self.blocks).astype(np.int32) if self.blocks else cells.astype(np.int32)
        self.start = np.concatenate((first, [len(term)])).astype(np.int32)
        self.highest = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)

    def by_common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms of some queries add to each example: one product of matrices."""
        dense = np.zeros((len(vectors), len(self.rows)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            dense[i, row[row >= 0]] = weights[row >= 0]
        return dense @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, leave: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine, and those; exact, ties to the first example.

        ``base``: the query's row of ``by_common``.
        """
        common = self.row[terms] >= 0
        scores = (self.by_common([(terms, weights)])[0] if base is None else base).astype(np.float64)
        terms, weights = terms[~common], weights[~common]
        low = self.cells[terms]
        sizes = self.cells[terms + 1] - low
        cell = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        factor, block = np.repeat(weights, sizes), self.block[cell]
        bounds = scores.reshape(-1, BLOCK).max(1) + np.bincount(block, factor * self.highest[cell], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(self.blocks, np.int64)
        place[order] = np.arange(self.blocks)
        turn, seen = place[block], np.zeros((self.blocks, BLOCK), bool)
        for at in range(0, self.blocks, STEP):
            if at:
                known = np.where(seen.ravel(), scores, 0.0)
                if leave >= 0:
                    known[leave] = 0
                kth = np.partition(known, -k)[-k] if len(known) >= k else 0.0
                if bounds[order[at]] < kth - 1e-6 or bounds[order[at]] <= 0:
                    break
            mine = (turn >= at) & (turn < at + STEP)
            low = self.start[cell[mine]]
            sizes = self.start[cell[mine] + 1] - low
            post = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            scores += np.bincount(self.example[post], self.weight[post] * np.repeat(factor[mine], sizes), len(scores))
            seen[order[at : at + STEP]] = True
        scores = np.where(seen.ravel(), scores, 0.0)[: self.n]
        if leave >= 0:
            scores[leave] = 0
        # All that may be among the best, then those in order.
        least = max(np.partition(scores, -k)[-k] if len(scores) > k else 0.0, np.nextafter(0, 1))
        some = np.flatnonzero(scores >= least)
        best = some[np.argsort(-scores[some], kind="stable")][:k]
        return best, scores[best]


class ToxicityModel:
    """Labelled examples in their vector space, and how votes become probabilities."""

    def __init__(self, examples: list[tuple[int, str, int]], ids: dict[str, int], frequencies: np.ndarray, n_documents: int, class_sizes: dict[int, int]):
        self.key, self.ids = uuid.uuid4().hex, ids
        share = frequencies / max(n_documents, 1)
        self.idf = np.log((1 + SMOOTHING) / (np.minimum(share, 1) + SMOOTHING)).astype(np.float32) + np.float32(1e-3)
        vectors = list(self.vectors([text for _, text, _ in examples]))
        # Examples that share their weightiest term stand together, which keeps bounds tight.
        key = [(y, int(v[0][v[1].argmax()]) if len(v[0]) else -1) for (_, _, y), v in zip(examples, vectors, strict=True)]
        order = sorted(range(len(examples)), key=lambda i: (key[i], examples[i][0]))
        self.doc_ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic = np.array([examples[i][2] for i in order], np.float64)
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex([dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in vectors], len(ids))
        #: Examples are as many of either class; votes count by how many documents each stands for.
        self.slope, self.shift = self._calibrated(vectors, class_sizes)

    def number(self, terms: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, terms, [-1] * len(terms)), np.int64, len(terms))

    def vectors(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for terms, counts in term_counts(texts, self.number):
            weights = (1 + np.log(counts.astype(np.float32))) * self.idf[terms]
            yield terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights

    def _with_common(self, texts: list[str | None]) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """The vectors of texts, each beside its row of the index's ``by_common``; some texts at once."""
        vectors = self.vectors(texts)
        while some := list(islice(vectors, AT_ONCE)):
            yield from zip(some, self.index.by_common(some), strict=True)

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the toxic among the neighbours, each weighted by its squared cosine."""
        weights = cosines**2
        return float((weights * self.toxic[best]).sum() / weights.sum()) if len(best) else 0.0

    def _calibrated(self, vectors, class_sizes: dict[int, int]) -> tuple[float, float]:
        """Logistic fit of labels on the votes that each example gets from the others.

        Examples of one class alone tell nothing apart: then all texts score as that class, next to 0
        or 1, and next to 0 without examples.
        """
        if len(set(self.toxic)) < 2:
            return 0.0, 20.0 if len(self.toxic) and self.toxic.all() else -20.0
        votes = np.array([self.vote(*self.index.nearest(t, w, leave=i)) for i, (t, w) in enumerate(vectors)])
        stands = np.where(self.toxic == 1, class_sizes[1] / self.toxic.sum(), class_sizes[0] / (1 - self.toxic).sum())
        stands /= stands.mean()
        x, fit = np.stack((votes, np.ones_like(votes)), 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ fit))
            curve = (x * (stands * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3])
            fit = fit + np.linalg.solve(curve, x.T @ (stands * (self.toxic - p)) - np.array([1e-2, 1e-3]) * fit)
        return float(fit[0]), float(fit[1])

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Probability that each text is toxic, and its neighbours with their cosines."""
        kept(("toxicity", self.key), dict)
        for (terms, weights), base in self._with_common(texts):
            best, cosines = self.index.nearest(terms, weights, base=base) if len(terms) and self.index.n else (np.zeros(0, np.int64), np.zeros(0))
            yield float(1 / (1 + np.exp(-(self.slope * self.vote(best, cosines) + self.shift)))), best, cosines


def _frequencies(texts: DataFrame, ids: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many of all texts hold each term, and how many texts there are."""
    shared = texts.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(len(shared.value) + 1, np.int64), shared.value
        number = lambda terms: np.fromiter(map(known.get, terms, [-1] * len(terms)), np.int64, len(terms))
        for batch in batches:
            for terms, _ in term_counts(batch.column(0).to_pylist(), number):
                sums[terms] += 1
            sums[-1] += batch.num_rows
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": found, "n": sums[found]})

    counted = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    sums = np.zeros(len(ids) + 1, np.int64)
    sums[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return sums[:-1], int(sums[-1])


def train(documents: DataFrame, labels: DataFrame, per_class: int = EXAMPLES) -> ToxicityModel:
    """Take examples among the labelled documents that are not held out.

    About ``per_class`` of each class, whole texts, chosen by a hash of doc_id: the
    bound of the index that goes to every task. Every term of the examples is in the
    space; how many documents hold each is counted over all of them.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 0))))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    examples = stored(texts.join(F.broadcast(chosen), "doc_id"), "examples").select("doc_id", "text", "toxic").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in examples.columns), strict=True))
    ids: dict[str, int] = {}
    number = lambda terms: np.fromiter((ids.setdefault(t, len(ids)) if t else -1 for t in terms), np.int64, len(terms))
    for _ in term_counts([text for _, text, _ in rows], number):
        pass
    return ToxicityModel(rows, ids, *_frequencies(texts.select("text"), ids), sizes)


def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, evidence) of every whole text.

    ``evidence`` lists the nearest examples that voted (doc_id, cosine, toxic), nearest first.
    A null or empty text, or one without a term of the space, has no evidence and the
    score that no toxic vote gives. Repeated rows are scored each by itself.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, found = shared.value, list(shared.value.scores(batch.column(1).to_pylist()))
            best, cosines = (np.concatenate([np.zeros(0), *(f[i][:EVIDENCE] for f in found)]) for i in (1, 2))
            best = best.astype(np.int64)
            struct = pa.StructArray.from_arrays([pa.array(model.doc_ids[best]), pa.array(cosines), pa.array(model.toxic[best].astype(np.int32))], fields=list(kind.value_type))
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(f[1][:EVIDENCE]) for f in found]))), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def judge_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted, evidence of all documents."""
    scored = score_documents(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below ``threshold``. Nothing is shuffled.

    A model of labels of one class tells nothing apart, so nothing goes.
    """
    if len(set(model.toxic)) < 2:
        return documents
    spark = documents.sparkSession
    bounded_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score < threshold for score, _, _ in shared.value.scores(batch.column(at).to_pylist())], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
