"""Language identification: script ranges, per-word scores, Viterbi over the words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, kept, stored
from .words import chunks, cut, table_of

#: At most about so many training documents of each language, chosen by a hash.
TRAIN_DOCUMENTS = 1000
#: Weight of a word's trigrams beside its own counts, in occurrences.
BY_TRIGRAMS = 2.0
#: Natural log of how unlikely a change of language is from one word to the next.
SWITCH = 10.0
#: Least posterior of a language for one word.
FLOOR = 1e-3
#: A script is a language's own if it has this share of its letters.
SCRIPT_SHARE = 0.01

#: Unicode ranges of scripts: fixed values.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)

#: Letters, a run of which is a word.
_LETTERS = table_of(r"[^\W\d_]") & np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
#: Words whose rows a worker keeps.
_CACHE = 250_000


def script_of(word: str) -> str:
    """The script of a word's first letter; ``other`` outside the known ranges."""
    code = ord(word[0])
    if 0x41 <= code <= 0x24F:
        return "latin"
    return next((name for name, low, high in SCRIPTS if low <= code <= high), "other")


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Index of each word's language on the best path: sum of scores less ``switch`` a change.

    Most texts are in one language throughout, which bounds show. A path that visits the
    best language overall makes at least one change for each stretch in another, so if
    no stretch gains more than ``switch`` over it, none of these paths wins. A path that
    never visits it starts with one stretch, ends with another and makes one change
    less; it cannot win if the most that a start and an end gain together is no more
    than ``switch``. The other texts are walked word by word.
    """
    n, kinds = scores.shape
    best = int(scores.sum(0).argmax())
    if kinds == 1 or not n:
        return np.full(n, best)
    gain = np.cumsum(np.vstack((np.zeros((1, kinds)), scores - scores[:, [best]])), 0)
    stretch = (gain - np.minimum.accumulate(gain, 0)).max()
    ends = gain[1:].max() + (gain[-1] - gain[:-1]).max()
    if stretch <= switch and ends <= switch:
        return np.full(n, best)
    rows, back = scores.tolist(), np.empty((n, kinds), np.int32)
    state = rows[0]
    for i in range(1, n):
        top = max(range(kinds), key=state.__getitem__)
        change = state[top] - switch
        row = rows[i]
        for k in range(kinds):
            if state[k] >= change:
                back[i, k] = k
            else:
                back[i, k] = top
        state = [max(state[k], change) + row[k] for k in range(kinds)]
    path = np.empty(n, np.int64)
    path[-1] = max(range(kinds), key=state.__getitem__)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class LanguageModel:
    """What words and trigrams say of each language, and the scripts it is written in.

    ``words`` has for every word the languages it was seen in and how often, as two
    arrays from ``bounds[word]`` on; ``trigrams`` has counts by trigram and language.
    """

    def __init__(self, languages: list[str], words: dict[str, dict[int, int]], trigrams: dict[str, list[int]], scripts: dict[str, set[str]]):
        self.key, self.languages, self.scripts = uuid.uuid4().hex, languages, scripts
        self.words = {w: i for i, w in enumerate(words)}
        self.bounds = np.concatenate(([0], np.cumsum([len(c) for c in words.values()]))).astype(np.int64)
        self.seen_in = np.array([k for c in words.values() for k in c], np.int32)
        counts = np.array([n for c in words.values() for n in c.values()], np.float32)
        totals = np.maximum(np.bincount(self.seen_in, counts, len(languages)), 1)
        # As if every language had as many words.
        self.counts = (counts * (totals.mean() / totals)[self.seen_in]).astype(np.float32)
        table = np.array(list(trigrams.values()), np.float64).reshape(-1, len(languages))
        total = np.log(table.sum(0) + 0.5 * (len(trigrams) + 1))
        #: Row 0 is for trigrams outside the table.
        self.gram_ids = {g: i for i, g in enumerate(trigrams, 1)}
        self.grams = np.concatenate((np.log(0.5) - total[None], np.log(table + 0.5) - total)).astype(np.float32)
        self._fits = {}

    def rows(self, words: list[str]) -> np.ndarray:
        """Log posterior of every language for lower-case words.

        What a word's trigrams say counts like BY_TRIGRAMS occurrences of it, so words
        never or seldom seen are judged by their trigrams and common ones by themselves.
        Languages not written in a word's script are out; a word in a script of none is next to
        impossible in each of them, so it says nothing for or against any and adds nothing to a score.
        """
        at = [self.gram_ids.get(padded[k : k + 3], 0) for word in words for padded in (f" {word} ",) for k in range(len(word))]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.add.reduceat(self.grams[at], np.cumsum(sizes) - sizes, 0)
        p = np.exp(sums - sums.max(1, keepdims=True))
        found = (BY_TRIGRAMS / p.sum(1, keepdims=True) * p).astype(np.float32)
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        seen = np.flatnonzero(known >= 0)
        low, high = self.bounds[known[seen]], self.bounds[known[seen] + 1]
        entry = np.arange((high - low).sum()) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
        found[np.repeat(seen, high - low), self.seen_in[entry]] += self.counts[entry]
        found = np.log(np.maximum(found / found.sum(1, keepdims=True), FLOOR))
        fits = np.array([self.fits(script_of(w)) for w in words], bool).reshape(found.shape)
        found[~fits] = np.log(FLOOR)
        return found

    def fits(self, script: str) -> tuple[bool, ...]:
        """Which languages are written in a script."""
        if script not in self._fits:
            self._fits[script] = tuple(script in self.scripts[x] for x in self.languages)
        return self._fits[script]

    def scorer(self) -> Scorer:
        """The worker's scorer, kept from task to task."""
        return kept(("language", self.key), lambda: Scorer(self))


class Scorer:
    """A model with the rows of words seen lately."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.ids, self.table = {}, np.empty((1 << 15, len(self.model.languages)), np.float32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The rows of different words, as places in the table."""
        if len(self.ids) > _CACHE:
            self._forget()
        found = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            strange, first = [words[i] for i in new.tolist()], len(self.ids)
            while len(self.table) < first + len(new):
                self.table = np.concatenate((self.table, np.empty_like(self.table)))
            for at in range(0, len(new), 4096):
                part = strange[at : at + 4096]
                self.table[first + at : first + at + len(part)] = self.model.rows(part)
            found[new] = np.arange(first, first + len(new))
            self.ids.update(zip(strange, found[new].tolist(), strict=True))
        return found

    def labels(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """The main language, its score and the spans (from, to, language) of every text."""
        for some in chunks(texts):
            words = cut(some, _LETTERS)
            places, letters = self._learn(words.distinct), np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))
            for text, a, b in zip(some, words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
                index = words.index[a:b]
                yield self._label(text, self.table[places[index]], letters[index], words.starts[a:b])

    def _label(self, text: str, scores: np.ndarray, letters: np.ndarray, starts: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not len(scores):
            return "und", 0.0, []
        path = viterbi(scores)
        weights = np.bincount(path, letters, len(self.model.languages))
        best = int(weights.argmax())
        mine = path == best
        sure = float((np.exp(scores[mine, best]) * letters[mine]).sum() / letters.sum())
        changes = np.flatnonzero(np.diff(path)) + 1
        cuts = [0, *starts[changes].tolist(), len(text)]
        return self.model.languages[best], min(1.0, sure), [(a, b, self.model.languages[path[i]]) for a, b, i in zip(cuts, cuts[1:], [0, *changes.tolist()], strict=False)]


def train(documents: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """Learn from the text and lang of documents that are not held out.

    Of each language about ``per_language`` documents are used, whole, chosen by a hash
    of doc_id: the bound of the model, which goes to every task. Spark counts their words
    and trigrams; all of them are in the model.
    """
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel(["und"], {}, {}, {"und": set()})
    number = {x: i for i, x in enumerate(languages)}
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_language / n))) for x, n in sizes.items()])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    words = stored(
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")),
        "words",
    )
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))).alias("gram"))
    vocabulary: dict[str, dict[int, int]] = {}
    letters = {x: {} for x in languages}
    # As Arrow batches: no row object for each word.
    for batch in words.select("word", "lang", "n").toArrow().to_batches():
        for word, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            vocabulary.setdefault(word, {})[number[x]] = n
            letters[x][script_of(word)] = letters[x].get(script_of(word), 0) + n * len(word)
    scripts = {x: {s for s, n in of.items() if n >= SCRIPT_SHARE * sum(of.values())} for x, of in letters.items()}
    trigrams: dict[str, list[int]] = {}
    for batch in grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for gram, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trigrams.setdefault(gram, [0] * len(languages))[number[x]] = n
    return LanguageModel(languages, dict(sorted(vocabulary.items())), dict(sorted(trigrams.items())), scripts)


def label_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every whole text.

    ``lang_pred`` has the most letters on the best path of languages over the words;
    ``score`` is the mean posterior of those letters, others counting 0; ``spans`` are
    the stretches (from, to, lang) in code points. Null texts and texts without a
    letter are ``und``, score 0, no spans. Rows that repeat a doc_id are labelled each
    by itself; other columns are not read; ties go to the first language by name.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = list(scorer.labels(batch.column(1).to_pylist()))
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def identify_languages(documents: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and label all: doc_id, held_out, lang_pred, score, spans."""
    return label_languages(documents, train(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def in_known_language(documents: DataFrame, model: LanguageModel, least_score: float = 0.0) -> DataFrame:
    """The documents, all columns, that are not ``und`` and score ``least_score`` or more. Nothing is shuffled.

    Where no language was learned, none can be told from another, and all texts with a letter stay.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), documents.columns.index("text")
    learned = any(model.scripts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = scorer.labels(batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != "und" and score >= least_score if learned else bool(spans) for name, score, spans in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
