"""The languages a text is written in, decided by script first and by trigrams where scripts are shared."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..scratch import stored
from .textstats import composition

#: Characters that by themselves tell a language. Fixed values.
ANCHORS = {"jpn": r"[\p{IsHan}\p{IsHiragana}]", "rus": r"\p{IsCyrillic}"}
#: Scripts of several languages, with the language whose anchors beside an undecided run decide it. Fixed values.
SHARED = {"kana": "jpn", "latn": None}
#: Lead of a line's runs together, lead and characters of a run that stands alone, share of trigrams some
#: profile has, anchors that make a line their language's, frequency of a trigram never seen. Fixed values.
MARGIN, RUN_MARGIN, RUN_CHARS, COVERAGE, ANCHORED, UNSEEN = 0.05, 0.5, 4, 0.3, 2, 1e-6
#: Classes of characters: letters of the shared scripts, what may stand in their runs beside them, anchors.
CLASSES = {"kana": r"\p{IsKatakana}", "kana+": "[ー゙゚゛゜]", "latn": r"\p{IsLatin}", "latn+": "['’=-]", **ANCHORS}
#: Katakana by what is left of it without voicing marks.
_UNVOICED = {c: parts[0] for c in range(0x30A1, 0x30FF) if len(parts := unicodedata.normalize("NFD", chr(c))) > 1} | {ord(c): None for c in "゙゚゛゜"}
#: Columns of text in the rows of a line.
TOLD = ("channel", "own", "lead", "run")
#: Characters that a task holds at a time; a line is never parted.
SLICE_CHARACTERS = 2_000_000


@lru_cache(maxsize=1)
def _classes(spark: SparkSession) -> np.ndarray:
    """Bits of CLASSES by code point, as patterns of Spark tell them."""
    units = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    bits = sum(F.when(F.col("c").rlike(p), 1 << i).otherwise(0) for i, p in enumerate(CLASSES.values()))
    rows = units.select("id", bits.alias("bits")).where("bits > 0").toArrow()
    found = np.zeros(0x110000, np.uint8)
    found[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    return found


def _bit(name: str) -> int:
    return 1 << list(CLASSES).index(name)


class _Lines:
    """Lines of a batch in compatibility form: code points of all, one between lines, and their classes."""

    def __init__(self, batch: pa.RecordBatch, classes: np.ndarray):
        texts = [unicodedata.normalize("NFKC", t or "") for t in batch.column("text").to_pylist()]
        self.batch, size = batch, np.fromiter(map(len, texts), np.int64, len(texts))
        self.units = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
        self.kinds, self.first = classes[self.units], 1 + np.cumsum(size + 1) - size - 1
        self.last = self.first + size

    def characters(self, name: str) -> np.ndarray:
        """Characters of a class in each line."""
        sums = np.concatenate(([0], np.cumsum(self.kinds & _bit(name) > 0)))
        return sums[self.last] - sums[self.first]

    def runs(self, channel: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Each run's line, its number among the different ones, and these.

        Kana is without voicing marks and holds a letter, Latin in lower case and joined inside by single marks.
        """
        letter = self.kinds & _bit(channel) > 0
        joined = self.kinds & _bit(f"{channel}+") > 0
        if channel == "latn":
            inside = letter.copy()
            inside[1:-1] |= joined[1:-1] & letter[:-2] & letter[2:]
        else:
            inside = letter | joined
        edges = np.diff(inside.astype(np.int8))
        start, end = np.nonzero(edges == 1)[0] + 1, np.nonzero(edges == -1)[0] + 1
        if channel == "kana":
            sums = np.concatenate(([0], np.cumsum(letter & ~joined)))
            held = sums[end] > sums[start]
            inside[np.nonzero(inside)[0][~np.repeat(held, end - start)]] = False
            start, end = start[held], end[held]
        units = self.units[inside]
        # Where each run ends among the bytes of all.
        sizes = np.concatenate(([0], np.cumsum(1 + (units >= 0x80) + (units >= 0x800) + (units >= 0x10000))))
        ends = sizes[np.concatenate(([0], np.cumsum(end - start)))].astype(np.int32)
        written = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(units.tobytes().decode("utf-32-le").encode())).dictionary_encode()
        spelled = "\n".join(written.dictionary.to_pylist())
        spelled = spelled.translate(_UNVOICED) if channel == "kana" else spelled.lower()
        same = pa.array(spelled.split("\n") if len(written.dictionary) else [], pa.string()).dictionary_encode()
        codes = same.indices.to_numpy().astype(np.int64)[written.indices.to_numpy()]
        return np.searchsorted(self.first, start, "right") - 1, codes, same.dictionary


def _slices(batches: Iterable[pa.RecordBatch], classes) -> Iterator[_Lines]:
    """Lines of batches, about SLICE_CHARACTERS together, one line at least."""
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.searchsorted(held, np.arange(SLICE_CHARACTERS, held[-1], SLICE_CHARACTERS), "right") if len(held) else []
        ends = np.unique(np.concatenate((cuts, [batch.num_rows])).astype(np.int64)).tolist()
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            if end > start:
                yield _Lines(batch.slice(start, end - start), classes.value)


def _shared_classes(spark: SparkSession):
    return spark.sparkContext.broadcast(_classes(spark))


def runs_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, run): the runs of shared scripts in lines (keys, text).

    Kana is without voicing marks and holds a letter, Latin in lower case, both in compatibility form.
    """
    classes = _shared_classes(lines.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, classes):
            for channel in SHARED:
                line, codes, runs = part.runs(channel)
                yield pa.RecordBatch.from_arrays([*[part.batch.column(k).take(pa.array(line)) for k in keys], pa.array([channel] * len(line), pa.string()), runs.take(pa.array(codes))], names=[*keys, "channel", "run"])

    texts = lines.select(*keys, F.col("text").cast("string"))
    return texts.mapInArrow(run, StructType([*texts.schema.fields[:-1], StructField("channel", StringType()), StructField("run", StringType())]))


def _trigrams(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of runs, where each one's trigrams start, and the trigrams of all: one a character, padded by spaces, 21 bits each."""
    width = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    units = np.frombuffer((" " + " ".join(runs.to_pylist()) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
    return width, np.cumsum(width + 1) - width - 1, units[:-2] << 42 | units[1:-1] << 21 | units[2:]


def _spelled(grams: np.ndarray) -> list[str]:
    text = np.stack((grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF), 1).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _added(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(grams, return_inverse=True)
    return grams, np.bincount(at, n, len(grams)).astype(np.int64)


def _counted(classes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trigrams of a task's lines by channel and language; a different run of a slice is cut once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for part in _slices(batches, classes):
            lang = part.batch.column("lang").dictionary_encode()
            spoken = lang.indices.to_numpy()
            for channel in SHARED:
                line, codes, runs = part.runs(channel)
                if not len(runs):
                    continue
                width, first, grams = _trigrams(runs)
                # Between runs stands no trigram, and a run of one letter has none.
                of = np.repeat(np.arange(len(runs)), width)
                place = np.arange(len(of)) + np.repeat(first - (np.cumsum(width) - width), width)
                of, place = of[width[of] > 1], place[width[of] > 1]
                known, at = np.unique(grams[place], return_inverse=True)
                for i, x in enumerate(lang.dictionary.to_pylist()):
                    n = np.bincount(codes[spoken[line] == i], minlength=len(runs))
                    n = np.bincount(at, n[of], len(known)).astype(np.int64)
                    before = held.get((channel, x), (np.empty(0, np.int64), np.empty(0, np.int64)))
                    held[channel, x] = _added(np.concatenate((before[0], known[n > 0])), np.concatenate((before[1], n[n > 0])))
        for (channel, x), (grams, n) in held.items():
            yield pa.RecordBatch.from_pydict({"channel": pa.array([channel] * len(n), pa.string()), "lang": pa.array([x] * len(n), pa.string()), "gram": pa.array(_spelled(grams), pa.string()), "cnt": n})

    return run


def profiles_of(lines: DataFrame) -> DataFrame:
    """(channel, lang, gram, cnt): trigrams of attested lines (lang, text)."""
    attested = lines.where("lang is not null").select("lang", F.col("text").cast("string"))
    counted = attested.mapInArrow(_counted(_shared_classes(lines.sparkSession)), "channel string, lang string, gram string, cnt long")
    return counted.groupBy("channel", "lang", "gram").agg(F.sum("cnt").alias("cnt"))


def _verdict(names: list[str]) -> Column:
    """struct(lang, margin) of the sums of scores s0, s1, ...; null where no trigram is known."""
    mean = [F.struct((-F.col(f"s{i}") / F.col("informative")).alias("loss"), F.lit(x).alias("lang")) for i, x in enumerate(names)]
    ranked = F.array_sort(F.filter(F.array(*mean), lambda x: x["loss"].isNotNull()))
    second = F.coalesce(F.get(ranked, F.lit(1))["loss"], F.lit(float("inf")))
    return F.when(F.col("informative") > 0, F.struct(F.get(ranked, F.lit(0))["lang"].alias("lang"), (second - F.get(ranked, F.lit(0))["loss"]).alias("margin")))


def _scores_of(profiles: DataFrame) -> tuple[list[str], dict[str, tuple]]:
    """Languages, and of each channel its languages' numbers, its trigrams in order and their scores in each of these.

    A model of as many rows as scripts have different trigrams, which alphabets bound and texts do not.
    """
    kept = stored(profiles, "profiles")
    sums = {(r["channel"], r["lang"]): r["total"] for r in kept.groupBy("channel", "lang").agg(F.sum("cnt").alias("total")).collect()}
    names, model = sorted({x for _, x in sums}), {}
    for channel in SHARED:
        of = [i for i, x in enumerate(names) if (channel, x) in sums]
        if of:
            by = kept.where((F.col("channel") == channel) & (F.length("gram") == 3)).groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == names[i], F.col("cnt"))).alias(f"c{i}") for i in of])
            score = lambda i: F.round(F.log10(F.coalesce(F.col(f"c{i}"), F.lit(0)) / F.lit(sums[channel, names[i]]) + F.lit(UNSEEN)) * 1000000).cast("long")  # noqa: B023, E731
            rows = by.select("gram", *[score(i).alias(f"s{i}") for i in of]).toArrow()
            units = np.frombuffer("".join(rows["gram"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, 3).astype(np.int64)
            grams = units[:, 0] << 42 | units[:, 1] << 21 | units[:, 2]
            order = np.argsort(grams)
            model[channel] = of, grams[order], np.stack([rows[f"s{i}"].to_numpy() for i in of], 1)[order]
    return names, model


def _run_scores(runs: pa.Array, grams_known: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run its characters, trigrams, those of them some language has, the sums of their scores, its best language and that one's lead."""
    width, first, grams = _trigrams(runs)
    # The last row scores nothing: trigrams that no language has, and what stands between runs.
    scores = np.concatenate((np.concatenate((np.ones((len(scores), 1), np.int64), scores), 1), np.zeros((1, scores.shape[1] + 1), np.int64)))
    at = np.searchsorted(grams_known, grams)
    at[np.append(grams_known, -1)[at] != grams] = len(grams_known)
    at[(grams >> 21 & 0x1FFFFF) == 32] = len(grams_known)
    sums = np.where((width > 1)[:, None], np.add.reduceat(scores[at], first, 0), 0)
    told, sums = sums[:, 0], sums[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        loss = np.where((told > 0)[:, None], -sums / told[:, None], np.inf)
    lead = loss.argmin(1)
    ranked = np.sort(np.concatenate((loss, np.full((len(loss), 1), np.inf)), 1), 1)
    margin = np.where(told > 0, ranked[:, 1], 0) - np.where(told > 0, ranked[:, 0], 0)
    return width, np.where(width > 1, width, 0), told, sums, lead, margin


def _judged(shared, classes, names: list[str], guarded: set[tuple[str, str]], columns_of: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of lines, rows of three kinds: characters of a language, sums of a line's runs that do not stand alone, and runs to be looked up in a lexicon."""

    def table(batch: pa.RecordBatch, line: np.ndarray, columns: dict) -> pa.RecordBatch:
        kind = lambda name: batch.schema.field(name).type if name in ("doc_id", "line_no") else pa.string() if name in TOLD else pa.int64()
        columns |= {x: batch.column(x).take(pa.array(line)) for x in ("doc_id", "line_no") if x not in columns}
        return pa.RecordBatch.from_arrays([pa.array(columns[x], kind(x)) if x in columns else pa.nulls(len(line), kind(x)) for x in columns_of], names=columns_of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, classes):
            batch, anchored = part.batch, {x: part.characters(x) for x in ANCHORS}
            own = list(anchored.items())
            for channel in SHARED:
                line, codes, runs = part.runs(channel)
                if not len(runs):
                    continue
                of, grams_known, scores = shared.value.get(channel, ([], np.empty(0, np.int64), np.empty((0, 0), np.int64)))
                if of:
                    width, grams, told, sums, lead, margin = _run_scores(runs, grams_known, scores)
                    alone = (width >= RUN_CHARS) & (told > 0) & (margin >= RUN_MARGIN * 1000000) & (told >= COVERAGE * grams)
                    asked = alone & np.array([(channel, names[i]) in guarded for i in of])[lead]
                    for k, i in enumerate(of):
                        mine = (alone & ~asked & (lead == k))[codes]
                        own.append((names[i], np.bincount(line[mine], width[codes[mine]], batch.num_rows).astype(np.int64)))
                else:
                    width = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
                    grams, told, sums, alone, asked = np.where(width > 1, width, 0), np.zeros_like(width), np.empty((len(runs), 0), np.int64), np.zeros(len(runs), bool), np.zeros(len(runs), bool)
                each = np.concatenate((np.ones((len(runs), 1), np.int64), np.stack((width, grams, told), 1), sums), 1)
                named = ["chars", "grams", "informative", *[f"s{i}" for i in of]]
                beside = lambda at: {"channel": [channel] * len(at), **{f"n_{x}": n[at] for x, n in anchored.items()}}  # noqa: B023, E731
                # A line's sums: differences of running ones, whole numbers throughout.
                running = np.concatenate((np.zeros((1, each.shape[1]), np.int64), np.cumsum(np.where(alone[codes, None], 0, each[codes]), 0)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=batch.num_rows))))
                rest = running[ends[1:]] - running[ends[:-1]]
                at = np.nonzero(rest[:, 0])[0]
                yield table(batch, at, {**beside(at), **{x: rest[at, j + 1] for j, x in enumerate(named)}})
                if asked.any():
                    found = asked[codes]
                    pairs, n = np.unique(line[found] * len(runs) + codes[found], return_counts=True)
                    at, code = pairs // len(runs), pairs % len(runs)
                    yield table(batch, at, {**beside(at), "run": runs.take(pa.array(code)), "lead": [names[of[k]] for k in lead[code]], **{x: n * each[code, j + 1] for j, x in enumerate(named)}})
            for x, chars in own:
                at = np.nonzero(chars)[0]
                if len(at):
                    sums = pa.table({"doc_id": batch.column("doc_id").take(pa.array(at)), "chars": chars[at]}).group_by("doc_id").aggregate([("chars", "sum")]).combine_chunks()
                    none = np.zeros(sums.num_rows, np.int64)
                    yield table(batch, none, {"doc_id": sums["doc_id"].chunk(0), "line_no": pa.nulls(len(none), batch.schema.field("line_no").type), "own": [x] * len(none), "chars": sums["chars_sum"].chunk(0)})

    return run


def language_composition(lines: DataFrame, profiles: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, chars, share): how much of each text is in which language; ``und`` is undecided.

    ``lines``: doc_id, line_no, text; a null text has no characters, and a document without any
    gives no row. ``profiles``: channel, lang, gram, cnt. ``lexicon``: channel, lang, run.
    Characters of ANCHORS count for their language. Runs of a shared script are scored against
    the profiles of languages of that script alone. A run stands alone on strong evidence; a
    language with a lexicon, only for words of it. The other runs of a line and script are judged
    together, else the line's anchors decide. Lines that repeat (doc_id, line_no) count as one line.

    The profiles' trigrams go to the tasks, which read a line once and score each different run of
    some lines once. Trigrams never span runs, so a line's sums are those of its runs: only these
    sums are shuffled, and of runs those alone that a lexicon decides. Scores are whole millionths,
    so sums are the same in any order.
    """
    spark = lines.sparkSession
    names, model = _scores_of(profiles)
    sums_of = ["grams", "informative", *[f"s{i}" for i in range(len(names))]]
    anchors = [f"n_{x}" for x in ANCHORS]
    listed = None if lexicon is None else lexicon.select("channel", F.col("lang").alias("lead"), "run").distinct()
    guarded = set() if listed is None else {tuple(r) for r in listed.select("channel", "lead").distinct().collect()}
    texts = lines.select("doc_id", "line_no", F.col("text").cast("string"))
    # Rows of a language have no line: every column may be null.
    schema = StructType([*[StructField(f.name, f.dataType) for f in texts.schema.fields[:2]], *[StructField(x, StringType()) for x in TOLD], *[StructField(x, LongType()) for x in ("chars", *anchors, *sums_of)]])
    found = texts.mapInArrow(_judged(spark.sparkContext.broadcast(model), _shared_classes(spark), names, guarded, schema.names), schema)
    if guarded:
        found = stored(found, "line-runs")
        asked = found.where("run is not null").drop("own").join(listed.withColumn("own", F.col("lead")), ["channel", "lead", "run"], "left")
        found = found.where("run is null").unionByName(asked)
    parts = found.groupBy("doc_id", "line_no", "channel", "own").agg(*[F.max(x).alias(x) for x in anchors], *[F.sum(x).alias(x) for x in ["chars", *sums_of]])
    parts = parts.withColumn("v", _verdict(names) if names else F.lit(None).cast("struct<lang:string,margin:double>"))
    together = F.when((F.col("v.margin") >= MARGIN * 1000000) & (F.col("informative") >= COVERAGE * F.col("grams")), F.col("v.lang"))
    beside = F.coalesce(*[F.when((F.col("channel") == c) & (F.col(f"n_{x}") >= ANCHORED), F.lit(x)) for c, x in SHARED.items() if x])
    return composition(parts.select("doc_id", F.coalesce("own", together, beside, F.lit("und")).alias("lang"), "chars"))
