"""Statistics of scanned texts: printed page numbers, quality, citations, composition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.normalise import EPSILON, run_trigrams
from ..functions.predicates import roman_value
from ..functions.text import token_runs
from ..scratch import stored

#: Lines at either end of a page that may hold its number, and pages that a run needs.
EDGE_LINES, LEAST_RUN = 3, 8
#: Characters of a line that may be a number and nothing else.
SHORT_LINE = 24
#: What may stand around a page number, as a class of a pattern: fixed values.
_MARKS = r"\s\-—–ー()（）［\[\]］.,、。·・*"


def _edge_numbers(line: Column) -> Column:
    """The numbers that a line at a page's edge may give: array of struct(label, value).

    A short line that is a number, or a roman numeral, between marks gives that alone;
    any other line a number that a wide gap parts from the rest, at either end.
    """
    bare = F.regexp_extract(line, rf"^[{_MARKS}]*(\d{{1,4}})[{_MARKS}]*$", 1)
    roman = F.lower(F.regexp_extract(line, r"(?i)^[\s\-—–()]*([ivxlcdm]{1,7})[\s\-—–()]*$", 1))
    before, after = F.regexp_extract(line, r"^(\d{1,4})\s{3,}\S", 1), F.regexp_extract(line, r"\S\s{3,}(\d{1,4})$", 1)
    number = lambda label: F.when(label != "", F.struct(label.alias("label"), label.try_cast("long").alias("value")))
    short = F.length(line) <= SHORT_LINE
    by_letters = F.struct(roman.alias("label"), roman_value(roman).cast("long").alias("value"))
    return F.array_compact(F.when(short & (bare != ""), F.array(number(bare))).when(short & (roman != ""), F.array(F.when(by_letters["value"].isNotNull(), by_letters))).otherwise(F.array(number(before), number(after))))


def _edge(text: Column) -> Column:
    """A text as far as its first lines that are not blank go."""
    return F.regexp_extract(text, rf"^\s*\S[^\n]*(?:\n\s*\S[^\n]*){{0,{EDGE_LINES - 1}}}", 0)


def _lines(edge: Column) -> Column:
    """The lines that are not blank, without the white space of patterns around."""
    return F.filter(F.transform(F.split(edge, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def page_numbers(pages: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(book, page, label, value): printed numbers of pages (book, page, text).

    Candidates stand in the first or last lines of a page that are not blank. A number
    stands if at least ``least_run`` pages in a row give the same difference between
    number and page, and if no other such run numbers its page differently.
    """
    # Only the lines at the edges are cut. A null or empty text has none.
    edges = pages.select("book", "page", _edge(F.col("text")).alias("head"), F.reverse(_edge(F.reverse("text"))).alias("foot"))
    numbered = F.flatten(F.transform(F.concat(_lines(F.col("head")), _lines(F.col("foot"))), _edge_numbers))
    found = edges.select("book", "page", F.posexplode(numbered).alias("at", "c")).select("book", "page", "at", "c.label", "c.value").withColumn("shift", F.col("value") - F.col("page"))
    first = found.groupBy("book", "page", "shift").agg(F.min_by("label", "at").alias("label"), F.first("value").alias("value"))
    sized = first.withColumn("island", F.col("page") - F.row_number().over(Window.partitionBy("book", "shift").orderBy("page")))
    # Counted beside the pages, not joined to them: the texts are read once.
    claimed = sized.where("book is not null and shift is not null").withColumn("n", F.count("*").over(Window.partitionBy("book", "shift", "island"))).where(F.col("n") >= least_run)
    kept = claimed.groupBy("book", "page").agg(F.min(F.struct("value", "label")).alias("v"), F.max("value").alias("other")).where("v.value = other")
    return kept.select("book", "page", "v.label", "v.value")


def page_numbers_of_variants(pages: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(book, page, label, value, variant): numbers of a book's text variants (book, variant, page,
    text) together; for a page that several number, the first variant by name."""
    both = pages.select(F.struct("book", "variant").alias("book"), "page", "text")
    found = page_numbers(both, least_run).select("book.book", "book.variant", "page", "label", "value")
    return found.groupBy("book", "page").agg(F.min(F.struct("variant", "label", "value")).alias("f")).select("book", "page", "f.label", "f.value", "f.variant")


def placed_sections(sections: DataFrame, folios: DataFrame) -> DataFrame:
    """Sections (book, ord, title, page_start, page_end), printed pages turned to scanned ones.

    ``folios`` (book, page, value): of several scans of a printed page the first counts.
    ``problem`` names what is wrong: ``no_folio`` for a page without one, ``ends_early``
    for an end before the start, ``out_of_order`` for a start before that of the section
    before; it is null for a good section.
    """
    first = folios.where("value is not null").groupBy("book", "value").agg(F.min("page").alias("scan"))
    at = lambda name: first.select("book", F.col("value").alias(name), F.col("scan").alias(f"scan_{name[5:]}"))
    joined = sections.join(at("page_start"), ["book", "page_start"], "left").join(at("page_end"), ["book", "page_end"], "left")
    before = F.lag("scan_start").over(Window.partitionBy("book").orderBy("ord"))
    lost = F.col("scan_start").isNull() | (F.col("page_end").isNotNull() & F.col("scan_end").isNull())
    problem = F.when(lost, "no_folio").when(F.col("scan_end") < F.col("scan_start"), "ends_early").when(F.col("scan_start") < before, "out_of_order")
    return joined.withColumn("problem", problem).select("book", "ord", "title", "scan_start", "scan_end", "problem")


def preferred_variants(variants: DataFrame) -> DataFrame:
    """(book, variant): which text variant of a book is read, from (book, variant, reliability, preferred, ord).

    The best reliability wins; within it the one preferred now stays, else the first by ``ord``.
    """
    tier = F.when(F.col("reliability") == "sound", 0).when(F.col("reliability") == "unassessed", 1).otherwise(2)
    key = F.struct(tier.alias("tier"), (~F.coalesce("preferred", F.lit(False))).alias("other"), "ord", "variant")
    return variants.groupBy("book").agg(F.min(key).alias("k")).select("book", "k.variant")


def default_variants(coverage: DataFrame) -> DataFrame:
    """(book, variant): the preferred variant with text, else that of most pages, then by name, from
    (book, variant, status, preferred, pages)."""
    key = F.struct((~F.coalesce("preferred", F.lit(False))).alias("other"), (-F.coalesce("pages", F.lit(0))).alias("fewer"), "variant")
    return coverage.where("status <> 'none'").groupBy("book").agg(F.min(key).alias("k")).select("book", "k.variant")


def text_layers(pages: DataFrame, least_characters: int = 20, least_pages: int = 2) -> DataFrame:
    """(book, pages, with_text, extractable): whether half of a book's pages, two at least, hold text."""
    sums = pages.groupBy("book").agg(F.count("*").alias("pages"), F.count(F.when(F.length(F.trim("text")) > least_characters, 1)).alias("with_text"))
    return sums.withColumn("extractable", F.col("with_text") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * 0.5)))


def text_reliability(pages: DataFrame, least_line: float = 5, least_run: float = 2, least_cjk: int = 50) -> DataFrame:
    """(book, reliability, note): suspect texts; all others are unassessed, never sound.

    Suspect are books without text, of a median line under ``least_line`` characters,
    or of at least ``least_cjk`` ideographs and kana in runs of a median under ``least_run``.
    """
    lines = pages.select("book", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line")).select("book", F.trim("line").alias("line")).where("line <> ''")
    by_line = lines.groupBy("book").agg(F.percentile(F.length("line"), F.lit(0.5)).alias("line_median"))
    runs = lines.select("book", F.explode(F.regexp_extract_all("line", F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"), 0)).alias("run"))
    by_run = runs.groupBy("book").agg(F.sum(F.length("run")).alias("mass"), F.percentile(F.length("run"), F.lit(0.5)).alias("run_median"))
    joined = pages.select("book").distinct().join(by_line, "book", "left").join(by_run, "book", "left")
    note = F.when(F.col("line_median").isNull(), "no text").when(F.col("line_median") < least_line, "short lines").when((F.col("mass") >= least_cjk) & (F.col("run_median") < least_run), "broken characters")
    return joined.select("book", F.when(note.isNotNull(), "suspect").otherwise("unassessed").alias("reliability"), note.alias("note"))


def match_key(text: Column) -> Column:
    """Lower case letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def citation_matches(texts: DataFrame, catalogue: DataFrame, least_characters: int = 10, probe_words: int = 3, window: int = 60) -> DataFrame:
    """(doc_id, work_id, position, certainty): catalogue titles that texts mention.

    ``texts`` has doc_id and text, ``catalogue`` work_id, title, year and perhaps author.
    The first ``probe_words`` words of a title, or all of a shorter one, meet the same run of words
    in the texts by an equi-join; the title is then compared with the words that follow. Titles of
    fewer words need ``least_characters`` letters and digits. The work's year
    or a name of its author among the ``window`` letters and digits on either side makes
    a mention ``probable``, else it is a ``candidate``. Mentions within a longer one are
    left out, unless they alone are probable; of several of one work in a text the
    surest, first one stays. ``position`` counts words.
    """
    words = F.split(match_key(F.col("title")), " ")
    author = F.col("author") if "author" in catalogue.columns else F.lit(None).cast("string")
    names = F.filter(F.regexp_extract_all(F.lower(F.coalesce(author, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0), lambda x: F.length(x) >= 2)
    works = catalogue.select("work_id", "year", match_key(F.col("title")).alias("wanted"), names.alias("names"), words.alias("w")).where((F.col("wanted") != "") & ((F.size("w") >= probe_words) | (F.length(F.replace("wanted", F.lit(" "))) >= least_characters)))
    width = F.least(F.size("w"), F.lit(probe_words))
    works = works.select("work_id", "year", "wanted", "names", F.size("w").alias("size"), width.alias("width"), F.xxhash64(F.array_join(F.slice("w", F.lit(1), width), " ")).alias("probe"))
    split = texts.select("doc_id", F.split(match_key(F.col("text")), " ").alias("w"))
    met = None
    for n in sorted(r[0] for r in works.select("width").distinct().collect()):
        runs = split.where(F.size("w") >= n).select("doc_id", F.posexplode(F.transform(token_runs(F.col("w"), n), lambda r: F.xxhash64(r))).alias("i", "probe"))
        of_width = runs.join(works.where(F.col("width") == n).drop("width"), "probe")
        met = of_width if met is None else met.unionByName(of_width)
    if met is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, work_id long, position int, certainty string")
    # A text is read again only where a probe of it was found.
    hits = met.join(split, "doc_id").where(F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ") == F.col("wanted"))
    before = F.right(F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("i") - window + 1), F.least(F.col("i"), F.lit(window))), ""), F.lit(window))
    after = F.left(F.array_join(F.slice("w", F.col("i") + F.col("size") + 1, F.lit(window)), ""), F.lit(window))
    around = F.concat(before, F.lit(" "), F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), ""), F.lit(" "), after)
    sure = F.coalesce(around.contains(F.col("year").cast("string")), F.lit(False)) | F.exists("names", lambda x: F.contains(around, x))
    found = stored(hits.select("doc_id", "work_id", F.col("i").alias("position"), (F.col("i") + F.col("size")).alias("stop"), F.when(sure, "probable").otherwise("candidate").alias("certainty")), "mentions")
    inner, outer = found.alias("x"), found.select("doc_id", F.col("position").alias("p"), F.col("stop").alias("s"), F.col("certainty").alias("c"))
    longer = (outer["p"] <= F.col("x.position")) & (outer["s"] >= F.col("x.stop")) & (outer["s"] - outer["p"] > F.col("x.stop") - F.col("x.position"))
    free = inner.join(outer, (F.col("x.doc_id") == outer["doc_id"]) & longer & ~((outer["c"] == "candidate") & (F.col("x.certainty") == "probable")), "left_anti")
    best = free.groupBy("doc_id", "work_id").agg(F.min(F.struct((F.col("certainty") != "probable").alias("less"), "position", "certainty")).alias("b"))
    return best.select("doc_id", "work_id", F.col("b.position").alias("position"), F.col("b.certainty").alias("certainty"))


def composition(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang, chars, share): characters of each language, shares to three places."""
    sums = labelled.groupBy("doc_id", "lang").agg(F.sum("chars").alias("chars"))
    return sums.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy("doc_id")), 3))


#: Lines that open a list of references, and those that end one: whole lines, case folded.
HEADINGS = r"(?:(?:selected|general|annotated)\s+)?(?:references(?: cited)?|bibliography|works cited|literature(?: cited)?|参照文献|参考文献|引用文献|文献目録|文献一覧)"
ENDINGS = r"(?:index|appendix(?:\s+\w+)?|notes|afterword|acknowledge?ments?|索引|付録|あとがき|謝辞)"
#: Lines between two pages' running heads, characters of a section at least.
PAGE_LINES, LEAST_SECTION = (15, 120), 40


def _heading(line: str) -> str:
    """A line without page numbers, marks and numbering around it, case folded."""
    bare = re.sub(r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", "", unicodedata.normalize("NFKC", line).strip())
    bare = re.sub(r"^[\s\[【(§#*・■]*(?:(?:第\s*\d+\s*章|chapter\s+\d+|\d+(?:\.\d+)*)[.:)\s]*)?|[\s\]】):.*]*$", "", bare, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", re.sub(r"(?<=[぀-ヿ㐀-鿿])\s+(?=[぀-ヿ㐀-鿿])", "", bare)).strip().lower()


def reference_section(text: str, most: int | None = None) -> str | None:
    """The list of references of a document, without the heads and numbers of its pages.

    A heading that comes again a page further on is a running head: of such runs the
    longest opens the section, the latest of equals. It ends at a heading of another
    part, or with the text; a shorter one than LEAST_SECTION is none. ``most`` characters of it,
    if given; all of it otherwise.
    """
    lines = re.split(r"\r?\n", text)
    named = [_heading(x) if len(x) <= 80 else "" for x in lines]
    runs: list[list[int]] = []
    for at in (i for i, x in enumerate(named) if 0 < len(x) <= 40 and re.fullmatch(HEADINGS, x)):
        last = runs[-1][-1] if runs else None
        if last is not None and named[last] == named[at] and PAGE_LINES[0] <= at - last <= PAGE_LINES[1]:
            runs[-1].append(at)
        else:
            runs.append([at])
    if not runs:
        return None
    start = max(enumerate(runs), key=lambda r: (len(r[1]), r[0]))[1][0] + 1
    end = next((i for i in range(start + 3, len(lines)) if 0 < len(named[i]) <= 40 and re.fullmatch(ENDINGS, named[i])), len(lines))
    body = [x for x, name in zip(lines[start:end], named[start:end], strict=True) if not re.fullmatch(HEADINGS, name) and not re.fullmatch(r"\s*\d{1,4}\s*", x)]
    section = "\n".join(body).strip()[:most]
    return section if len(section) >= LEAST_SECTION else None


@F.pandas_udf(StringType())
def reference_sections(text: pd.Series) -> pd.Series:
    """``reference_section`` of a column; null stays null."""
    return text.map(reference_section, na_action="ignore")


def language_shares(lines: DataFrame, profiles: DataFrame, least_margin: float = 0.05, sure: tuple[float, float, int] = (0.5, 0.3, 4), fallback: str = "und") -> DataFrame:
    """(doc_id, lang, chars, share): the languages of texts by the trigrams of their words.

    ``lines``: doc_id, line_no, text. ``profiles``: lang, gram, cnt. A word whose best
    language leads by the first of ``sure``, of whose trigrams the second is known and
    that has the third of characters, stands for itself; all others of a line are judged
    together, and are ``fallback`` if no language leads by ``least_margin``. Trigrams no
    profile has say nothing. Trigrams never span words, so each different word is scored
    once, over all texts, and a line's scores are the sums of its words'.
    """
    words = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    scored, judged = word_scores(words.select("word").distinct(), profiles)
    alone = (F.col("margin") >= sure[0]) & (F.col("informative") / F.col("n") >= sure[1]) & (F.length("word") >= sure[2])
    known = judged(scored).withColumn("own", F.when(F.coalesce(alone, F.lit(False)), F.col("lang"))).drop("lang", "margin", "n")
    sums = [F.sum(c).alias(c) for c in known.columns if c not in ("word", "own")]
    parts = words.join(known, "word").groupBy("doc_id", "line_no", "own").agg(F.sum(F.length("word")).alias("chars"), *sums)
    pooled = F.when(F.col("margin") >= least_margin, F.col("lang"))
    return composition(judged(parts).select("doc_id", F.coalesce("own", pooled, F.lit(fallback)).alias("lang"), "chars"))


def word_scores(words: DataFrame, profiles: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(word, n, informative, s0, s1, ...) of different words, and what adds (lang, margin) to any sums of these scores.

    ``n`` trigrams, ``informative`` of which some profile has; null scores of a word without any.
    """
    profiles = stored(profiles, "profiles")
    totals = profiles.groupBy("lang").agg(F.sum("cnt").alias("total"))
    known = profiles.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "cnt"))).alias("by"))
    # One row of what every language makes of a trigram; there are few languages.
    sums = {r["lang"]: r["total"] for r in totals.collect()}
    names = sorted(sums)
    scored = known.select("gram", *[F.log10(F.coalesce(F.col("by")[x], F.lit(0)) / F.lit(sums[x]) + F.lit(EPSILON)).alias(f"s{i}") for i, x in enumerate(names)])
    grams = words.select("word", F.explode_outer(run_trigrams(F.array("word"))).alias("gram"))
    found = grams.join(scored, "gram", "left").groupBy("word").agg(F.count("gram").alias("n"), F.nullif(F.count("s0"), F.lit(0)).alias("informative"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    ranked = F.reverse(F.array_sort(F.array(*[F.struct((F.col(f"s{i}") / F.col("informative")).alias("score"), F.lit(x).alias("lang")) for i, x in enumerate(names)])))
    second = F.coalesce(F.get(ranked, F.lit(1))["score"], F.lit(float("-inf")))
    judged = lambda df: df.withColumn("r", ranked).withColumn("lang", F.col("r")[0]["lang"]).withColumn("margin", F.col("r")[0]["score"] - second).drop("r")
    return found, judged
