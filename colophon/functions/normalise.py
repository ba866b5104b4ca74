"""Normal forms of catalogue values: texts, names, identifiers, titles, classes; and citation formats."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .transliterate import folded_places, search_text  # noqa: F401

#: Named entities of feeds: fixed values.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "", "mdash": "—", "ndash": "–", "hellip": "…", "middot": "·", "times": "×", "deg": "°", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "laquo": "«", "raquo": "»", "Uuml": "Ü", "uuml": "ü", "Ouml": "Ö", "ouml": "ö", "Auml": "Ä", "auml": "ä", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "ccedil": "ç", "oslash": "ø"}
#: Spellings that stand for each other in search: fixed values.
SPELLINGS = (("tu", "tow"), ("ai", "ay", "a.i"), ("ui", "uy", "u.i"), ("ei", "ey", "e.i"), ("oi", "oy", "o.i"), ("au", "aw", "a.u"), ("iu", "iw", "i.u"), ("eu", "ew", "e.u"), ("ou", "ow", "o.u"))
#: Alternatives of a query word at which no more are looked for: fixed value.
MOST_SPELLINGS = 32
#: Scripts by the characters that show them, in the order they are named.
SCRIPTS = {"latn": "A-Za-z", "kana": "぀-ヿ", "kanji": "㐀-䶿一-鿿豈-﫿", "cyrl": "Ѐ-ӿ", "hang": "ᄀ-ᇿ가-힣"}
#: Added to a relative frequency before its logarithm, so that what was never seen has one: fixed value.
EPSILON = 1e-6


def _over_texts(kind, of):
    """A function over a text column; null stays null. Whole texts go to Python by the hundred, not by Arrow batches of 10,000."""
    return F.udf(lambda text: None if text is None else of(text), kind, useArrow=False)


def _unescaped(text: str) -> str:
    text = re.sub(r"\^\|\^([A-Za-z]+);", r"&\1;", text)
    number = lambda base: lambda m: chr(n) if (n := int(m[1], base)) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
    text = re.sub(r"&#(\d+);", number(10), re.sub(r"&#x([0-9a-fA-F]+);", number(16), text))
    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: ENTITIES.get(m[1], m[0]), text)


#: Entities of feeds, numbers and mangled ones included, as characters.
unescaped = _over_texts(StringType(), _unescaped)
#: NFC, one space for any white space; null if nothing is left.
plain_text = _over_texts(StringType(), lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", _unescaped(t))).strip() or None)
#: The same for prose, whose lines and paragraphs stay.
plain_prose = _over_texts(StringType(), lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\f\v]+", " ", unicodedata.normalize("NFC", _unescaped(t)))).strip() or None)


def _title_key(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"[^a-z0-9぀-ヿ一-龯Ѐ-ӿᄀ-ᇿ가-힣]+", "", bare)


#: What two spellings of a title share: letters and digits, no marks.
title_key = _over_texts(StringType(), _title_key)
#: Volume marks at the end of a title: fixed values.
_VOLUME = r"(乾巻|坤巻|乾|坤|上巻|下巻|上|下|前編|後編|[全]?[一二三四五六七八九十百\d]+巻|巻[上中下一二三四五六七八九十\d]*|[一二三四五六七八九十\d]+冊|第[一二三四五六七八九十\d]+冊?)$"
#: The same of a work's title without what is in brackets, and without a volume at its end.
core_title_key = _over_texts(StringType(), lambda t: _title_key(re.sub(_VOLUME, "", re.sub(r"\s+", "", re.sub(r"[（(][^）)]*[)）]", "", t)))))
#: Kana without its voicing marks.
unvoiced_kana = _over_texts(StringType(), lambda t: unicodedata.normalize("NFC", re.sub("[゙゚゛゜]", "", unicodedata.normalize("NFD", t))))


def _djb2(text: str) -> str:
    h = 5381
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h * 33 + unit) & 0xFFFFFFFF
    digits = ""
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits


#: A short stable hash in base 36.
short_hash = _over_texts(StringType(), _djb2)


def integer(value: Column) -> Column:
    """A number without its fraction; null for anything else."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def boolean(value: Column) -> Column:
    """``1`` and ``true`` are true, null and blank neither, anything else false."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""), text.isin("1", "true"))


def string_set(values: Column) -> Column:
    """The different texts of an array, trimmed, sorted; null if none is left."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")))
    return F.when(F.size(kept) > 0, kept)


def array_of(text: Column) -> Column:
    """A JSON array of strings; anything else is an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def core_text(text: Column) -> Column:
    """Lower case letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def scripts_shown(*texts: Column) -> Column:
    """The scripts that some texts together show; none of texts without letters of any."""
    whole = F.concat_ws(" ", *texts)
    return F.array_compact(F.array(*[F.when(whole.rlike(f"[{c}]"), F.lit(name)) for name, c in SCRIPTS.items()]))


def scripts_in(*texts: Column) -> Column:
    """The scripts of some texts together; Latin if none shows."""
    found = scripts_shown(*texts)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("latn")))


def script_runs(text: Column, script: str) -> Column:
    """The runs of one script in a text: Katakana, Latin (joined inside by marks), Cyrillic or ideographs."""
    patterns = {"kana": r"[\p{IsKatakana}ー゙゚゛゜]+", "latn": r"\p{IsLatin}+(?:['’=-]\p{IsLatin}+)*", "cyrl": r"\p{IsCyrillic}+", "jpn": r"[\p{IsHan}\p{IsHiragana}]"}
    return F.regexp_extract_all(text, F.lit(patterns[script]), 0)


def run_trigrams(runs: Column) -> Column:
    """Trigrams of runs, each padded by spaces and all pooled; those of one letter are left out."""
    unit = F.concat(F.lit(""), F.array_join(F.transform(runs, lambda r: F.concat(F.lit(" "), r, F.lit(" "))), ""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(unit) - 2, F.lit(1))), lambda i: F.substring(unit, i, F.lit(3)))
    return F.filter(grams, lambda g: F.length(F.trim(g)) >= 2)


def identifier(kind: Column, value: Column) -> Column:
    """struct(norm, valid) of an identifier: DOI, OpenAlex work, ISBN, ISSN; any other in lower case."""
    raw = F.trim(value)
    doi = F.lower(F.regexp_replace(F.regexp_replace(raw, r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", ""))
    work = F.upper(F.regexp_replace(raw, r"(?i)^https?://openalex\.org/", ""))
    bare = F.upper(F.regexp_replace(raw, r"[\s-]", ""))
    figures = F.transform(F.split(bare, ""), lambda c: F.when(c == "X", F.lit(10)).otherwise(c.try_cast("int")))
    summed = lambda weight: F.aggregate(F.transform(figures, lambda d, i: d * weight(i)), F.lit(0), lambda s, x: s + x)
    isbn10 = bare.rlike(r"^\d{9}[\dX]$") & (summed(lambda i: 10 - i) % 11 == 0)
    isbn13 = bare.rlike(r"^\d{13}$") & (summed(lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    issn = bare.rlike(r"^\d{7}[\dX]$") & (summed(lambda i: 8 - i) % 11 == 0)
    both = lambda norm, valid: F.struct(norm.alias("norm"), F.coalesce(valid, F.lit(False)).alias("valid"))
    return (
        F.when(kind == "doi", both(doi, doi.rlike(r"^10\.\d{4,9}/\S+$")))
        .when(kind == "openalex_work", both(work, work.rlike(r"^W\d+$")))
        .when(kind == "isbn", both(bare, isbn10 | isbn13))
        .when(kind == "issn", both(F.when(issn, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(bare), issn))
        .otherwise(both(F.lower(raw), F.length(raw) > 0))
    )


def spelling_alternatives(word: str) -> list[str]:
    """A query word with its spellings exchanged, breadth first, until there are MOST_SPELLINGS."""
    found, waiting = [word], [word]
    while waiting and len(found) < MOST_SPELLINGS:
        word = waiting.pop(0)
        for group in SPELLINGS:
            for form in group:
                for at in (m.start() for m in re.finditer(f"(?={re.escape(form)})", word)):
                    for other in group:
                        changed = word[:at] + other + word[at + len(form) :]
                        if changed not in found:
                            found.append(changed)
                            waiting.append(changed)
    return found


def phrase_alternatives(phrase: str) -> list[str]:
    """A phrase as written (NFC) and in search form, if they differ."""
    written = unicodedata.normalize("NFC", phrase)
    return list(dict.fromkeys([written, search_text(written)]))


def text_blocks(text: Column) -> Column:
    """A page's blocks, parted by blank lines."""
    return F.split(text, r"\r?\n[\t ]*\r?\n+")


def _occurrences(text: str, wanted: str) -> list[int]:
    found, at = [], text.find(wanted) if wanted else -1
    while at >= 0:
        found.append(at + 1)
        at = text.find(wanted, at + len(wanted))
    return found


def occurrences(text: Column, wanted: str) -> Column:
    """Where a text begins in another, from 1, not overlapping; one pass over each text."""
    return _over_texts(ArrayType(IntegerType()), lambda t: _occurrences(t, wanted))(text)


_SEGMENT = StructType([StructField("text", StringType()), StructField("highlighted", BooleanType())])


def highlighted(text: str, ranges: Iterable[tuple[int, int]]) -> list[tuple[str, bool]]:
    """A text in pieces, those within any of the ranges highlighted; overlapping ranges are one."""
    edges = sorted((max(0, min(len(text), a)), max(0, min(len(text), b))) for a, b in ranges)
    merged: list[list[int]] = []
    for a, b in edges:
        if b <= a:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    pieces, at = [], 0
    for a, b in merged:
        pieces += [(text[at:a], False)] if a > at else []
        pieces.append((text[a:b], True))
        at = b
    return pieces + ([(text[at:], False)] if at < len(text) else [])


@F.pandas_udf(ArrayType(_SEGMENT))
def highlights(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """``highlighted`` of a column, from arrays of starts (from 0) and their sizes."""
    found = []
    for t, a, n in zip(text, starts, sizes, strict=True):
        pieces = [] if t is None else highlighted(t, [(x, x + y) for x, y in zip(a if a is not None else [], n if n is not None else [], strict=True)])
        found.append([{"text": x, "highlighted": y} for x, y in pieces])
    return pd.Series(found)


_PERSON = StructType([StructField("family", StringType()), StructField("given", StringType()), StructField("key", StringType())])
_NO_PERSON = re.compile(r"(?i)^(?:unknown|anonymous|n/?a|none|various|et al\.?|\W*|\d+)$")


def _person(name: str) -> dict | None:
    bare = re.sub(r"\s+", " ", re.sub(r"[（(][^）)]*[)）]|\b\d{4}-?(?:\d{4})?\b", " ", unicodedata.normalize("NFKC", name))).strip(" ,;")
    if _NO_PERSON.match(bare):
        return None
    family, _, given = bare.partition(",") if "," in bare else (bare.rpartition(" ")[2], "", bare.rpartition(" ")[0])
    key = "".join(c for c in unicodedata.normalize("NFKD", f"{family} {given}") if unicodedata.category(c) != "Mn").lower()
    return {"family": family.strip(), "given": given.strip(), "key": " ".join(sorted(re.findall(r"\w+", key)))}


@F.pandas_udf(_PERSON)
def person(text: pd.Series) -> pd.DataFrame:
    """A person's name as struct(family, given, key), nulls for what names nobody; the key is the
    same in any order of the names."""
    none = dict.fromkeys(("family", "given", "key"))
    return pd.DataFrame([(None if t is None else _person(t)) or none for t in text], columns=list(none), dtype=object)


def authors(text: Column) -> Column:
    """The names in an author field, parted by the marks and words that part names.

    The middle point parts names only where all that it parts is ideographs; within kana it joins
    the parts of one name.
    """
    names = F.split(text, r"\s*(?:;|、|&|\||\band\b)\s*")
    parted = F.flatten(F.transform(names, lambda n: F.when(n.rlike(r"^\s*\p{IsHan}+(?:\s*・\s*\p{IsHan}+)+\s*$"), F.split(n, "・")).otherwise(F.array(n))))
    return F.filter(F.transform(parted, lambda n: F.trim(n)), lambda n: n != "")


def classes(text: Column, rules: dict[str, str]) -> Column:
    """The names of the rules (patterns, case folded) that a text meets, in the rules' order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in rules.items()]))


def without_broad(matched: Column, broad: tuple[str, ...]) -> Column:
    """Places (array of struct(slug, region)) less broad ones of a region that a narrower one is of."""
    return F.filter(matched, lambda p: ~(p["slug"].isin(*broad) & F.exists(matched, lambda q: ~q["slug"].isin(*broad) & (q["region"] == p["region"]))))


def file_record(path: Column) -> Column:
    """struct(year, author, title) of a file named ``YYYY_Author_Title``; words run together are parted."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    part = lambda i: F.regexp_extract(name, r"^(\d{4})[a-z]?_([^_]+)_(.+)$", i)
    apart = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " "), r"[_\s]+", " "))
    return F.struct(part(1).try_cast("int").alias("year"), F.nullif(apart(part(2)), F.lit("")).alias("author"), F.coalesce(F.nullif(apart(part(3)), F.lit("")), name).alias("title"))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**i, F.concat(F.format_number(n / 1024**i, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def year_label(start: Column, end: Column, certainty: Column) -> Column:
    """``c. 1890``, ``1901–1910``, ``1999`` or ``n.d.``."""
    span = F.when(end.isNotNull() & (end != start), F.concat(start.cast("string"), F.lit("–"), end.cast("string"))).otherwise(start.cast("string"))
    return F.coalesce(F.when(certainty == "estimated", F.concat(F.lit("c. "), span)).otherwise(span), F.lit("n.d."))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teens = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def csl_json(kind: Column, key: Column, title: Column, names: Column, year: Column) -> Column:
    """A CSL record as JSON; names are an array of struct(family, given)."""
    return F.to_json(F.struct(key.alias("id"), kind.alias("type"), title.alias("title"), names.alias("author"), F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued")))


def hayagriva(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A Hayagriva YAML entry; null and empty fields are left out, values are JSON strings."""
    quoted = lambda c: F.to_json(F.struct(c.cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.cast("string").alias("v")))) - 6)
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name}: "), quoted(c))) for name, c in fields.items()]
    return F.concat_ws("\n", F.concat(key, F.lit(":")), F.concat(F.lit("  type: "), kind), *lines)


def reference_line(names: Column, year: Column, title: Column) -> Column:
    """Names (year). Title."""
    return F.concat(F.concat_ws(", ", names), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), title, F.lit("."))
