"""Column predicates and small scalar expressions of the catalogue."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values of roman letters, and the least number that no page has in them: fixed values.
ROMAN, ROMAN_LIMIT = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}, 400


def any_contains(columns: list[Column], text: str) -> Column:
    """Substring search over several columns, case folded; blank text matches all."""
    text = text.strip().lower()
    return reduce(or_, (F.coalesce(F.lower(c).contains(text), F.lit(False)) for c in columns)) if text else F.lit(True)


def any_of(array: Column, wanted: list) -> Column:
    """An array column holds one of the wanted values; no values match all."""
    return F.arrays_overlap(array, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def is_blank(column: Column) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def null_if_blank(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def century_of(year: Column) -> Column:
    """1 for the years 1 to 100; floors, so also before the common era."""
    return (F.floor((year - 1) / 100) + 1).cast("int")


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def era_label(year: Column, first: int = 1900) -> Column:
    """``pre-1900`` or the decade as ``1950s``; null stays null."""
    return F.when(year < first, F.lit(f"pre-{first}")).when(year.isNotNull(), F.concat(decade_of(year).cast("string"), F.lit("s")))


def bucket_label(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound that the value is below, else ``last``."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        label = label.when(value < bound, F.lit(name))
    return label.otherwise(F.lit(last))


def safe_url(url: Column) -> Column:
    """http and https alone, after control characters and blanks at the ends are gone."""
    return F.lower(F.regexp_replace(url, r"[\u0000-\u001F\u007F]", "")).rlike(r"^\s*https?://[^/\s]")


def isbn13_valid(digits: Column) -> Column:
    """Thirteen digits whose weighted sum is a multiple of ten."""
    figures = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    total = F.aggregate(F.transform(figures, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b)
    return F.when(digits.rlike(r"^\d{13}$"), total % 10 == 0).otherwise(F.lit(False))


def years_in(text: Column, first: int = 1500, last: int = 2100) -> Column:
    """The four-digit years of a text within bounds, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4})"), 1), lambda y: y.cast("int"))
    return F.filter(found, lambda y: (y >= first) & (y <= last))


def year_span(text: Column) -> Column:
    """struct(start, end, certainty): one year has no end; several give the first and the last."""
    years = years_in(text)
    several = F.size(years) > 1
    guessed = text.rlike(r"(?i)c\.|ca\.|頃|ごろ|\?|推定|circa")
    kind = F.when(F.coalesce(F.size(years), F.lit(0)) <= 0, "unknown").when(guessed, "estimated").when(several, "range").otherwise("exact")
    return F.struct(F.array_min(years).alias("start"), F.when(several, F.array_max(years)).alias("end"), kind.alias("certainty"))


def roman_value(numeral: Column) -> Column:
    """Value of a roman numeral, a letter before a larger one counting against; null for
    anything else, and from ROMAN_LIMIT on."""
    letters = F.split(F.lower(numeral), "")
    value = lambda c: F.coalesce(*[F.when(c == x, F.lit(n)) for x, n in ROMAN.items()], F.lit(0))
    figures = F.transform(letters, value)
    following = F.concat(F.slice(figures, F.lit(2), F.size(figures)), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(figures, following, lambda v, n: F.when(v < n, -v).otherwise(v)), F.lit(0), lambda s, v: s + v)
    return F.when(numeral.rlike(r"(?i)^[ivxlcdm]+$") & (total > 0) & (total < ROMAN_LIMIT), total)


def decoded_entities(text: Column) -> Column:
    """The five named entities of XML and the no-break space; ampersands last."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text
