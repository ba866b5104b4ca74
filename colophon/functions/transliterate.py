"""Kana and Cyrillic in Latin letters, search forms with the places they came from, and slugs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Hepburn readings of hiragana: fixed values.
HEPBURN = (
    ("あいうえお", "a i u e o"),
    ("かきくけこ", "ka ki ku ke ko"),
    ("さしすせそ", "sa shi su se so"),
    ("たちつてと", "ta chi tsu te to"),
    ("なにぬねの", "na ni nu ne no"),
    ("はひふへほ", "ha hi fu he ho"),
    ("まみむめも", "ma mi mu me mo"),
    ("やゆよ", "ya yu yo"),
    ("らりるれろ", "ra ri ru re ro"),
    ("わゐゑを", "wa wi we o"),
    ("がぎぐげご", "ga gi gu ge go"),
    ("ざじずぜぞ", "za ji zu ze zo"),
    ("だぢづでど", "da ji zu de do"),
    ("ばびぶべぼ", "ba bi bu be bo"),
    ("ぱぴぷぺぽ", "pa pi pu pe po"),
    ("ゔ", "vu"),
    ("ぁぃぅぇぉ", "a i u e o"),
    ("ゃゅょゎ", "ya yu yo wa"),
    ("ゕゖ", "ka ke"),
)
#: Readings for search where they differ: after consonants as written, so that what is read in other
#: ways too meets its Latin spelling; and small kana that close a syllable.
AS_WRITTEN = (
    ("しちつふ", "si ci tu hu"),
    ("じぢづ", "zi di du"),
    ("を", "wo"),
    ("ㇰㇱㇲㇳㇴ", "k s s t n"),
    ("ㇵㇶㇷㇸㇹ", "h h h h h"),
    ("ㇺㇻㇼㇽㇾㇿ", "m r r r r r"),
    ("っん", "t n"),
)
#: Kana whose mark no one character has.
MARKED = {"ㇷ゚": "p", "と゚": "tu", "つ゚": "tu", "せ゚": "ce"}
#: Cyrillic letters: fixed values.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split(), strict=True)) | {"ъ": "", "ь": ""}
#: Latin letters that do not part into a letter and a mark: fixed values.
LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
#: Marks that stand for an apostrophe: fixed values.
APOSTROPHES = "`´ʹʼ՚‘’‛＇"

#: Small kana that change the syllable before them.
_SMALL = "ぁぃぅぇぉゃゅょゎ"
_TO_HIRAGANA = {c: c - 0x60 for c in range(ord("ァ"), ord("ヶ") + 1)}
#: A syllable: what it doubles, its first kana, the small ones after it.
_SYLLABLE = re.compile(f"(っ*)(?:([ーん])|([^っーん])([{_SMALL}]*))")
#: The same for search, with a voicing mark that no character has within it.
_SEARCHED = re.compile(f"([^{_SMALL}ー][゙゚]?)([{_SMALL}]*)|[{_SMALL}ー]")
_RUN = re.compile("[ぁ-ゖ゙-゜ァ-ヺ・ーㇰ-ㇿｦ-ﾟ]+")
_SLUG_RUN = re.compile("[ぁ-ヿ]+")


def _readings(*tables) -> dict[str, str]:
    return {kana: reading for table in tables for row, readings in table for kana, reading in zip(row, readings.split(), strict=True)}


_HEPBURN, _SEARCH = _readings(HEPBURN), _readings(HEPBURN, AS_WRITTEN) | MARKED


@lru_cache(maxsize=1 << 14)
def _syllable(first: str, small: str, hepburn: bool) -> str:
    """The reading of a kana and the small ones after it."""
    table = _HEPBURN if hepburn else _SEARCH
    parts = [table.get(first) or table.get(first[0], first)]
    for kana in small:
        own, last = table[kana], parts[-1]
        if kana in "ゃゅょ" and last.endswith("i") and last != "i":
            stem = last[:-1]
            parts[-1] = stem + (own[1:] if re.search("(?:sh|ch|j|c)$", stem) else own)
        elif kana not in "ゃゅょ" and len(last) > 1 and last[-1] in "aiueo":
            parts[-1] = last[:-1] + own
        elif not hepburn and last in ("u", "i") and kana in "ぁぃぅぇぉ":
            parts[-1] = {"u": "w", "i": "y"}[last] + own
        else:
            parts.append(own)
    return "".join(parts)


def kana_to_romaji(run: str) -> str:
    """A run of kana in Hepburn letters: doubled consonants written, long vowels once."""
    out: list[str] = []
    for doubled, alone, first, small in _SYLLABLE.findall(run.translate(_TO_HIRAGANA)):
        if alone:
            last = "".join(out[-1:])[-1:]
            out.append("n" if alone == "ん" else last if last in tuple("aiueo") else "")
        else:
            read = _syllable(first, small, True)
            out.append(read[0] + read if doubled and first in _HEPBURN else read)
    return re.sub(r"([aiueo])\1", r"\1", "".join(out).replace("ou", "o"))


def _fold(text: str) -> str:
    """Marks off, lower case letter by letter, sharp s as ss, one apostrophe."""
    text = text.translate(_ONE_APOSTROPHE)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").replace("Σ", "σ")
    return text.lower().replace("ß", "ss")


_ONE_APOSTROPHE = dict.fromkeys(map(ord, APOSTROPHES), "'")


def kana_pieces(run: str, start: int = 0) -> list[tuple[str, int, int]]:
    """The syllables of a run of kana for search: what each reads as, and from where to where it stands.

    Longest match first: a kana takes the small ones after it. A voicing mark that stands alone belongs to the kana before it.
    """
    # Composed, with the place of each character in the run.
    clusters = [(unicodedata.normalize("NFKC", m[0]), m.start(), m.end()) for m in re.finditer("[^゙゚ﾞﾟ][゙゚ﾞﾟ]|.", run)]
    whole = "".join(c for c, _, _ in clusters).translate(_TO_HIRAGANA)
    starts = [a + k for c, a, _ in clusters for k in range(len(c))]
    ends = [b - (len(c) - 1 - k) for c, _, b in clusters for k in range(len(c))]
    found = []
    for m in _SEARCHED.finditer(whole):
        first, small = (m[1], m[2]) if m[1] else (m[0], "")
        read = "" if first == "ー" else " " if first == "・" else _fold(_syllable(first, small, False))
        found.append((read, start + starts[m.start()], start + ends[m.end() - 1]))
    return found


def search_pieces(text: str) -> list[tuple[str, int, int]]:
    """The search form of a text in pieces, each with the place it came from."""
    found, at = [], 0
    for run in [*_RUN.finditer(text), None]:
        for k in range(at, run.start() if run else len(text)):
            found.append((_fold(text[k]), k, k + 1))
        if run:
            found += kana_pieces(run[0], run.start())
            at = run.end()
    return found


def search_text(text: str) -> str:
    """Search form: kana in Latin letters, marks off, lower case, one apostrophe, sharp s as ss."""
    if text.isascii():
        return _fold(text)
    found, at = [], 0
    for run in _RUN.finditer(text):
        found += [_fold(text[at : run.start()]), *(read for read, _, _ in kana_pieces(run[0]))]
        at = run.end()
    return "".join([*found, _fold(text[at:])])


def slug_of(text: str, most: int = 60) -> str:
    """Lower-case ASCII letters and digits in hyphens, cut between words; kana and Cyrillic in Latin letters."""
    plain = _SLUG_RUN.sub(lambda m: f" {kana_to_romaji(m[0])} ", unicodedata.normalize("NFKC", text)).lower()
    plain = "".join(CYRILLIC.get(c, c) for c in plain)
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", plain))
    plain = "".join(LETTERS.get(c, c) for c in plain)
    whole = re.sub(r"[^a-z0-9]+", "-", re.sub("['’\"]", "", plain)).strip("-")
    if len(whole) <= most:
        return whole
    head = whole[: most + 1]
    cut = head.rfind("-")
    return (head[:cut] if cut > 0 else whole[:most]).rstrip("-")


def _over(kind, of):
    """A function over a text column; null stays null. Whole texts go to Python by the hundred, not by Arrow batches of 10,000."""
    return F.udf(lambda text: None if text is None else of(text), kind, useArrow=False)


def _places(text: str) -> list[int]:
    return [*(at for piece, at, _ in search_pieces(text) for _ in piece), len(text)]


def _ends(text: str) -> list[int]:
    return [end for piece, _, end in search_pieces(text) for _ in piece]


#: ``search_text`` of a column; null stays null.
fold = _over(StringType(), search_text)
#: For each place of a text's search form, where in the text what stands there begins; one more for the end.
folded_places = _over(ArrayType(IntegerType()), _places)
#: For each place of a text's search form, where in the text what stands there ends.
folded_ends = _over(ArrayType(IntegerType()), _ends)
#: ``slug_of`` a column.
slug = _over(StringType(), slug_of)


def folded_ranges(wanted: str):
    """An Arrow function: (start, stop), from 0, of each place in a text whose search form holds a phrase's, not overlapping."""
    asked = search_text(wanted)

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def ranges(text: pd.Series) -> pd.Series:
        found = []
        for t in text:
            pieces = [] if t is None or not asked else search_pieces(t)
            whole = "".join(p for p, _, _ in pieces)
            starts, stops = [a for p, a, _ in pieces for _ in p], [b for p, _, b in pieces for _ in p]
            own, at = [], whole.find(asked) if asked else -1
            while at >= 0:
                own.append({"start": starts[at], "stop": stops[at + len(asked) - 1]})
                at = whole.find(asked, at + len(asked))
            found.append(None if t is None else own)
        return pd.Series(found)

    return ranges
