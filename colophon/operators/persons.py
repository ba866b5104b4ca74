"""One person behind many spellings: parsed names, curated aliases, and clusters by shared keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..scratch import stored
from .graph import connected

#: Characters of East Asian names; a name's note in brackets; roles in brackets, in a reading and at a name's end. Fixed values.
CJK, BRACKETS = "[぀-ヿ㐀-鿿々ー〆]", r"^(.*?)\s*[(（]([^)）]+)[)）]\s*$"
ROLES = "(?i)^(rec|ed|comp|trans|tr|eds|録音?|編(訳|者|著|纂|輯)?|訳|採録|撰|選|輯|纂|著|校訂)\\.?$"
READING_ROLES = r"(?i)\b(ed|rec|comp|trans|tr|eds)\b\.?"
ENDINGS = "\\s*(編集|編著|編纂|編訳|共編|共著|校訂|監修|採録|口述|編者|著者|編|著|訳|撰|絵|画|写真|構成)$"
NOT_ONE = r"(?i)\b(et al|various|contributors|consortium|compiler)\b|[&/]"


@F.pandas_udf(StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, lower case; null stays null."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ").lower(), na_action="ignore")


def _squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*[(（][^)）]*[)）]", ""))


def _by_comma(text: Column) -> tuple[Column, Column, Column]:
    """Whether one comma parts a name in two, and the parts."""
    parts = F.split(text, ",")
    before, after = F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return (F.size(parts) == 2) & (before != "") & (after != ""), before, after


def _reading(text: Column) -> Column:
    """A Latin reading, family name first."""
    clean = _squashed(F.regexp_replace(F.regexp_replace(text, READING_ROLES, " "), r"\?", " "))
    one, before, after = _by_comma(clean)
    return F.when(one, F.concat(before, F.lit(" "), after)).otherwise(F.regexp_replace(clean, r"^([A-Za-zÀ-ÿ.'-]+) ([A-Za-zÀ-ÿ.'-]+)$", "$2 $1"))


def parsed(raw: Column) -> Column:
    """struct(name, reading): the name to show, and how it is read in Latin letters if the field says so.

    A role in brackets goes. Of a name and its bracketed counterpart the East Asian one is shown, the
    Latin one is its reading. East Asian names lose commas and roles at their end (two characters stay);
    "Family, Given" of one Latin name is turned. Latin names read as they are. Null gives nulls.
    """
    whole = _squashed(raw)
    matched = whole.rlike(BRACKETS)
    main, note = F.when(matched, F.regexp_extract(whole, BRACKETS, 1)).otherwise(whole), F.when(matched, F.trim(F.regexp_extract(whole, BRACKETS, 2)))
    role, cjk_main, cjk_note = F.coalesce(note.rlike(ROLES), F.lit(False)), main.rlike(CJK), F.coalesce(note.rlike(CJK), F.lit(False))
    latin_note, cyrillic_note = F.coalesce(note.rlike(r"\p{IsLatin}"), F.lit(False)), F.coalesce(note.rlike("[Ѐ-ӿ]"), F.lit(False))
    name = F.when(role, main).when(cjk_note & ~cjk_main, note).when(cjk_main & latin_note & ~cjk_note, main).when(cyrillic_note & ~cjk_main, main).otherwise(whole)
    reading = F.when(role, None).when(cjk_note & ~cjk_main, _reading(main)).when(cjk_main & latin_note & ~cjk_note, _reading(note)).when(cyrillic_note & ~cjk_main, main)
    spaced = _squashed(F.regexp_replace(name, r"\s*,\s*", " "))
    stripped = F.trim(F.regexp_replace(spaced, ENDINGS, ""))
    one, family, given = _by_comma(name)
    shown = F.when(name.rlike(CJK), F.when(F.length(stripped) >= 2, stripped).otherwise(spaced)).when(one & ~name.rlike(NOT_ONE), F.concat(given, F.lit(" "), family)).otherwise(name)
    return F.struct(shown.alias("name"), F.coalesce(reading, F.when(~shown.rlike(CJK), shown)).alias("reading"))


def candidate_forms(name: Column) -> Column:
    """The forms under which an alias table may know a name, the likeliest first: as written, without
    brackets, of "Family, Given" the family and the turned name, of two Latin words the swapped ones."""
    bare = _bare(name)
    one, family, given = _by_comma(bare)
    swapped = F.when(~bare.rlike(CJK) & bare.rlike(r"^\S+ \S+$"), F.regexp_replace(bare, r"^(\S+) (\S+)$", "$2 $1"))
    forms = F.array(name, bare, F.when(one, family), F.when(one, F.concat(given, F.lit(" "), family)), swapped)
    return F.array_distinct(F.filter(forms, lambda f: F.coalesce(f, F.lit("")) != ""))


def folded_form(form: Column) -> Column:
    """A form without marks, spaces and case."""
    return F.regexp_replace(unmarked(form), r"\s+", "")


def person_keys(name: Column, reading: Column) -> Column:
    """Keys that spellings of one person share: the name without spaces (of Latin ones the letters
    and digits), and the words of the reading without marks in any order."""
    latin = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    exact = F.when(name.rlike(CJK), F.regexp_replace(name, r"\s+", "")).when(latin != "", latin).otherwise(F.regexp_replace(F.lower(name), r"\s+", ""))
    read = F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(unmarked(reading), "[^a-z0-9]+", " "), " "), lambda w: w != "")), " ")
    return F.array_distinct(F.filter(F.array(F.concat(F.lit("x:"), exact), F.when(~reading.rlike(CJK) & (read != ""), F.concat(F.lit("r:"), read))), lambda k: k.isNotNull()))


def persons(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, name, reading, person, via): the person behind each different name.

    ``mentions``: raw. ``aliases``: form, person. Names that an alias knows are that person: exact
    forms before folded ones, of the name as written before the parsed one (``via`` alias). All
    others that share keys, over any number of steps, are one person (``keys``), the one whose aliased
    names have one of these keys if that is one person (``alias keys``). Where they belong to several,
    none is chosen (``ambiguous``). A person without alias is named by its smallest key. Of a form
    with several persons the smallest counts. Null and blank names are left out; names of an alias
    never link others to one another.

    Each different name is parsed once, and looked at once, by equi-joins on forms and keys alone.
    """
    raws = stored(mentions.select("raw").where("raw is not null and trim(raw) <> ''").distinct(), "raws")
    names = stored(raws.withColumn("p", parsed(F.col("raw"))).select("raw", "p.name", "p.reading"), "names")
    tagged = lambda of, rank: F.transform(candidate_forms(of), lambda f, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), f.alias("form")))
    forms = names.select("raw", F.explode(F.concat(tagged(F.trim("raw"), 0), tagged(F.col("name"), 1))).alias("f")).select("raw", "f.rank", "f.i", "f.form")
    both = lambda df, *kept: df.withColumn("fold", folded_form(F.col("form"))).select(*kept, F.explode(F.array(F.struct(F.lit(0).alias("folded"), F.col("form").alias("key")), F.struct(F.lit(1).alias("folded"), F.col("fold").alias("key")))).alias("k")).select(*kept, "k.folded", "k.key")
    known = both(aliases.where("form is not null and person is not null"), "person").groupBy("folded", "key").agg(F.min("person").alias("person"))
    found = both(forms, "raw", "rank", "i").join(known, ["folded", "key"]).groupBy("raw").agg(F.min(F.struct("rank", "folded", "i", "person")).alias("b")).select("raw", F.col("b.person").alias("canon"))
    keyed = stored(names.join(found, "raw", "left").withColumn("keys", person_keys(F.col("name"), F.col("reading"))), "persons")

    links = keyed.where("canon is null").select(F.concat(F.lit("n"), "raw").alias("a"), F.explode("keys").alias("key")).select("a", F.concat(F.lit("k"), "key").alias("b"))
    clusters = connected(links)
    owned = keyed.where("canon is not null").select("canon", F.explode("keys").alias("key")).groupBy("key").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    owners = clusters.where("node like 'k%'").select("component", F.substring("node", 2, 1 << 30).alias("key")).join(owned, "key").groupBy("component").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    open_names = clusters.where("node like 'n%'").select(F.substring("node", 2, 1 << 30).alias("raw"), "component").join(owners, "component", "left")
    whole = keyed.drop("keys").join(open_names, "raw", "left")
    one = F.col("least") == F.col("most")
    person = F.coalesce("canon", F.when(one, F.col("least")), F.substring("component", 2, 1 << 30))
    via = F.when(F.col("canon").isNotNull(), "alias").when(one, "alias keys").when(F.col("least").isNotNull(), "ambiguous").otherwise("keys")
    return whole.select("raw", "name", "reading", person.alias("person"), via.alias("via"))
