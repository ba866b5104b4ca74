"""Searches from a stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalise import spelling_alternatives
from ..operators import fuzzy as Z
from ..operators import postings as I
from ..operators.search import query_words
from ..schema import table
from .registry import query


def _lower(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


def _gram_score(grams: list[str]) -> str:
    tf = [f"(length(t) - length(replace(t, '{g}', ''))) // 3" for g in grams]
    counts = ", ".join(f"{x} as t{i}" for i, x in enumerate(tf))
    dfs = ", ".join(f"count(*) filter (t{i} > 0) as d{i}" for i in range(len(grams)))
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(grams)))
    some = " + ".join(f"t{i}" for i in range(len(grams)))
    return f"""
with t as (select doc_id, lower(text) as t from documents), c as (select doc_id, greatest(length(t) - 2, 0) as n, {counts} from t),
z as (select count(*) as docs, avg(n) as mean, {dfs} from c)
select doc_id, round({score}, 6) as score from c, z where {some} > 0 order by score desc, doc_id limit 20"""


_BM25 = "licensed under"


@query(_gram_score(sorted({_BM25[i : i + 3] for i in range(len(_BM25) - 2)})))
def trigram_bm25(spark, d):
    return I.PostingsIndex.write(_lower(spark, d)).bm25(_BM25)


@query("""
with p as (select item_id as query_id, lower(text) as wanted from benchmark union all select -1, 'under the' union all select -2, 'of the' union all select -3, 'not there at all' union all select -4, '  ')
select query_id, doc_id, cast((length(lower(text)) - length(replace(lower(text), wanted, ''))) / length(wanted) as bigint) as hits, cast(strpos(lower(text), wanted) as bigint) as position
from documents join p on length(wanted) >= 3 and contains(lower(text), wanted)""")
def phrase_by_postings(spark, d):
    some = spark.createDataFrame([(-1, "under the"), (-2, "of the"), (-3, "not there at all"), (-4, "  ")], "query_id long, text string")
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("text")).unionByName(some)
    found = I.PostingsIndex.write(_lower(spark, d)).phrases(phrases)
    return found.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.min("start").alias("position"))


def _chunks(spark, d):
    """Documents as chunks of pages in up to three variants, some of an older generation."""
    docs = table(spark, d, "documents").where("doc_id % 9 <> 4")
    variant = F.element_at(F.array(*map(F.lit, ("ocr", "edited", "layout"))), (F.col("doc_id") % 3 + 1).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 6).alias("revision_id"), variant.alias("variant"), F.floor(F.col("doc_id") % 6 / 3).alias("page"), F.lit(0).alias("block"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("generation"), "text")
    states = chunks.groupBy("revision_id", "variant").agg(F.max("generation").alias("active_generation"))
    preferred = chunks.where("revision_id % 2 = 0").select("revision_id", F.lit("layout").alias("variant")).distinct()
    return chunks, states, preferred


@query("""
with chunks as (select doc_id as chunk_id, doc_id // 6 as revision_id, ['ocr', 'edited', 'layout'][(doc_id % 3 + 1)::int] as variant, doc_id % 6 // 3 as page, case when doc_id % 5 = 0 then 1 else 2 end as generation, text,
                       replace(strip_accents(lower(text)), 'ß', 'ss') as norm from documents where doc_id % 9 <> 4),
states as (select revision_id, variant, max(generation) as generation from chunks group by 1, 2),
live as (select c.* from chunks c join states using (revision_id, variant, generation)),
chosen as (select c.*, coalesce((select max('edited') from live e where e.variant = 'edited' and e.revision_id = c.revision_id and e.page = c.page),
                       (select min(s.variant) from states s where s.variant = 'layout' and s.revision_id % 2 = 0 and s.revision_id = c.revision_id), (select min(s.variant) from states s where s.revision_id = c.revision_id)) as want from live c),
every as (select count(*) as docs, avg(greatest(length(norm) - 2, 0)) as mean, count(*) filter (contains(norm, 'of the')) as df from chunks),
hits as (select chunk_id, revision_id, page, c.variant, text, variant = want as shown, (length(norm) - length(replace(norm, 'of the', ''))) // 6 as hits, greatest(length(norm) - 2, 0) as n from chosen c where contains(norm, 'of the')),
ranked as (select *, round(-(case when ln((docs - df + 0.5) / (df + 0.5)) > 0 then ln((docs - df + 0.5) / (df + 0.5)) else 1e-6 end) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n / mean)), 6) as rank from hits, every where shown),
pages as (select * from (select *, row_number() over (partition by revision_id, page order by rank, chunk_id) as k from ranked) where k = 1),
capped as (select *, count(*) over () as found from pages order by rank, chunk_id limit 100)
select rank, chunk_id, revision_id, page, variant, hits, substr(text, greatest(1, case when strpos(text, 'OF the') > 0 then strpos(text, 'OF the') when strpos(text, 'of the') > 0 then strpos(text, 'of the') else 1 end - 30), 100) as snippet,
       least(found, 100) as total, found > 100 as truncated
from capped order by rank, chunk_id limit 40""")
def archive_search(spark, d):
    chunks, states, preferred = _chunks(spark, d)
    index = I.PostingsIndex.write(I.search_form(chunks, "chunk_id"))
    return I.search_archive(index, I.searchable(chunks, states, preferred), "OF the", limit=40, cap=100, before=30, width=100)


_SOFT = "theai mouday"
_TOKEN = r"[\p{L}\p{N}]+(?:[''.][\p{L}\p{N}]+)*"


@query(rf"""
with t as (select distinct doc_id, unnest(regexp_extract_all(replace(strip_accents(lower(translate(text, '`´ʹʼ՚‘’‛＇', repeat(chr(39), 9)))), 'ß', 'ss'), '{_TOKEN}')) as word from documents),
a(query_word, asked) as (values {", ".join(f"('{w}', '{a}')" for w in sorted(query_words(_SOFT)) for a in spelling_alternatives(w))}),
m as (select query_word, word, 1 - min(damerau_levenshtein(word, asked)) * 1.0::double / greatest(length(query_word), length(word)) as score from (select distinct word from t), a
      where abs(length(word) - length(asked)) <= 2 and damerau_levenshtein(word, asked) <= 2 group by query_word, word),
b as (select doc_id, query_word, arg_min(struct_pack(score := round(score, 6), word := word), struct_pack(less := -score, word := word)) as best from t join m using (word) group by all)
select doc_id, round(1 - sum(best.score) / count(*), 6) as rank, string_agg(query_word || '=' || best.word || ':' || cast(round(best.score * 1000) as int), ' ' order by query_word) as alignments from b group by 1 having count(*) = 2""")
def soft_search_alternatives(spark, d):
    hits = Z.soft_hits(Z.WordDictionary.write(I.search_form(table(spark, d, "documents"))), _SOFT, "loose", free=True)
    said = F.array_join(F.transform("alignments", lambda a: F.concat(a["query_word"], F.lit("="), a["word"], F.lit(":"), F.round(a["score"] * 1000).cast("int").cast("string"))), " ")
    return hits.select("doc_id", "rank", said.alias("alignments"))
