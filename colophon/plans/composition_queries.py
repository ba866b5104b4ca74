"""How much of a text is in which language, over lines set in several scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition as C
from ..schema import table
from .registry import query

#: Letters of lines of a kind, one for one: katakana, katakana with ideographs for some, Cyrillic. Values of our own.
_FROM = "abcdefghijklmnopqrstuvwxyz"
_KANA = "アブクドエフガハイジカルムノオパクラスタウヴワクヤズ"
_MIXED = "日ブクド本フガハイジカルムノオパクラスタウヴワクヤズ"
_CYRILLIC = "абцдефгхижклмнопкрстувшксз"

_SQL = rf"""
with lines as (select doc_id, lang, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
l as (select doc_id, lang, line_no, case line_no % 4 when 1 then translate(lower(t), '{_FROM}', '{_KANA}') when 2 then translate(lower(t), '{_FROM}', '{_MIXED}') when 3 then translate(lower(t), '{_FROM}', '{_CYRILLIC}') else t end as t from lines),
k as (select doc_id, lang, line_no, t, translate(t, 'ガジドパブヴズ', 'カシトハフウス') as u from l),
r as (select doc_id, lang, line_no, channel, run, length(regexp_replace(t, '[^\p{{Han}}\p{{Hiragana}}]', '', 'g')) as jpn from (
  select doc_id, lang, line_no, t, 'kana' as channel, unnest(regexp_extract_all(u, '[\p{{Katakana}}ー]+')) as run from k
  union all select doc_id, lang, line_no, t, 'latn', unnest(list_transform(regexp_extract_all(t, '\p{{Latin}}+(?:[''’=-]\p{{Latin}}+)*'), lambda x: lower(x))) from k)),
c as (select doc_id, 'jpn' as lang, length(regexp_replace(t, '[^\p{{Han}}\p{{Hiragana}}]', '', 'g')) as chars from l union all select doc_id, 'rus', length(regexp_replace(t, '[^\p{{Cyrillic}}]', '', 'g')) from l),
w as (select distinct channel, run from r),
g as (select channel, run, unnest(list_filter(list_transform(range(1, length(run) + 1), lambda i: substr(' ' || run || ' ', i, 3)), lambda x: length(trim(x)) >= 2)) as gram from w),
p as (select channel, lang, gram, count(*) as cnt from r join g using (channel, run) where doc_id % 2 = 0 group by all),
tot as (select channel, lang, sum(cnt) as total from p group by all),
q as (select x.channel, x.gram, tot.lang, cast(round(log10(coalesce(p.cnt, 0) / tot.total + 1e-6) * 1000000) as bigint) as s from (select distinct channel, gram from p) x join tot using (channel) left join p on p.channel = x.channel and p.gram = x.gram and p.lang = tot.lang),
n as (select channel, run, count(gram) as grams, count(gram) filter (exists (select 1 from p where p.channel = g.channel and p.gram = g.gram)) as informative from w left join g using (channel, run) group by all),
s as (select channel, run, q.lang, sum(q.s) as s from g join q using (channel, gram) group by all),
v as (select channel, run, grams, informative, list({{'s': -s / informative, 'l': lang}} order by -s / informative, lang) as v from n join s using (channel, run) group by all),
lex as (select distinct channel, run from r where lang = 'fr' and doc_id % 2 = 0),
o as (select n.channel, n.run, n.grams, n.informative, case when length(n.run) >= 4 and v[2].s - v[1].s >= 500000 and n.informative >= 0.3 * n.grams and (v[1].l <> 'fr' or exists (select 1 from lex where lex.channel = n.channel and lex.run = n.run)) then v[1].l end as own from n left join v using (channel, run)),
a as (select doc_id, own as lang, sum(length(run)) as chars from r join o using (channel, run) where own is not null group by all),
m as (select doc_id, line_no, channel, sum(length(run)) as chars, max(jpn) as jpn, sum(grams) as grams, sum(informative) as informative from r join o using (channel, run) where own is null group by all),
ms as (select doc_id, line_no, channel, s.lang, sum(s) as s from r join o using (channel, run) join s using (channel, run) where own is null group by all),
mv as (select doc_id, line_no, channel, list({{'s': -s / informative, 'l': lang}} order by -s / informative, lang) as v from m join ms using (doc_id, line_no, channel) where informative > 0 group by all),
b as (select doc_id, case when v[2].s - v[1].s >= 50000 and informative >= 0.3 * grams then v[1].l when channel = 'kana' and jpn >= 2 then 'jpn' else 'und' end as lang, chars from m left join mv using (doc_id, line_no, channel)),
f as (select doc_id, lang, sum(chars)::bigint as chars from (select * from c where chars > 0 union all select * from a union all select * from b) group by all)
select doc_id, lang, chars, round(chars / sum(chars) over (partition by doc_id), 3) as share from f"""


@query(_SQL)
def script_composition(spark, d):
    cut = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    kinds = [F.when(F.col("line_no") % 4 == i, F.translate(F.lower("t"), _FROM, to)) for i, to in ((1, _KANA), (2, _MIXED), (3, _CYRILLIC))]
    lines = cut.select("doc_id", "lang", "line_no", F.coalesce(*kinds, "t").alias("text"))
    attested = lines.where("doc_id % 2 = 0")
    lexicon = C.runs_of_lines(attested.where("lang = 'fr'"), ["lang"]).where("run is not null").select("channel", "lang", "run")
    return C.language_composition(lines.drop("lang"), C.profiles_of(attested), lexicon)
