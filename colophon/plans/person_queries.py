"""Persons behind the spellings of names that begin the lines of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import persons as P
from ..schema import table
from .registry import query

_FROM, _KANA = "abcdefghijklmnopqrstuvwxyz", "アブクドエフガハイジカルムノオパクラスタウヴワクヤズ"

#: Words that name a role, so no person. Fixed values.
_ROLES = ("rec", "ed", "comp", "trans", "tr", "eds")

#: The first words of a line are a name, in a way that the line's number and its document tell.
_SQL = rf"""
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
w as (select (doc_id + line_no) % 7 as kind, doc_id, line_no, regexp_extract(t, '^(\p{{L}}+) (\p{{L}}+)', 1) as g, regexp_extract(t, '^(\p{{L}}+) (\p{{L}}+)', 2) as f from l where regexp_matches(t, '^\p{{L}}+ \p{{L}}+') and not regexp_matches(t, '^(?i:(rec|ed|comp|trans|tr|eds) |\p{{L}}+ (rec|ed|comp|trans|tr|eds)([^\p{{L}}]|$))')),
k as (select *, translate(lower(strip_accents(f || g)), '{_FROM}', '{_KANA}') as kana from w),
m as (select distinct kind, g, f, kana, case kind when 0 then g || ' ' || f when 1 then f || ', ' || g when 2 then g || '  ' || f || ' (ed.)' when 3 then lower(strip_accents(f)) || ' ' || g when 4 then g || ' ' || f || ' (' || kana || ')' when 5 then kana || '編' else kana || ' (' || g || ' ' || f || ')' end as raw from k),
n as (select raw, any_value(kind) as kind, any_value(case kind when 3 then lower(strip_accents(f)) || ' ' || g when 0 then g || ' ' || f when 1 then g || ' ' || f when 2 then g || ' ' || f else kana end) as name,
  any_value(case kind when 0 then g || ' ' || f when 1 then g || ' ' || f when 2 then g || ' ' || f when 3 then lower(strip_accents(f)) || ' ' || g when 4 then case when regexp_full_match(g || f, '[A-Za-zÀ-ÿ]+') then f || ' ' || g else g || ' ' || f end when 6 then case when regexp_full_match(g || f, '[A-Za-zÀ-ÿ]+') then f || ' ' || g else g || ' ' || f end end) as reading from m group by raw),
al as (select case when doc_id % 2 = 0 then f || ' ' || g else f || g end as form, 'person-' || doc_id as person from w where line_no = 0 and doc_id % 9 = 0),
cf as (select raw, 0 as rank, 0 as i, raw as form from n
  union all select raw, 0, 1, trim(regexp_replace(raw, '\s*[(][^)]*[)]', '', 'g')) from n
  union all select raw, 0, 2, split_part(raw, ', ', 1) from n where kind = 1 union all select raw, 0, 3, name from n where kind = 1
  union all select raw, 0, 4, regexp_replace(b, '^(\S+) (\S+)$', '\2 \1') from (select raw, trim(regexp_replace(raw, '\s*[(][^)]*[)]', '', 'g')) as b from n where kind in (0, 1, 3, 4)) where true
  union all select raw, 1, 0, name from n union all select raw, 1, 1, regexp_replace(name, '^(\S+) (\S+)$', '\2 \1') from n where kind in (0, 1, 2, 3)),
kn as (select folded, key, min(person) as person from (select 0 as folded, form as key, person from al union all select 1, lower(strip_accents(regexp_replace(form, '\s+', '', 'g'))), person from al) group by all),
fd as (select raw, arg_min(person, (rank, folded, i)) as canon from (select raw, rank, i, 0 as folded, form as key from cf union all select raw, rank, i, 1, lower(strip_accents(regexp_replace(form, '\s+', '', 'g'))) from cf) join kn using (folded, key) group by raw),
nk as (select n.raw, name, reading, canon from n left join fd using (raw)),
ks as (select raw, canon, 'x:' || case when regexp_matches(name, '[぀-ヿ]') then name when regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> '' then regexp_replace(lower(name), '[^a-z0-9]', '', 'g') else replace(lower(name), ' ', '') end as key from nk
  union select raw, canon, 'r:' || array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(strip_accents(reading)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')), ' ') from nk where reading is not null and regexp_matches(lower(strip_accents(reading)), '[a-z0-9]')),
lk as (select raw, key from ks where canon is null),
hop as (select distinct a.key as a, b.key as b from lk a join lk b using (raw)),
reach(a, b) as (select a, b from hop union select r.a, h.b from reach r join hop h on h.a = r.b),
comp as (select a as key, min(b) as component from reach group by 1),
own as (select component, min(ks.canon) as least, max(ks.canon) as most from comp join ks using (key) where ks.canon is not null group by 1),
nc as (select distinct raw, component from lk join comp using (key))
select raw, name, reading, coalesce(canon, case when least = most then least end, component) as person,
  case when canon is not null then 'alias' when least = most then 'alias keys' when least is not null then 'ambiguous' else 'keys' end as via
from nk left join nc using (raw) left join own using (component)"""


@query(_SQL)
def persons_of_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    pattern = r"^(\p{L}+) (\p{L}+)"
    g, f = F.regexp_extract("t", pattern, 1), F.regexp_extract("t", pattern, 2)
    roles = F.lower(g).isin(*_ROLES) | F.lower(f).isin(*_ROLES)
    w = lines.where(F.col("t").rlike(pattern) & ~roles).select("doc_id", "line_no", g.alias("g"), f.alias("f"))
    kana = F.translate(F.regexp_replace(P.unmarked(F.concat("f", "g")), r"\s", ""), _FROM, _KANA)
    w = w.withColumn("kana", kana).withColumn("plain", P.unmarked("f"))
    kind = (F.col("doc_id") + F.col("line_no")) % 7
    said = [("g", " ", "f"), ("f", ", ", "g"), ("g", "  ", "f", " (ed.)"), (F.col("plain"), " ", "g"), ("g", " ", "f", " (", "kana", ")"), ("kana", "編")]
    of = lambda parts: F.concat(*[p if not isinstance(p, str) else F.col(p) if p in ("g", "f", "kana") else F.lit(p) for p in parts])
    raw = F.coalesce(*[F.when(kind == i, of(parts)) for i, parts in enumerate(said)], of(("kana", " (", "g", " ", "f", ")")))
    form = F.when(F.col("doc_id") % 2 == 0, F.concat("f", F.lit(" "), "g")).otherwise(F.concat("f", "g"))
    aliases = w.where("line_no = 0 and doc_id % 9 = 0").select(form.alias("form"), F.concat(F.lit("person-"), F.col("doc_id").cast("string")).alias("person"))
    return P.persons(w.select(raw.alias("raw")), aliases)
