"""Text archive, search, graph and ledger queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import catalogue as C
from ..operators import graph as G
from ..operators import identity as I
from ..operators import ledger as L
from ..operators import search as S
from ..operators import textstats as X
from ..schema import table
from .registry import query

_TOKEN = r"[\p{L}\p{N}]+(?:[''.][\p{L}\p{N}]+)*"


@query("""
select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text, count(*) as blocks, count(distinct role) as roles from conversations group by 1""")
def page_text_assembly(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("b"), F.count("*").alias("blocks"), F.count_distinct("role").alias("roles"))
    return g.select("conv_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"), "blocks", "roles")


@query("""
select doc_id, cast(strpos(lower(text), 'of the') as int) as position, cast((length(lower(text)) - length(replace(lower(text), 'of the', ''))) / 6 as int) as hits,
       substr(text, greatest(1, strpos(lower(text), 'of the') - 30), 100) as snippet
from documents where contains(lower(text), 'of the')""")
def phrase_search(spark, d):
    hits = S.phrase_hits(table(spark, d, "documents").select("doc_id", "text"), "Of the")
    return hits.select("doc_id", F.col("position").cast("int").alias("position"), "hits", T.snippet(F.col("text"), F.col("position"), 30, 100).alias("snippet"))


@query("""
select source, doc_id from (select source, doc_id, row_number() over (partition by source order by (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 desc, doc_id) as n
from documents where contains(lower(text), 'the')) where n = 1""")
def phrase_best_per_source(spark, d):
    hits = S.phrase_hits(table(spark, d, "documents").select("source", "doc_id", "text"), "the")
    return C.best_of_each(hits, ["source"], [F.desc("hits"), F.col("doc_id")]).select("source", "doc_id")


@query("""select doc_id, regexp_extract(text, 'under the [A-Z][A-Za-z]+|Licensed under CC', 0) as match from documents
where regexp_matches(text, 'under the [A-Z][A-Za-z]+|Licensed under CC')""")
def regex_search(spark, d):
    return S.pattern_hits(table(spark, d, "documents").select("doc_id", "text"), "under the [A-Z][A-Za-z]+|Licensed under CC").select("doc_id", "match")


@query(rf"""
select token, count(*) as cnt, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as token from documents)
where length(token) >= 4 group by 1 having count(*) >= 50""")
def token_counts(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.lower("text"))).alias("token")).where(F.length("token") >= 4)
    return words.groupBy("token").agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("docs")).where("cnt >= 50")


@query(r"""
with w as (select lang, ' ' || word || ' ' as p, count(*) as n from (select lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) as word from documents) group by 1, 2),
g as (select lang, substr(p, i::int, 3) as gram, sum(n)::bigint as cnt from (select *, unnest(range(1, length(p) - 1)) as i from w) group by 1, 2)
select lang, gram, cnt from (select *, row_number() over (partition by lang order by cnt desc, gram) as r from g) where r <= 5000""")
def trigram_profile(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))).alias("gram"))
    sums = grams.groupBy("lang", "gram").agg(F.sum("n").alias("cnt"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "gram"))).where("r <= 5000").drop("r")


@query(rf"""
with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as token from documents),
q as (select unnest(['theaer', 'thand']) as word),
m as (select token, word, 1 - damerau_levenshtein(token, word) * 1.0 / greatest(length(token), length(word)) as score from (select distinct token from t), q
      where abs(length(token) - length(word)) <= 1 and damerau_levenshtein(token, word) <= 1)
select doc_id, round(1 - avg(score), 6) as rank from (select doc_id, word, max(score) as score from t join m using (token) group by all) group by 1 having count(*) = 2""")
def soft_search(spark, d):
    return S.fuzzy_hits(table(spark, d, "documents"), "theaer thand")


@query(rf"""
with t as (select doc_id, regexp_extract_all(lower(text), '{_TOKEN}') as w from documents),
g as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - least(3, len(w)) + 1, 1) + 1), lambda i: array_to_string(w[i : i + least(3, len(w)) - 1], ' '))) as grams from t where len(w) > 0),
r as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
s as (select q.doc_id as query_id, q.n as qn, r.doc_id as id, r.n as n, count(*) as shared from r q join r on q.gram = r.gram and q.doc_id <> r.doc_id where q.doc_id % 100 = 0 group by all),
j as (select query_id, id, round(shared * 1.0 / (n + qn - shared), 6) as score from s)
select query_id, id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from j) where rank <= 30""")
def similar_pages(spark, d):
    return S.similar_texts(table(spark, d, "documents"), F.col("doc_id") % 100 == 0)


@query("""
with s as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
  from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
select query_id, id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 60""")
def semantic_topk(spark, d):
    return S.nearest_vectors(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


@query(rf"""
with t as (select doc_id, regexp_extract_all(lower(text), '{_TOKEN}') as w from documents),
c as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'licensed')) as a, len(list_filter(w, lambda x: x = 'idiot')) as b from t),
z as (select count(*) as docs, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c)
select doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score
from c, z where a + b > 0 order by score desc, doc_id limit 20""")
def bm25_topk(spark, d):
    return S.bm25(table(spark, d, "documents"), ["licensed", "idiot"])


#: Passages ranked by likeness of their words, beside the documents that hold them whole.
RETRIEVAL_SQL = rf"""
with rows as (select -1 - item_id as doc_id, text from benchmark union all select doc_id, text from documents),
t as (select doc_id, regexp_extract_all(lower(text), '{_TOKEN}') as w from rows),
g as (select doc_id, list_distinct(w) as grams from t where len(w) > 0),
r as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
s as (select q.doc_id as query_id, q.n as qn, r.doc_id as id, r.n as n, count(*) as shared from r q join r on q.gram = r.gram and q.doc_id <> r.doc_id where q.doc_id < 0 group by all),
ranked as (select query_id, id, row_number() over (partition by query_id order by round(shared * 1.0 / (n + qn - shared), 6) desc, id) as rank from s),
items as (select -1 - item_id as query_id, text, case when item_id % 2 = 0 then 'even' else 'odd' end as kind from benchmark),
expected as (select query_id, kind, doc_id as id from items i left join documents d on contains(lower(d.text), lower(i.text))),
best as (select query_id, kind, min(rank) filter (rank <= 10) as rank from expected left join ranked using (query_id, id) group by all)
select BY count(*) as queries, round(avg(case when rank is not null then 1.0 else 0.0 end), 4) as recall, round(avg(coalesce(1.0 / rank, 0)), 4) as mrr from best GROUP"""


def retrieved(spark, d):
    """(ranked, expected) of the benchmark's passages, whose ids are below 0."""
    items = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), "text", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    ranked = S.similar_texts(items.select(F.col("query_id").alias("doc_id"), "text").unionByName(docs), F.col("doc_id") < 0, width=1)
    hits = S.passage_hits(docs.withColumnRenamed("doc_id", "id"), items)
    return ranked, items.select("query_id", "kind").join(hits, "query_id", "left")


@query(RETRIEVAL_SQL.replace("BY count", "count").replace("GROUP", ""))
def retrieval_metrics(spark, d):
    return S.retrieval_metrics(*retrieved(spark, d))


@query("""
select lang, count(*) as docs, round(median(lines), 3) as median_lines, round(avg(chars), 3) as mean_chars, count(*) filter (longest < 5) as suspect
from (select lang, length(text) as chars, len(string_split(text, chr(10))) as lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) as longest from documents) group by 1""")
def text_quality(spark, d):
    lines = F.split("text", "\n")
    rows = table(spark, d, "documents").select("lang", F.length("text").alias("chars"), F.size(lines).alias("lines"), F.array_max(F.transform(lines, lambda x: F.length(x))).alias("longest"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.median("lines"), 3).alias("median_lines"), F.round(F.avg("chars"), 3).alias("mean_chars"), F.count(F.when(F.col("longest") < 5, 1)).alias("suspect"))


@query("""
with e as (select distinct l_suppkey as src, l_partkey as dst from lineitem), n as (select src as node from e union select dst from e)
select node, (select count(*) from e where src = node) as out_degree, (select count(*) from e where dst = node) as in_degree from n""")
def graph_degrees(spark, d):
    return G.degrees(_edges(spark, d))


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f""", r{i} as materialized (select n.node, 0.15 / z.c + 0.85 * (coalesce(g.given, 0) + w.loose / z.c) as rank
        from n left join (select e.dst, sum(r.rank / o.k) as given from e join r{i - 1} r on r.node = e.src join o on o.src = e.src group by 1) g on g.dst = n.node,
        z, (select coalesce(sum(rank), 0) as loose from r{i - 1} where node not in (select src from o)) w)"""
        for i in range(1, rounds + 1)
    )
    return f"""with e as materialized (select distinct l_suppkey as src, l_partkey as dst from lineitem),
    n as materialized (select src as node from e union select dst from e), z as (select count(*) as c from n), o as (select src, count(*) as k from e group by 1),
    r0 as materialized (select node, 1.0 / c as rank from n, z){steps}
    select node, round(rank / (select max(rank) from r{rounds}), 6) as significance from r{rounds}"""


@query(_pagerank_sql(60))
def pagerank(spark, d):
    edges = _edges(spark, d)
    return G.significance(G.pagerank(edges.select(F.explode(F.array("src", "dst")).alias("node")), edges))


@query("""
with k as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '/' || p_size as dup_key from part),
g as (select dup_key from k where length(dup_key) >= 5 group by 1 having count(*) between 2 and 30)
select a.p_partkey as id_a, b.p_partkey as id_b, dup_key from g join k a using (dup_key) join k b using (dup_key) where a.p_partkey < b.p_partkey""")
def same_work_pairs(spark, d):
    key = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", ""), F.lit("/"), F.col("p_size").cast("string"))
    return G.same_key_pairs(table(spark, d, "part"), key, "p_partkey")


@query("""
with a as (select distinct user_id, event_type from events where ts >= '2024-01-10'), b as (select distinct user_id, event_type from events where ts < '2024-01-24')
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, case when b.user_id is null then 'add' when a.user_id is null then 'withdraw' else 'keep' end as action
from a full join b on a.user_id = b.user_id and a.event_type = b.event_type""")
def edge_reconcile(spark, d):
    e = table(spark, d, "events")
    return G.reconcile(e.where("ts >= timestamp_ntz'2024-01-10'"), e.where("ts < timestamp_ntz'2024-01-24'"), ["user_id", "event_type"])


@query("select distinct user_id from events where ts < '2024-01-10' and user_id not in (select user_id from events where ts >= '2024-01-28')")
def drift_missing(spark, d):
    e = table(spark, d, "events")
    return e.where("ts < timestamp_ntz'2024-01-10'").select("user_id").distinct().join(e.where("ts >= timestamp_ntz'2024-01-28'"), "user_id", "left_anti")


@query("""
with recursive p as (select o_orderkey as id, o_orderkey - 7 as into_ from orders where o_orderkey % 70 > 6 and o_orderkey % 3 > 0),
c as (select id, into_ from p union all select c.id, p.into_ from c join p on c.into_ = p.id)
select id, min(into_) as target from c group by 1""")
def merge_chain_winner(spark, d):
    pointers = table(spark, d, "orders").where("o_orderkey % 70 > 6 and o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - 7).alias("into"))
    return G.final_targets(pointers)


_CLAIMS = """claims as (select user_id, event_type, event_id, ts, props as v,
  case event_type when 'purchase' then 800 when 'signup' then 700 else 600 end as b,
  cast(100 + floor(least(value, 100.0) / 100 * 100 + 0.5) + least(25, 5 * (event_id % 7)) as int) as s from events)"""


def _claims(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "curated_assertion").when(F.col("event_type") == "signup", "observed").otherwise("extracted")
    score = L.rank_score(F.lit(1), F.least(F.col("value"), F.lit(100.0)) / 100, F.col("event_id") % 7)
    return e.select("user_id", "event_type", "event_id", "ts", F.col("props").alias("value"), L.band(kind).alias("band"), score.alias("score"))


@query(f"""
with recursive {_CLAIMS},
n as (select *, row_number() over (partition by user_id order by ts, event_id) as i from claims),
f as (select user_id, i, v, b, s, 0 as conflicts from n where i = 1
  union all select n.user_id, n.i,
    case when n.v is distinct from f.v and (n.b > f.b or (n.b = f.b and n.s - f.s > 10)) then n.v else f.v end,
    case when n.v is distinct from f.v and (n.b > f.b or (n.b = f.b and n.s - f.s > 10)) then n.b else f.b end,
    case when n.v is distinct from f.v and (n.b > f.b or (n.b = f.b and n.s - f.s > 10)) then n.s else f.s end,
    f.conflicts + case when n.v is distinct from f.v and n.b = f.b and abs(n.s - f.s) <= 10 then 1 else 0 end
  from f join n on f.user_id = n.user_id and n.i = f.i + 1)
select user_id, v as winner, b as band, s as score, cast(i as int) as claims, conflicts from (select *, max(i) over (partition by user_id) as last from f) where i = last""")
def field_winner(spark, d):
    return L.field_winners(_claims(spark, d), ["user_id"])


@query("select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as kinds, count(distinct props) as props from events group by 1")
def set_union_fold(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"), F.count_distinct("props").alias("props"))
    return g.select("user_id", F.array_join("k", ",").alias("kinds"), "props")


@query("""
with o as (select user_id, props, ts, event_id, lag(props) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, arg_max(props, n) as last_value, count(*) as observations, count(*) filter (n > 1 and before is distinct from props) as changes from o group by 1""")
def record_first_last_changed(spark, d):
    return L.record_changes(table(spark, d, "events"), "user_id", "props", ["ts", "event_id"])


@query("select user_id, event_type, props, min(event_id) as event_id, count(*) as seen from events group by 1, 2, 3")
def idempotent_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "props", "event_id")
    return L.first_seen(e, ["user_id", "event_type", "props"], ["event_id"])


@query("""
with e as (select *, value / 100 as conf, case event_type when 'purchase' then 'editorial_decision' when 'view' then 'inferred' when 'click' then 'extracted' when 'signup' then 'curated_assertion' else 'heuristic' end as derivation,
  case when event_id % 4 = 0 then 'website' else 'feed' end as origin, case when user_id % 3 > 0 then 'attach' when user_id % 2 = 0 then 'create' else 'conflict' end as action,
  case when user_id % 3 = 0 then 'strong_multi' when user_id % 5 = 0 then 'medium_corroborated' else 'strong_single' end as match, event_id % 6 as evidence from events),
g as (select event_id, case
  when conf > 1 or conf < 0 or conf is null or event_id % 97 = 0 or (derivation in ('inferred', 'heuristic') and evidence <= 0) or (derivation = 'editorial_decision' and origin <> 'website') then
    ['reject', concat_ws(';', case when conf is null or conf < 0 or conf > 1 then 'confidence_out_of_range' end, case when event_id % 97 = 0 then 'malformed_identifier' end,
      case when derivation in ('inferred', 'heuristic') and evidence <= 0 then 'evidence_required_for_derivation:' || derivation end, case when derivation = 'editorial_decision' and origin <> 'website' then 'editorial_decision_forbidden_for_origin:' || origin end), 'field_update']
  when event_id % 41 = 0 and action = 'attach' then ['auto_apply', 'drift', 'drift'] when event_id % 41 = 0 then ['reject', 'missing_unknown', 'drift']
  when event_id % 50 = 0 and action = 'attach' and derivation = 'editorial_decision' and origin = 'website' then ['auto_apply', 'editorial_lifecycle', 'lifecycle'] when event_id % 50 = 0 then ['propose', 'lifecycle_review', 'lifecycle']
  when action <> 'attach' then ['propose', 'new_or_unresolved:' || match, case when action = 'conflict' then 'identity_conflict' else 'new_source' end]
  when event_id % 11 = 0 then ['propose', 'conflict', 'identity_conflict'] when derivation in ('inferred', 'heuristic') then ['propose', 'low_trust:' || derivation, 'enrichment']
  when derivation = 'editorial_decision' and origin = 'website' and match = 'strong_single' and conf >= 0.99 then ['auto_apply', 'editorial_edit', 'field_update']
  when match = 'strong_single' and conf >= 0.7 then ['auto_apply', 'strong_match_harvest', 'field_update'] else ['propose', 'review:' || derivation || ':' || match, 'enrichment'] end as g from e)
select event_id, g[1] as mode, g[2] as reason, g[3] as kind from g""")
def claim_gate_decision(spark, d):
    e, kind, user = table(spark, d, "events"), F.col("event_type"), F.col("user_id")
    derivation = F.when(kind == "purchase", "editorial_decision").when(kind == "view", "inferred").when(kind == "click", "extracted").when(kind == "signup", "curated_assertion").otherwise("heuristic")
    origin = F.when(F.col("event_id") % 4 == 0, "website").otherwise("feed")
    action = F.when(user % 3 > 0, "attach").when(user % 2 == 0, "create").otherwise("conflict")
    match = F.when(user % 3 == 0, "strong_multi").when(user % 5 == 0, "medium_corroborated").otherwise("strong_single")
    confidence = F.col("value") / 100
    findings = L.audit_findings(origin, derivation, confidence, F.col("event_id") % 6, F.col("event_id") % 97 != 0)
    gate = L.change_gate(findings, F.when(F.col("event_id") % 41 == 0, "missing").otherwise("seen"), F.col("event_id") % 50 == 0, action, match, F.col("event_id") % 11 == 0, derivation, origin, confidence)
    return e.select("event_id", gate.alias("g")).select("event_id", "g.mode", "g.reason", "g.kind")


@query("select user_id, cast(ts as date) as day, sum(case event_type when 'purchase' then 50 else 1 end)::bigint as used, sum(case event_type when 'purchase' then 50 else 1 end) > 60 as over from events group by 1, 2")
def quota_usage(spark, d):
    return L.daily_quota(table(spark, d, "events"), "user_id", "ts", F.when(F.col("event_type") == "purchase", 50).otherwise(1), 60)


@query("select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase from events group by 1")
def usage_pivot(spark, d):
    kinds = ["click", "view", "purchase"]
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return p.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query("""
with recursive e as (select user_id, event_id as id, cast(epoch_us(ts) // 1000 as bigint) as t, event_type from events),
l as (select *, row_number() over (partition by user_id order by t desc, id) as n from e where event_type = 'click'), r as (select * from e where event_type = 'view'),
f as (select user_id, 0 as n, []::bigint[] as used, null::bigint as left_id, null::bigint as right_id, null::bigint as gap from l group by 1
  union all select user_id, n, case when right_id is null then used else list_append(used, right_id) end, left_id, right_id, gap from (
    select f.user_id, l.n, any_value(f.used) as used, l.id as left_id, arg_min(r.id, struct_pack(g := abs(r.t - l.t), t := -r.t, id := r.id)) as right_id, min(abs(r.t - l.t)) as gap
    from f join l on l.user_id = f.user_id and l.n = f.n + 1 left join r on r.user_id = l.user_id and abs(r.t - l.t) <= 14400000 and not list_contains(f.used, r.id) group by f.user_id, l.n, l.id))
select user_id, left_id, right_id, gap from f where n > 0 union all select user_id, null, id, null from r where not exists (select 1 from f where f.user_id = r.user_id and f.right_id = r.id)""")
def nearest_event_pairing(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    return L.nearest_pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", 4 * 3600 * 1000)


@query("""
select bucket, count(*) as cnt from (select case when value is null then 'none' when value < 50 then '<0.5' when value < 75 then '0.5-0.75' when value < 90 then '0.75-0.9' else '>=0.9' end as bucket
from (select user_id, arg_max(value, struct_pack(t := ts, id := event_id)) as value from events group by user_id, event_type)) group by 1""")
def confidence_buckets(spark, d):
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    label = F.coalesce(P.bucket_label(F.col("value"), [(50, "<0.5"), (75, "0.5-0.75"), (90, "0.75-0.9")], ">=0.9"), F.lit("none"))
    return C.counted(latest.select(label.alias("bucket")), "bucket")


@query(r"select page_id, regexp_matches(lower(url), '^\s*https?://[^/\s]') as safe, regexp_extract(url, '^(\w+)://', 1) as scheme from pages")
def url_allowlist(spark, d):
    return table(spark, d, "pages").select("page_id", P.safe_url(F.col("url")).alias("safe"), F.regexp_extract("url", r"^(\w+)://", 1).alias("scheme"))


@query("""
select p_partkey, isbn, list_sum(list_transform(range(1, 14), lambda i: cast(isbn[i] as int) * case when i % 2 = 1 then 1 else 3 end)) % 10 = 0 as valid
from (select p_partkey, '978' || lpad(cast(p_partkey * 7919 % 10000000000 as varchar), 10, '0') as isbn from part)""")
def identifier_checksum(spark, d):
    isbn = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 10000000000).cast("string"), 10, "0"))
    return table(spark, d, "part").select("p_partkey", isbn.alias("isbn")).withColumn("valid", P.isbn13_valid(F.col("isbn")))


@query("""select page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) as decoded_md5 from pages""")
def entity_decode(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(P.decoded_entities(F.col("html"))).alias("decoded_md5"))


@query("""
select o_orderkey, cast(year(o_orderdate) as int) as "start", case when o_orderkey % 3 > 0 then cast(year(o_orderdate) + o_orderkey % 3 as int) end as "end", case when o_orderkey % 2 = 0 then 'estimated' when o_orderkey % 3 > 0 then 'range' else 'exact' end as certainty from orders""")
def year_parse(spark, d):
    y = F.year("o_orderdate")
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "c. ").otherwise(""), y.cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("-"), (y + F.col("o_orderkey") % 3).cast("string"))).otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", P.year_span(text).alias("s")).select("o_orderkey", "s.start", "s.end", "s.certainty")


@query("""
with r as (select * from (values ('i', 1), ('iv', 4), ('ix', 9), ('xiv', 14), ('xl', 40), ('xcix', 99), ('ccclxxxviii', 388)) t(numeral, value))
select p_partkey, numeral, value from part join (select *, row_number() over (order by value) - 1 as k from r) on p_partkey % 8 = k""")
def roman_values(spark, d):
    names = F.array(*map(F.lit, ["i", "iv", "ix", "xiv", "xl", "xcix", "ccclxxxviii"]))
    rows = table(spark, d, "part").where("p_partkey % 8 < 7").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("numeral"))
    return rows.withColumn("value", P.roman_value(F.col("numeral")))


@query("select md5(text) as dup_key, count(*) as cnt, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) > 1")
def exact_dup_groups(spark, d):
    return C.same_key_groups(table(spark, d, "documents"), F.md5("text"), "doc_id")


@query("""
select doc_id, lang, md5(strip_accents(lower(replace(translate(text, '`´ʹʼ՚‘’‛＇', repeat(chr(39), 9)), 'ß', 'ss')))) as folded_md5 from documents""")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.md5(T.fold("text")).alias("folded_md5"))


@query("""
with p as (select doc_id // 40 as book, doc_id % 40 as page, case when doc_id % 40 between 5 and 30 and (doc_id // 40) % 3 > 0 then doc_id % 40 + 7 when doc_id % 40 > 34 then doc_id % 40 + 100 end as value from documents),
i as (select *, value - page as shift, page - row_number() over (partition by book, value - page order by page) as island from p where value is not null)
select book, page, value from (select *, count(*) over (partition by book, shift, island) as n from i) where n >= 8""")
def folio_offsets(spark, d):
    book, page = F.floor(F.col("doc_id") / 40), F.col("doc_id") % 40
    number = F.when(page.between(5, 30) & (book % 3 > 0), page + 7).when(page > 34, page + 100)
    text = F.concat_ws("\n", F.lit("A heading"), F.concat(F.lit("- "), number.cast("string"), F.lit(" -")), F.lit("some words that follow"))
    return X.page_numbers(table(spark, d, "documents").select(book.alias("book"), page.alias("page"), text.alias("text"))).select("book", "page", "value")


@query(r"""
with b as (select item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as wanted from benchmark),
t as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' as key from documents)
select doc_id, item_id as work_id from t join b on contains(key, ' ' || wanted || ' ')""")
def reference_match(spark, d):
    works = table(spark, d, "benchmark").select(F.col("item_id").alias("work_id"), F.col("text").alias("title"), F.lit(1900).alias("year"))
    return X.citation_matches(table(spark, d, "documents").select("doc_id", "text"), works).select("doc_id", "work_id")


@query(r"""
with o as (select p_partkey as obs_id, case when p_partkey % 17 = 0 then p_partkey end as target_id, p_name as title, p_brand as author, cast(p_size as int) as year, p_partkey % 7 as k from part where p_partkey % 2 = 0),
i as (select case when k < 3 then 'isbn:' || (obs_id % 300) end as a, case when k = 1 then 'doi:' || (obs_id % 200) end as b, obs_id from o), x as (select obs_id, unnest([a, b]) as ident from i),
w as (select coalesce(r.to_ident, x.ident) as ident, x.obs_id from x left join (select 'isbn:' || (p_partkey % 300) as from_ident, 'isbn:' || (p_partkey % 300 + 1) as to_ident from part where p_partkey % 300 % 10 = 4 group by all) r on r.from_ident = x.ident where x.ident is not null),
d as (select 'isbn:' || (p_partkey % 300) as ident, min(p_partkey) as low, max(p_partkey) as high from part where p_partkey % 2 = 1 and p_partkey % 300 % 3 = 0 group by 1 union all select 'doi:' || (p_partkey % 200), min(p_partkey), min(p_partkey) from part where p_partkey % 2 = 1 group by 1),
h as (select obs_id, min(low) as id_low, max(high) as id_high, count(w.ident) as n_ids from w left join d using (ident) group by 1),
k as (select trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) as t, trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}]+', ' ', 'g')) as a, cast(p_size as int) as year, p_partkey from part where p_partkey % 2 = 1),
bt as (select t, min(p_partkey) as first from k group by 1), ba as (select t, a, year, min(p_partkey) as first, count(*) as n from k group by 1, 2, 3),
j as (select o.*, h.*exclude (obs_id), bt.first as tf, ba.first as af, ba.n from o left join h using (obs_id) left join bt on bt.t = trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))
  left join ba on ba.t = trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) and ba.a = trim(regexp_replace(lower(author), '[^\p{L}\p{N}]+', ' ', 'g')) and ba.year = o.year),
r as (select *, case when target_id is not null then 'explicit_target' when id_low = id_high then 'strong_single' when id_low is not null then 'strong_multi' when n_ids > 0 then 'strong_new' when n = 1 then 'medium_corroborated' when tf is not null then 'medium_uncorroborated' else 'new' end as decision from j)
select obs_id, case when decision in ('explicit_target', 'strong_single', 'medium_corroborated') then 'attach' when decision = 'strong_multi' then 'conflict' when decision = 'medium_uncorroborated' then 'candidate' else 'create' end as action,
  case decision when 'explicit_target' then target_id when 'strong_single' then id_low when 'medium_corroborated' then af when 'medium_uncorroborated' then tf end as source_id, decision from r""")
def identity_ladder(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    ident = lambda kind, n: F.concat(F.lit(f"{kind}:"), n.cast("string"))
    ids = F.array_compact(F.array(F.when(k % 7 < 3, ident("isbn", k % 300)), F.when(k % 7 == 1, ident("doi", k % 200))))
    observed = part.where("p_partkey % 2 = 0").select(k.alias("obs_id"), F.when(k % 17 == 0, k).alias("target_id"), ids.alias("ids"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("year"))
    odd = part.where("p_partkey % 2 = 1")
    known = odd.where("p_partkey % 300 % 3 = 0").select(ident("isbn", k % 300).alias("ident"), k.alias("source_id")).union(odd.groupBy(ident("doi", k % 200)).agg(F.min(k)))
    redirects = part.where("p_partkey % 300 % 10 = 4").select(ident("isbn", k % 300).alias("from_ident"), ident("isbn", k % 300 + 1).alias("to_ident")).distinct()
    sources = odd.select(k.alias("source_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("year"), F.lit("active").alias("status"))
    return I.resolve(observed, known, sources, redirects)
