"""More of the archive's bookkeeping: variants, generations, frontiers, claims and renames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import graph as G
from ..operators import ledger as L
from ..schema import table
from .registry import query


@query("""
with s as (select l_orderkey, l_returnflag as lang, count(*) as n, sum(count(*)) over (partition by l_orderkey) as total from lineitem group by 1, 2)
select l_orderkey, total::bigint as total from s where total >= 4 group by all having bool_or(lang = 'R' and n * 1.0 / total >= 0.5)""")
def composition_filter(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("lang")).agg(F.count("*").alias("n"))
    rows = by.groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("shares"))
    return rows.where((F.col("total") >= 4) & F.exists("shares", lambda s: (s["lang"] == "R") & (s["n"] / F.col("total") >= 0.5))).select("l_orderkey", "total")


@query("""
with e as (select distinct l_suppkey as a, l_partkey as b from lineitem where l_linenumber = 2), k as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_linenumber = 1)
select a, b from e where not exists (select 1 from k where k.a = least(e.a, e.b) and k.b = greatest(e.a, e.b))""")
def symmetric_edges_missing(spark, d):
    ends = lambda df: df.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    lines = table(spark, d, "lineitem")
    new = ends(lines.where("l_linenumber = 2")).distinct().withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    known = ends(lines.where("l_linenumber = 1")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return new.join(known, ["x", "y"], "left_anti").select("a", "b")


@query("""
select source, array_to_string(list_sort(list(distinct lang)), ',') as langs, array_to_string(list_sort(list(doc_id))[1:5], ',') as first_ids, count(*) as docs, sum(n_chars)::bigint as chars from documents group by 1""")
def feed_accumulation(spark, d):
    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    # Five of each source are kept before any list is built.
    firsts = docs.select("source", "doc_id").withColumn("r", rank).where("r <= 5").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("f"))
    sums = docs.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("l"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return sums.join(firsts, "source").select("source", F.array_join("l", ",").alias("langs"), F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("first_ids"), "docs", "chars")


@query("""
select count(*) filter (event_type = 'purchase') as applied, count(*) filter (event_type = 'view') as noop, count(*) filter (event_type = 'signup') as candidate,
       count(*) filter (event_type = 'error') as conflict, count(*) filter (event_type not in ('purchase', 'view', 'signup', 'error')) as other from events""")
def status_tally(spark, d):
    kinds = {"applied": "purchase", "noop": "view", "candidate": "signup", "conflict": "error"}
    sums = [F.count(F.when(F.col("event_type") == v, 1)).alias(k) for k, v in kinds.items()]
    return table(spark, d, "events").agg(*sums, F.count(F.when(~F.col("event_type").isin(*kinds.values()), 1)).alias("other"))


@query("""
with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as author from part), g as (select author from w where length(author) > 2 group by 1 having count(*) >= 2)
select author, count(distinct p_partkey) as works from w where author in (select author from g) group by 1""")
def prominence_gate(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("author"))
    often = w.where(F.length("author") > 2).groupBy("author").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("works")).where("n >= 2")
    return often.select("author", "works")


@query("""
select user_id, event_type as variant from (select *, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, event_type, event_id) as n from events) where n = 1""")
def variant_choice(spark, d):
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return C.best_of_each(table(spark, d, "events"), ["user_id"], [tier, F.col("event_type"), F.col("event_id")]).select("user_id", F.col("event_type").alias("variant"))


@query("""
with recursive e as (select distinct l_suppkey as a, l_partkey as b from lineitem where l_linenumber = 1),
f as (select 7 as node, 0 as hops union select e.b, f.hops + 1 from f join e on f.node = e.a where f.hops < 4)
select cast(node as bigint) as node, cast(min(hops) as int) as hops from f group by node""")
def frontier(spark, d):
    edges = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return G.within_hops(spark.createDataFrame([(7,)], "node long"), edges, 4)


@query("""
select p_partkey, field, value from (select p_partkey, 'brand' as field, p_brand as value from part union all select p_partkey, 'type', p_type from part union all select p_partkey, 'size', cast(nullif(p_size, 1) as varchar) from part) where value is not null""")
def bootstrap_claims(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.nullif("p_size", F.lit(1)).cast("string").alias("size"))
    return p.unpivot("p_partkey", ["brand", "type", "size"], "field", "value").where("value is not null")


@query("""
with p as (select s_suppkey, lower(replace(s_name, '#', '-')) as old_slug, 'sup-' || (s_suppkey % 90) as new_slug from supplier), n as (select new_slug, count(*) as n from p group by 1)
select s_suppkey, case when n > 1 then 'refuse' when new_slug = old_slug then 'skip' when exists (select 1 from nation where 'sup-' || n_nationkey = new_slug) then 'refuse' else 'rename' end as plan from p join n using (new_slug)""")
def reslug_plan(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("old_slug"), F.concat(F.lit("sup-"), (F.col("s_suppkey") % 90).cast("string")).alias("new_slug"))
    counts = p.groupBy("new_slug").agg(F.count("*").alias("n"))
    retired = table(spark, d, "nation").select(F.concat(F.lit("sup-"), F.col("n_nationkey").cast("string")).alias("new_slug"), F.lit(True).alias("retired"))
    plan = F.when(F.col("n") > 1, "refuse").when(F.col("new_slug") == F.col("old_slug"), "skip").when(F.col("retired"), "refuse").otherwise("rename")
    return p.join(counts, "new_slug").join(retired, "new_slug", "left").select("s_suppkey", plan.alias("plan"))


@query("""
with k as (select c_custkey, lower(c_name) as key from customer union all select c_custkey, c_mktsegment || c_nationkey from customer), f as (select key, min(c_custkey) as first from k group by 1)
select c_custkey, min(first) as resolved from k join f using (key) group by 1""")
def person_resolver(spark, d):
    c = table(spark, d, "customer")
    keys = c.select("c_custkey", F.explode(F.array(F.lower("c_name"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))).alias("key"))
    return keys.join(keys.groupBy("key").agg(F.min("c_custkey").alias("first")), "key").groupBy("c_custkey").agg(F.min("first").alias("resolved"))


@query("""
select o_orderkey, coalesce(max(l_linenumber), 0) as pages, count(*) filter (l_returnflag = 'R') > 0 as has_text from orders left join lineitem on o_orderkey = l_orderkey group by 1""")
def detail_header(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("p"), F.max(F.col("l_returnflag") == "R").alias("t"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("p", F.lit(0)).alias("pages"), F.coalesce("t", F.lit(False)).alias("has_text"))


@query("""
with s as (select user_id, event_type, max(event_id // 1000) as generation from events group by 1, 2)
select e.event_id, e.user_id, e.event_type from events e join s on e.user_id = s.user_id and e.event_type = s.event_type and e.event_id // 1000 = s.generation""")
def active_generation(spark, d):
    e = table(spark, d, "events").withColumn("generation", F.floor(F.col("event_id") / 1000))
    state = e.groupBy("user_id", "event_type").agg(F.max("generation").alias("generation"))
    return e.join(state, ["user_id", "event_type", "generation"]).select("event_id", "user_id", "event_type")


@query("""
select user_id, event_id, ts::varchar as at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20""")
def history_page(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("n", rank).where("n <= 20")
    return rows.select("user_id", "event_id", F.col("ts").cast("string").alias("at"))


@query("""
select text_md5, doc_id from (select md5(text) as text_md5, doc_id, row_number() over (partition by md5(text) order by coalesce(quality, -1) desc, n_chars desc, d.doc_id) as n, count(*) over (partition by md5(text)) as c
from documents d left join labels using (doc_id)) where n = 1 and c > 1""")
def richest_duplicate(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("text_md5")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    several = joined.groupBy("text_md5").agg(F.count("*").alias("c")).where("c > 1").select("text_md5")
    return C.best_of_each(joined.join(several, "text_md5"), ["text_md5"], [F.coalesce("quality", F.lit(-1)).desc(), F.desc("n_chars"), F.col("doc_id")]).select("text_md5", "doc_id")


@query("""
select user_id, min_by(props, event_id) is distinct from max_by(props, event_id) as edited from events group by 1""")
def edited_since_creation(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.min_by("props", "event_id").alias("a"), F.max_by("props", "event_id").alias("b"))
    return g.select("user_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("edited"))


@query("""
with e as (select user_id, event_type, ts, case when value >= 20 then 'accepted' else 'candidate' end as status from events),
a as (select user_id, event_type, max(status = 'accepted') as sure from e where ts >= '2024-01-10' group by 1, 2), b as (select user_id, event_type, max(status = 'accepted') as sure from e where ts < '2024-01-24' group by 1, 2)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type,
       case when b.user_id is null then 'add' when a.user_id is null then 'withdraw' when b.sure and not a.sure then 'demote' else 'keep' end as action
from a full join b on a.user_id = b.user_id and a.event_type = b.event_type""")
def edge_demotions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", F.when(F.col("value") >= 20, "accepted").otherwise("candidate").alias("status"))
    return G.reconcile_statuses(e.where("ts >= timestamp_ntz'2024-01-10'"), e.where("ts < timestamp_ntz'2024-01-24'"), ["user_id", "event_type"])


@query("""
with recursive r as (select o_orderkey as id, case when o_totalprice < 60000 then 'soft_deleted' when o_orderstatus = 'O' then 'active' else 'merged' end as status, case when o_orderstatus <> 'F' or o_orderkey % 5 > 0 then o_orderkey - 1 - o_custkey % 9 end as into_ from orders),
c as (select id as first, id, status, into_ from r union all select c.first, r.id, r.status, r.into_ from c join r on c.status = 'merged' and r.id = c.into_)
select r.id, max(case when c.status = 'active' then c.id end) as usable from r left join c on c.first = r.id group by 1""")
def usable_records(spark, d):
    status = F.when(F.col("o_totalprice") < 60000, "soft_deleted").when(F.col("o_orderstatus") == "O", "active").otherwise("merged")
    into = F.when((F.col("o_orderstatus") != "F") | (F.col("o_orderkey") % 5 > 0), F.col("o_orderkey") - 1 - F.col("o_custkey") % 9)
    return G.usable_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), into.alias("into")))


@query("""
with e as (select *, case when event_id % 3 = 0 then 'kind' else 'note' end as field, case when value < 8 then '' when event_id % 3 = 0 then event_type else props end as v, case when event_type = 'signup' then 'delete' else 'set' end as op from events),
o as (select *, op <> 'delete' and field = 'kind' and v <> '' and v not in ('click', 'view', 'purchase') as outside from e),
h as (select *, last_value(case when op = 'delete' then false when v <> '' and not outside then true end ignore nulls) over (partition by user_id, field order by ts, event_id rows between unbounded preceding and 1 preceding) as held from o)
select event_id, user_id, field, case when op = 'delete' then 'admitted' when outside then 'invalid_enum' when v <> '' then 'admitted' when held then 'empty_overwrite' else 'none' end as outcome from h""")
def claim_refusals(spark, d):
    field = F.when(F.col("event_id") % 3 == 0, "kind").otherwise("note")
    value = F.when(F.col("value") < 8, "").when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))
    claims = table(spark, d, "events").select("event_id", "user_id", "ts", field.alias("field"), value.alias("value"), F.when(F.col("event_type") == "signup", "delete").otherwise("set").alias("op"))
    return L.field_outcomes(claims, ["user_id"], {"kind": ("click", "view", "purchase")}).select("event_id", "user_id", "field", "outcome")
