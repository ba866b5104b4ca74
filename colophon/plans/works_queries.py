"""Listings of works and files, visibility, review, people, exports and the citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import catalogue as C
from ..operators import graph as G
from ..operators import works as W
from ..schema import table
from ..sources.feeds import missing_runs as missing_runs_of
from .registry import query

#: Orders as works, suppliers' lines as files: the mapping that these queries share.
_WORKS_SQL = """works as (select o_orderkey as work_id, c_name as title, o_orderpriority as category, o_orderstatus as status,
  case when o_orderkey % 9 > 0 then cast(year(o_orderdate) as int) end as year, case when o_orderkey % 4 > 0 then o_totalprice end as significance from orders join customer on o_custkey = c_custkey),
files as (select l_orderkey as work_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as file_id, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as role_rank, l_linenumber as sort_order,
  l_shipdate as submitted_at, l_linestatus = 'F' as has_text, l_partkey as part, l_suppkey as supplier, cast(l_quantity as int) as pages from lineitem),
one as (select * from (select *, row_number() over (partition by work_id order by role_rank, sort_order, file_id) as n from files) where n = 1)"""


def _file_id():
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")


def _works(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("work_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("summary"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 9 > 0, F.year("o_orderdate")).alias("year"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("significance"),
    )


def _files(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("work_id"), _file_id().alias("file_id"), rank.alias("role_rank"), F.col("l_linenumber").alias("sort_order"),
        F.col("l_shipdate").alias("submitted_at"), (F.col("l_linestatus") == "F").alias("has_text"),
    )


def _page_sql(where: str, order: str, after: str = "true") -> str:
    return f"""with {_WORKS_SQL}, cites as (select l_partkey as to_id, count(*) as n from lineitem where l_linenumber = 2 group by 1)
    select p.*, coalesce(n, 0) as citation_count from (
      select w.work_id, o.file_id, w.title, w.year, w.significance, o.has_text from works w join one o using (work_id) where {where} and {after} order by {order} limit 40) p left join cites on to_id = work_id"""


def _page(spark, d, filters: W.WorkFilters, after=None):
    cites = table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").alias("to_id"))
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_linestatus").alias("tag"))
    found = W.list_works(_files(spark, d), _works(spark, d), filters, cites, tags, after, 40)
    return found.select("work_id", "file_id", "title", "year", "significance", "has_text", "citation_count")


@query(_page_sql("title ilike '%0001%' and has_text", "submitted_at desc nulls last, file_id"))
def works_by_update(spark, d):
    return _page(spark, d, W.WorkFilters.of({"q": ["0001"], "ocr": ["with"]}))


@query(_page_sql("category = '2-HIGH' and exists (select 1 from lineitem where l_orderkey = work_id and l_linestatus = 'O')", "title, file_id", "(title > 'Customer#000000030' or (title = 'Customer#000000030' and file_id > 5000000000))"))
def works_by_title(spark, d):
    return _page(spark, d, W.WorkFilters.of({"category": ["2-HIGH"], "tag": ["O"], "sort": ["title"]}), ("Customer#000000030", 5000000000))


@query(_page_sql("year >= 1990 and year < 2000", "year desc nulls last, file_id"))
def works_by_year(spark, d):
    return _page(spark, d, W.WorkFilters.of({"decade": ["1990"], "sort": ["year-desc"]}))


@query(_page_sql("not has_text", "year nulls last, file_id", "(year is null and file_id > 900000000000)"))
def works_without_year(spark, d):
    return _page(spark, d, W.WorkFilters.of({"ocr": ["without"], "sort": ["year-asc"]}), (None, 900000000000))


@query(_page_sql("true", "significance desc nulls last, file_id"))
def works_by_significance(spark, d):
    return _page(spark, d, W.WorkFilters.of({"sort": ["significance"]}))


@query(f"""with {_WORKS_SQL} select work_id, file_id, 'p' || lpad(cast(min(part) over (partition by work_id, file_id) as varchar), 6, '0') as path,
  cast(row_number() over (partition by work_id order by sort_order, file_id, submitted_at desc) as int) as place from files""")
def source_files(spark, d):
    paths = table(spark, d, "lineitem").select(_file_id().alias("file_id"), F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("path"))
    return W.list_files(_files(spark, d), paths).select("work_id", "file_id", "path", "place")


@query("""select p_brand as tag, count(distinct l_orderkey) as works from part join lineitem on p_partkey = l_partkey
where l_returnflag <> 'A' and exists (select 1 from orders where o_orderkey = l_orderkey) group by 1""")
def archive_tag_facet(spark, d):
    lines, parts = table(spark, d, "lineitem").where("l_returnflag <> 'A'"), table(spark, d, "part")
    links = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("p_brand").alias("tag_id"), F.col("l_orderkey").alias("work_id"))
    found = W.tag_facet(parts.select(F.col("p_brand").alias("tag_id")).distinct(), links, table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id")))
    return found.withColumnRenamed("tag_id", "tag")


@query("""select o_orderkey, o_orderstatus = 'F' as public, coalesce(l.n, 0) as readable, coalesce(l.a, 0) as readable_by_admin from orders left join (
  select l_orderkey, count(*) filter (l_linestatus = 'F' and l_returnflag = 'N') as n, count(*) filter (l_linestatus = 'F') as a from lineitem group by 1) l on l_orderkey = o_orderkey""")
def visibility(spark, d):
    lines = table(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "N", "available").when(F.col("l_returnflag") == "A", "embargoed").otherwise("takedown")
    seen = lambda role: F.count(F.when(W.is_readable(F.col("l_linestatus") == "F", state, role), 1))
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(seen("reader").alias("n"), seen("archive_admin").alias("a"))
    public = W.is_public(F.when(F.col("o_orderstatus") == "F", "active").otherwise("hidden"))
    return table(spark, d, "orders").join(sums, "o_orderkey", "left").select("o_orderkey", public.alias("public"), F.coalesce("n", F.lit(0)).alias("readable"), F.coalesce("a", F.lit(0)).alias("readable_by_admin"))


@query("""select l_orderkey, l_linenumber, l_returnflag = 'N' as reader, l_returnflag in ('N', 'A') as admin from lineitem where l_linenumber in (1, 3, 4, 5)""")
def access_gate(spark, d):
    state = F.when(F.col("l_returnflag") == "N", "available").when(F.col("l_returnflag") == "A", "embargoed").otherwise("sealed")
    lines = table(spark, d, "lineitem").where(F.col("l_linenumber").isin(W.selected_pages("1,3-5")))
    return lines.select("l_orderkey", "l_linenumber", W.may_open(state, "reader").alias("reader"), W.may_open(state, "archive_admin").alias("admin"))


@query("""select o_orderkey as request_id, o_orderstatus as status, cast(l_quantity as int) as summary from (
  select * from orders where o_orderstatus <> 'F' order by o_orderdate desc, o_orderkey limit 100) left join (select * from lineitem where l_linenumber = 1 and l_returnflag = 'R') on l_orderkey = o_orderkey""")
def review_queue(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "approved").otherwise("applied")
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("observation_id"), status.alias("status"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))
    diffs = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("observation_id"), F.when(F.col("l_returnflag") == "R", "proposal").otherwise("applied").alias("kind"), F.col("l_quantity").cast("int").alias("summary"))
    return W.review_queue(requests, diffs).select("request_id", F.col("o_orderstatus").alias("status"), "summary")


@query("""select c_custkey as user_id, case c_mktsegment when 'BUILDING' then 'archive_admin' end as role, case when c_custkey % 5 = 0 then 'login' || c_custkey end as login,
  case when c_name like '%7' then 'system' when c_custkey % 3 = 0 then 'machine' else 'person' end as kind from customer""")
def users_by_kind(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "user_id")
    users = c.select("user_id", F.concat(F.lit("u@x."), F.when(F.col("c_name").endswith("7"), "invalid").otherwise("org")).alias("email"))
    roles = c.select("user_id", F.when(F.col("c_mktsegment") == "BUILDING", "archive_admin").otherwise(F.col("c_mktsegment")).alias("role"))
    ids = c.select("user_id", F.explode(F.array(F.struct(F.lit("github_login").alias("kind"), F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("login"), F.col("user_id").cast("string"))).alias("value")), F.struct(F.lit("service_token").alias("kind"), F.when(F.col("user_id") % 3 == 0, F.lit("t")).alias("value")))).alias("i")).select("user_id", "i.kind", "i.value").where("value is not null")
    return W.user_kinds(users, roles, ids).select("user_id", "role", "login", "kind")


@query("""with l as (select distinct l_suppkey, l_orderkey, l_returnflag from lineitem)
select l_suppkey as person_id, count(*) as entries, count(distinct l_orderkey) as works, count(distinct l_returnflag) as roles from l join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' group by 1""")
def person_detail(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("work_id"), F.col("l_returnflag").alias("role"))
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("hidden").alias("status"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))
    return W.person_works(links, works).groupBy("person_id").agg(F.count("*").alias("entries"), F.count_distinct("work_id").alias("works"), F.count_distinct("role").alias("roles"))


@query("""select o_orderkey, o_totalprice, (select count(*) from orders where o_orderpriority = '1-URGENT') > 25 as truncated from orders where o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey limit 25""")
def capped_list(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    return W.capped(urgent, [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("""select o_orderkey, cast(year(o_orderdate) as int) as y from orders join customer on o_custkey = c_custkey where c_name ilike '%0007%' order by y nulls first, o_orderkey limit 8""")
def quick_search(spark, d):
    found = _works(spark, d).where(F.lower("title").contains("0007")).join(table(spark, d, "orders"), F.col("work_id") == F.col("o_orderkey"))
    return found.select("o_orderkey", F.year("o_orderdate").alias("y")).orderBy(F.asc_nulls_first("y"), "o_orderkey").limit(8)


@query("""
with e as (select distinct l_suppkey as src, l_partkey as dst from lineitem where l_suppkey <> l_partkey and l_partkey in (select s_suppkey from supplier))
select src, dst from e where not (1990 + src % 7 < 1990 + dst % 7 - 1)""")
def citation_edges(spark, d):
    ident = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    edges = table(spark, d, "lineitem").select(ident("l_suppkey").alias("from_ident"), ident("l_partkey").alias("to_ident"))
    owners = table(spark, d, "supplier").select(ident("s_suppkey").alias("ident"), F.col("s_suppkey").alias("source_id"))
    years = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.lit(1990) + F.col("s_suppkey") % 7).alias("year"))
    return G.citation_edges(edges, owners, years)


@query("""
with p as (select p_partkey as id, split_part(lower(p_name), ' ', 1) || '/' || p_size as key, lower(p_name) as title, p_brand as author, case when p_partkey % 5 > 0 then cast(1900 + p_partkey % 3 as int) end as year from part),
f as (select * from p where key in (select key from p where length(key) >= 5 group by 1 having count(*) between 2 and 30)),
j as (select a.id as ia, b.id as ib, a.year as ya, b.year as yb, a.title = b.title as same, contains(a.title, b.title) or contains(b.title, a.title) as inside,
  list_has_any(regexp_extract_all(lower(a.author), '[\\p{L}\\p{N}]{2,}'), regexp_extract_all(lower(b.author), '[\\p{L}\\p{N}]{2,}')) as names from f a join f b on a.key = b.key and a.id < b.id),
t as (select *, case when inside and ya = yb then 'duplicate-of' when inside and ya is not null and yb is not null then 'edition-of' when same then case when names then 'same-work' end else 'same-work' end as type from j)
select case when type = 'edition-of' and yb > ya then ib else ia end as from_id, case when type = 'edition-of' and yb > ya then ia else ib end as to_id, type from t where type is not null""")
def work_relations(spark, d):
    key = F.concat(F.split(F.lower("p_name"), " ")[0], F.lit("/"), F.col("p_size").cast("string"))
    return G.work_relations(table(spark, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), F.lower("p_name").alias("title"), F.col("p_brand").alias("author"), F.when(F.col("p_partkey") % 5 > 0, F.lit(1900) + F.col("p_partkey") % 3).cast("int").alias("year")))


@query("""
with m as (select o_orderkey as work_id, generate_series as page from orders, generate_series(1, 3) where o_orderkey % 3 = 0), c as (select o_orderkey as work_id, cast(o_custkey % 4 as int) as k from orders),
u as (select work_id, unnest(range(1, k + 1)) as page from c union select work_id, page from m union select l_orderkey, l_linenumber from lineitem)
select u.work_id, cast(u.page as int) as page, case when e.a then 'approved' when e.a is not null then 'edited' when m.page is not null then 'machine' else 'none' end as state
from u left join m on m.work_id = u.work_id and m.page = u.page left join (select l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') as a from lineitem group by 1, 2) e on e.l_orderkey = u.work_id and e.l_linenumber = u.page""")
def page_universe(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), (F.col("o_custkey") % 4).alias("page_count"))
    machine = orders.where("work_id % 3 = 0").select("work_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))
    edited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("page"), (F.col("l_returnflag") == "R").alias("approved"))
    return W.page_states(orders, machine, edited)


@query("""
with recursive x as (select user_id as request_id, ts, event_id, case event_type when 'click' then 'approved' when 'view' then 'applying' when 'signup' then 'applied' when 'error' then 'needs_evidence' else 'open' end as asked, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select request_id, 0 as n, 'open' as status, timestamp '1970-01-01' as since, 0 as refused from x group by 1
  union all select f.request_id, x.n, case when fits then x.asked else status end, case when fits then x.ts else since end, refused + case when fits then 0 else 1 end from (
    select f.*, x.n as xn, case status when 'open' then asked in ('approved', 'rejected', 'needs_evidence') when 'needs_evidence' then asked in ('open', 'approved', 'rejected')
      when 'approved' then asked in ('applying', 'rejected', 'open') when 'applying' then asked in ('applied', 'open', 'approved') else false end as fits from f join x on x.request_id = f.request_id and x.n = f.n + 1) f join x on x.request_id = f.request_id and x.n = f.xn)
select request_id, case when status = 'applying' and since + interval 15 minutes < timestamp '2024-01-30' then 'approved' else status end as status, refused from (select *, row_number() over (partition by request_id order by n desc) as last from f) where last = 1""")
def request_states(spark, d):
    kind = F.col("event_type")
    asked = F.when(kind == "click", "approved").when(kind == "view", "applying").when(kind == "signup", "applied").when(kind == "error", "needs_evidence").otherwise("open")
    events = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("ts").alias("at"), "event_id", asked.alias("status"))
    return W.request_states(events, now=F.expr("timestamp_ntz'2024-01-30'"))


@query("""
with e as (select user_id, event_type, event_id % 150 as into_, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where not (event_type = 'error' and event_id % 150 = user_id))
select c_custkey as source_id, case event_type when 'click' then 'hidden' when 'view' then 'active' when 'signup' then 'deprecated' when 'error' then 'merged' when 'purchase' then 'soft_deleted' else 'active' end as status,
  case when event_type = 'error' then into_ end as merged_into from customer left join (select * from e where n = 1) on user_id = c_custkey""")
def lifecycle_states(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "click", "hide").when(kind == "view", "restore").when(kind == "signup", "deprecate").when(kind == "error", "merge").otherwise("soft_delete")
    events = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("at"), "event_id", op.alias("op"), (F.col("event_id") % 150).alias("into"))
    return W.lifecycle_states(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("active").alias("status")), events)


@query("""
with s as (select distinct lower(replace(p_name, ' ', '-')) || '-' || (p_partkey % 40) as slug from part union select n from (values ('1999'), ('-a'), ('the-and'), ('ab')) t(n)),
live as (select distinct lower(replace(p_name, ' ', '-')) || '-' || (p_size % 40) as slug from part), gone as (select distinct lower(replace(p_name, ' ', '-')) || '-7' as slug from part)
select slug, case when not regexp_matches(slug, '^[a-z0-9][a-z0-9-]{1,59}$') then 'shape'
  when len(list_filter(string_split(slug, '-'), lambda x: regexp_matches(x, '^[a-z]*[a-z]{3}[a-z]*$') and x not in ('the', 'and', 'for', 'with'))) = 0 then 'empty'
  when slug in (select slug from live) then 'taken' when slug in (select slug from gone) then 'retired' end as problem from s""")
def slug_availability(spark, d):
    part = table(spark, d, "part")
    of = lambda n: F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), n.cast("string")).alias("slug")
    odd = spark.createDataFrame([("1999",), ("-a",), ("the-and",), ("ab",)], "slug string")
    return W.slug_problems(part.select(of(F.col("p_partkey") % 40)).union(odd), part.select(of(F.col("p_size") % 40)), part.select(of(F.lit(7))))


@query("""
with recursive named as (select doc_id, case when doc_id % 3 = 0 then md5(text) end as doi, md5(lower(string_split(text, chr(10))[1])) as title from documents),
ranked as (select *, row_number() over (order by doc_id) as n from named),
walk as (select 0::bigint as n, []::varchar[] as seen, null::bigint as kept
         union all
         select r.n, case when list_contains(w.seen, 'd' || coalesce(r.doi, '-')) or list_contains(w.seen, 't' || r.title) then w.seen else list_concat(w.seen, list_filter(['d' || r.doi, 't' || r.title], lambda x: x is not null)) end,
                case when list_contains(w.seen, 'd' || coalesce(r.doi, '-')) or list_contains(w.seen, 't' || r.title) then null else r.doc_id end
         from walk w join ranked r on r.n = w.n + 1)
select kept as doc_id from walk where kept is not null""")
def priority_union(spark, d):
    docs = table(spark, d, "documents")
    named = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("doi"), F.md5(F.lower(F.split("text", "\n")[0])).alias("title"))
    return W.union_by_priority(named, ["doc_id"], ["doi", "title"]).select("doc_id")


@query("""select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 10 in (1, 2) then o_orderkey - o_orderkey % 10 end as merged_into, coalesce(s.slugs, '') as old_slugs
from orders left join (select l_orderkey, string_agg('s' || l_linenumber, ',' order by l_linenumber) as slugs from lineitem where l_returnflag = 'A' group by 1) s on l_orderkey = o_orderkey where o_orderstatus in ('F', 'P')""")
def export_with_redirects(spark, d):
    old = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).join(old, "o_orderkey", "left")
    slugs = F.coalesce(F.array_join(F.transform("n", lambda x: F.concat(F.lit("s"), x.cast("string"))), ","), F.lit(""))
    into = F.when((F.col("o_orderkey") % 10).isin(1, 2), F.col("o_orderkey") - F.col("o_orderkey") % 10)
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), into.alias("merged_into"), slugs.alias("old_slugs"))


@query("""select l_orderkey, l_linenumber, sha256(concat_ws('|', l_orderkey, l_linenumber, p_name, s_name, c_name, o_orderstatus)) as row_hash
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""")
def manifest_rows(spark, d):
    l, o, c, p, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    whole = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    text = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "p_name", "s_name", "c_name", "o_orderstatus")
    return whole.select("l_orderkey", "l_linenumber", F.sha2(text, 256).alias("row_hash"))


@query("""select 'order' as kind, cast(o_orderkey as varchar) as slug, cast(cast(max(l_shipdate) as date) as varchar) as lastmod from orders left join lineitem on o_orderkey = l_orderkey group by 2
union all select 'region', r_name, null from region""")
def sitemap_lastmod(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("m"))
    orders = table(spark, d, "orders").select("o_orderkey").join(last, "o_orderkey", "left").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("slug"), F.to_date("m").cast("string").alias("lastmod"))
    return orders.unionByName(table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("slug"), F.lit(None).cast("string").alias("lastmod")))


@query("""select p_partkey, p_brand || ', ' || p_type || ' (' || (1900 + p_size) || '). ' || p_name || '.' as line from part""")
def reference_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", N.reference_line(F.array("p_brand", "p_type"), F.lit(1900) + F.col("p_size"), F.col("p_name")).alias("line"))


@query("""select o_orderkey, (select count(distinct l_linenumber) from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F') as text_pages,
  exists (select 1 from lineitem where l_orderkey = o_orderkey and (l_returnflag, l_linestatus) in (select l_returnflag, l_linestatus from lineitem where l_quantity >= 50)) as listed,
  (select min(l_partkey) from lineitem where l_orderkey = o_orderkey) as any_scan from orders""")
def file_lookups(spark, d):
    lines = table(spark, d, "lineitem")
    wanted = lines.where("l_quantity >= 50").select("l_returnflag", "l_linestatus").distinct()
    listed = lines.join(wanted, ["l_returnflag", "l_linestatus"], "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("listed", F.lit(True))
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("text_pages"), F.min("l_partkey").alias("any_scan"))
    joined = table(spark, d, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").join(listed, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("text_pages", F.lit(0)).alias("text_pages"), F.coalesce("listed", F.lit(False)).alias("listed"), "any_scan")


@query("""select c_custkey, coalesce(p2.p_name, 'none') as label from customer left join (select l_suppkey, min(l_partkey) as hop from lineitem group by 1) h on l_suppkey = c_custkey left join part p2 on p2.p_partkey = hop""")
def two_hop_lookup(spark, d):
    hop = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c_custkey")).agg(F.min("l_partkey").alias("p_partkey"))
    joined = table(spark, d, "customer").select("c_custkey").join(hop, "c_custkey", "left").join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    return joined.select("c_custkey", F.coalesce("p_name", F.lit("none")).alias("label"))


@query("""with u as (select user_id, cast(ts as date) as day, event_id, ts, case event_type when 'purchase' then 50 else 1 end as units from events)
select event_id, sum(units) over (partition by user_id, day order by ts, event_id rows unbounded preceding)::bigint as used, sum(units) over (partition by user_id, day order by ts, event_id rows unbounded preceding) <= 60 as allowed from u""")
def quota_running(spark, d):
    from pyspark.sql import Window

    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("event_type") == "purchase", 50).otherwise(1)).over(day)
    return table(spark, d, "events").select("event_id", used.alias("used")).withColumn("allowed", F.col("used") <= 60)


@query("""
with o as (select o_orderkey, o_orderstatus, case when o_orderkey % 5 > 0 then o_orderpriority end as p from orders where o_orderkey % 11 <> 3),
n as (select o_orderkey, case when o_orderkey % 13 = 1 then 'X' else o_orderstatus end as s, case when o_orderkey % 7 > 0 then o_orderpriority end as p from orders),
c as (select o_orderkey, 'o_orderstatus' as field, o_orderstatus as a, s as b from o join n using (o_orderkey) union all select o_orderkey, 'p', o.p, n.p from o join n using (o_orderkey))
select o_orderkey, field, case when a is null then 'add' when b is null then 'clear' else 'update' end as op, field || ': ' || coalesce(a, '(none)') || ' -> ' || coalesce(b, '(none)') as line from c where a is distinct from b""")
def change_lines(spark, d):
    o = table(spark, d, "orders")
    before = o.where("o_orderkey % 11 <> 3").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("p"))
    after = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("p"))
    return C.change_lines(before, after, "o_orderkey", ["o_orderstatus", "p"])


@query("""
select 'order_without_line' as rule, count(*) as violations, coalesce((select string_agg(k::varchar, ',' order by k) from (select o_orderkey as k from orders where o_orderkey not in (select l_orderkey from lineitem) order by 1 limit 5)), '') as samples from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'dear_order', count(*), coalesce((select string_agg(k::varchar, ',' order by k) from (select o_orderkey as k from orders where o_totalprice > 400000 order by 1 limit 5)), '') from orders where o_totalprice > 400000""")
def invariant_samples(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.violations("order_without_line", o.join(l, "o_orderkey", "left_anti"), "o_orderkey").union(C.violations("dear_order", o.where("o_totalprice > 400000"), "o_orderkey"))


@query("""
with e as (select user_id, event_id, case when event_id % 3 = 0 then event_type end as kind, case when event_id % 4 = 0 then props end as props from events)
select user_id, arg_min(kind, event_id) filter (kind is not null) as kind, arg_min(props, event_id) filter (props is not null) as props from e group by 1""")
def gap_filled(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("props"))
    return C.filled_by_priority(e, "user_id", ["event_id"], ["kind", "props"])


@query("""
with r as (select user_id as record, cast(day(ts) as int) as run from events), l as (select record, max(run) as last from r group by 1)
select record, (select count(distinct run) from r where run > last) as missing from l""")
def missing_runs(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("record"), F.dayofmonth("ts").alias("run"))
    return missing_runs_of(seen.select("run"), seen)


@query("""
select o_orderkey, coalesce((select string_agg(l_linenumber || '/' || l_quantity::int, ',' order by l_linenumber, l_quantity::int) from lineitem where l_orderkey = o_orderkey), '') as lines,
  coalesce((select string_agg(s, ',' order by s) from (select distinct l_suppkey as s from lineitem where l_orderkey = o_orderkey)), '') as suppliers from orders""")
def work_children(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kinds = {"lines": l.select("o_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")), "suppliers": l.select("o_orderkey", "l_suppkey").distinct()}
    nested = C.nested_children(table(spark, d, "orders").select("o_orderkey"), kinds, "o_orderkey")
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("/"), x["q"].cast("string"))), ",")
    return nested.select("o_orderkey", lines.alias("lines"), F.array_join(F.transform("suppliers", lambda x: x["l_suppkey"].cast("string")), ",").alias("suppliers"))


@query("""
with p as (select s_suppkey, lower(replace(s_name, '#', '-')) as old_slug, 'sup-' || (s_suppkey % 90) as new_slug from supplier), n as (select new_slug, count(*) as n from p group by 1)
select case when n = 1 and new_slug <> old_slug then new_slug else old_slug end as slug, s_suppkey, n = 1 and new_slug <> old_slug as redirected from p join n using (new_slug)""")
def reslug_applied(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("old_slug"), F.concat(F.lit("sup-"), (F.col("s_suppkey") % 90).cast("string")).alias("new_slug"))
    counts = p.groupBy("new_slug").agg(F.count("*").alias("n"))
    plan = p.join(counts, "new_slug").withColumn("state", F.when((F.col("n") == 1) & (F.col("new_slug") != F.col("old_slug")), "rename").otherwise("refuse"))
    done, redirects = C.renamed(p.select(F.col("old_slug").alias("slug"), "s_suppkey"), plan)
    return done.join(redirects.select(F.col("new_slug").alias("slug"), F.lit(True).alias("redirected")), "slug", "left").select("slug", "s_suppkey", F.coalesce("redirected", F.lit(False)).alias("redirected"))
