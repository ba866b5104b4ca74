"""Catalogue analytics on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import catalogue as C
from ..schema import table
from .registry import query

_WORKS = """works as (select o.*, c.c_name, c.c_mktsegment, c.c_nationkey, cast(year(o_orderdate) as int) as y
  from orders o join customer c on o.o_custkey = c.c_custkey)"""


def _works(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn("y", F.year("o_orderdate"))


@query(f"""
with {_WORKS}, m as (select *, o_orderpriority in ('1-URGENT', '2-HIGH') as mp, c_mktsegment = 'BUILDING' as ms, cast(floor(y / 10) * 10 as int) in (1990) as mc from works)
select 'priority' as dimension, o_orderpriority as key, count(*) as cnt from m where ms and mc group by all
union all select 'segment', c_mktsegment, count(*) from m where mp and mc group by all
union all select 'decade', cast(cast(floor(y / 10) * 10 as int) as varchar), count(*) from m where mp and ms group by all""")
def facet_except_self(spark, d):
    w = _works(spark, d)
    return C.except_self_facets(
        w,
        {
            "priority": (F.col("o_orderpriority"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
            "segment": (F.col("c_mktsegment"), F.col("c_mktsegment") == "BUILDING"),
            "decade": (P.decade_of(F.col("y")), P.decade_of(F.col("y")).isin(1990)),
        },
    )


@query("""
with g as (select o.o_orderkey, o.o_orderstatus, p.p_type as genre from orders o join lineitem l on o_orderkey = l_orderkey join part p on l_partkey = p_partkey)
select 'genre' as dimension, genre as key, count(*) as cnt from g where o_orderstatus = 'F' group by all
union all select 'status', o_orderstatus, count(*) from orders where o_orderkey in (select o_orderkey from g where genre in ('PROMO', 'ECONOMY')) or not exists (select 1 from part where p_type in ('PROMO', 'ECONOMY')) group by all""")
def facet_genre_multivalue(spark, d):
    parts, lines, orders = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "orders")
    wanted = ["PROMO", "ECONOMY"]
    known = parts.where(F.col("p_type").isin(wanted)).isEmpty()
    tags = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(F.collect_list("p_type").alias("genres"))
    works = orders.join(tags, orders.o_orderkey == tags.l_orderkey, "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))
    match = F.lit(True) if known else P.any_of(F.col("genres"), wanted)
    return C.except_self_facets(works, {"genre": (F.col("genres"), match), "status": (F.col("o_orderstatus"), F.col("o_orderstatus") == "F")})


@query(f"""
with {_WORKS}
select o_orderkey, c_name, o_orderpriority, y from works
where (c_name ilike '%00001%' or o_orderpriority ilike '%00001%') and o_orderstatus in ('F', 'O')
order by y nulls first, o_totalprice desc nulls last, o_orderkey limit 24 offset 24""")
def list_filtered_page(spark, d):
    w = _works(spark, d).where(P.any_contains([F.col("c_name"), F.col("o_orderpriority")], " 00001 ") & F.col("o_orderstatus").isin("F", "O"))
    return C.offset_page(w, [F.col("y"), F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey", "c_name", "o_orderpriority", "y")


@query(f"""with {_WORKS} select count(*) as total, cast(greatest(1, ceil(count(*) / 24)) as bigint) as pages from works where c_name ilike '%00001%'""")
def list_total(spark, d):
    w = _works(spark, d).where(P.any_contains([F.col("c_name")], "00001"))
    return w.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / 24)).cast("long").alias("pages"))


@query("""
with a as (select l_orderkey, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1)
select l_orderkey, array_to_string(flags, ',') as flags from a where list_has_any(flags, ['R', 'A'])""")
def list_any_of_arrays(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return a.where(P.any_of(F.col("flags"), ["R", "A"])).select("l_orderkey", F.array_join("flags", ",").alias("flags"))


@query("""
select cast(floor((year(o_orderdate) - 1) / 100) + 1 as int) as century, cast(floor(year(o_orderdate) / 10) * 10 as int) as decade, count(*) as cnt
from orders where year(o_orderdate) >= 1990 and year(o_orderdate) < 2000 group by all""")
def century_decade_filter(spark, d):
    y = F.year("o_orderdate")
    return C.counted(table(spark, d, "orders").where((y >= 1990) & (y < 2000)).select(P.century_of(y).alias("century"), P.decade_of(y).alias("decade")), "century", "decade")


@query("select o_orderkey, o_orderpriority from orders where exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey and p_size > 45)")
def semi_join_tag(spark, d):
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 45")
    tagged = lines.join(parts, lines.l_partkey == parts.p_partkey, "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(tagged, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_join_unlinked(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""
select s_suppkey, s_name, count(o_orderkey) as works from supplier
left join (select l_suppkey, o_orderkey from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F') on s_suppkey = l_suppkey group by all""")
def directory_counts(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    active = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_semi")
    return C.directory(table(spark, d, "supplier").select("s_suppkey", "s_name"), active, "s_suppkey", "l_suppkey", "works")


@query("""
select c_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as roles, count(*) as works
from orders join customer on o_custkey = c_custkey group by all""")
def person_roles(spark, d):
    w = _works(spark, d).groupBy("c_custkey").agg(F.collect_set("o_orderpriority").alias("r"), F.count("*").alias("works"))
    return w.select("c_custkey", F.array_join(F.array_sort("r"), ",").alias("roles"), "works")


@query("""
select o_custkey, p_type as area, count(distinct o_orderkey) as works from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by all""")
def person_areas(spark, d):
    orders, lines, parts = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", F.col("p_type").alias("area"))
    return C.areas_of_people(orders, lines, parts, "o_custkey")


@query("""
select a.o_orderkey, a.o_orderkey - a.o_orderkey % 10 as winner, b.o_orderstatus as winner_status
from orders a left join orders b on a.o_orderkey - a.o_orderkey % 10 = b.o_orderkey where a.o_orderkey % 10 in (1, 2)""")
def merge_redirect(spark, d):
    o = table(spark, d, "orders")
    losers = o.where("o_orderkey % 10 in (1, 2)").select("o_orderkey", (F.col("o_orderkey") - F.col("o_orderkey") % 10).alias("winner"))
    return losers.join(o.select(F.col("o_orderkey").alias("winner"), F.col("o_orderstatus").alias("winner_status")), "winner", "left").select("o_orderkey", "winner", "winner_status")


@query("""
select count(*) as total, count(*) filter (trim(coalesce(nullif(o_orderpriority, '5-LOW'), '')) = '') as blank_priority,
       count(*) filter (o_totalprice < 1000) as cheap, count(distinct o_custkey) as people, cast(min(year(o_orderdate)) as int) as first_year, cast(max(year(o_orderdate)) as int) as last_year from orders""")
def content_audit_counts(spark, d):
    return table(spark, d, "orders").agg(
        F.count("*").alias("total"),
        F.count(F.when(P.is_blank(F.nullif("o_orderpriority", F.lit("5-LOW"))), 1)).alias("blank_priority"),
        F.count(F.when(F.col("o_totalprice") < 1000, 1)).alias("cheap"),
        F.count_distinct("o_custkey").alias("people"),
        F.min(F.year("o_orderdate")).alias("first_year"),
        F.max(F.year("o_orderdate")).alias("last_year"),
    )


@query("""
select regexp_replace(lower(p_name), '[^a-z]+', '', 'g') as dup_key, count(*) as cnt, min(p_partkey) as first_id, max(p_partkey) as last_id
from part group by 1 having count(*) > 1 and dup_key <> ''""")
def duplicate_titles(spark, d):
    return C.same_key_groups(table(spark, d, "part"), F.regexp_replace(F.lower("p_name"), "[^a-z]+", ""), "p_partkey")


@query("""
select c_custkey, count(*) as works from customer join orders on c_custkey = o_custkey where c_acctbal < 0 group by 1 having count(*) >= 1""")
def weak_entities(spark, d):
    weak, orders = table(spark, d, "customer").where("c_acctbal < 0"), table(spark, d, "orders")
    return weak.join(orders, weak.c_custkey == orders.o_custkey).groupBy("c_custkey").agg(F.count("*").alias("works")).where("works >= 1")


@query("""
select axis, bucket, count(*) as cnt from (
  select 'status' as axis, o_orderstatus as bucket from orders
  union all select 'era', case when year(o_orderdate) < 1998 then 'pre-1998' else cast(floor(year(o_orderdate) / 10) * 10 as int) || 's' end from orders
  union all select 'price', coalesce(case when nullif(o_totalprice < 1000, true) is null then null when o_totalprice < 50000 then 'small' when o_totalprice < 200000 then 'medium' else 'large' end, 'unspecified') from orders) group by all""")
def distribution_axes(spark, d):
    price = F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice"))
    return C.axis_counts(
        table(spark, d, "orders"),
        {"status": F.col("o_orderstatus"), "era": P.era_label(F.year("o_orderdate"), 1998), "price": P.bucket_label(price, [(50000, "small"), (200000, "medium")], "large")},
    )


@query("""
with b as (select * from (values ('tiny', 0, 1), ('small', 1, 10), ('medium', 10, 30), ('large', 30, 50), ('huge', 50, 1000)) t(bucket, low, high))
select bucket, count(p_partkey) as cnt from b left join part on p_size >= low and p_size < high group by 1""")
def size_buckets(spark, d):
    label = P.bucket_label(F.col("p_size"), [(1, "tiny"), (10, "small"), (30, "medium"), (50, "large")], "huge")
    names = spark.createDataFrame([(x,) for x in ("tiny", "small", "medium", "large", "huge")], "bucket string")
    return C.directory(names, table(spark, d, "part").select(label.alias("b")), "bucket", "b")


@query("""
select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderdate desc, o_orderkey) as n from orders) where n = 1""")
def representative_row(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return C.best_of_each(table(spark, d, "orders"), ["o_custkey"], [rank, F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""
select o_orderkey, y from (select o_orderkey, case when o_orderkey % 7 = 0 then null else cast(year(o_orderdate) as int) end as y from orders)
where y is null or y < 1997 or (y = 1997 and o_orderkey > 500) order by y desc nulls last, o_orderkey limit 50""")
def keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("y"))
    return C.keyset_page(o, [("y", True), ("o_orderkey", False)], (1997, 500), 50)


@query("""
with n as (select source, doc_id, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as total from documents)
select source, doc_id, cast(rn as int) as rn from n where rn % greatest(1, total // 9) = 0 and rn / greatest(1, total // 9) <= 9""")
def systematic_sample(spark, d):
    return C.systematic_sample(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"]).select("source", "doc_id", "rn")


@query("""
with v as (select distinct l_suppkey, cast(l_partkey as bigint) as p from lineitem),
i as (select l_suppkey, p, p - row_number() over (partition by l_suppkey order by p) as island from v)
select l_suppkey, min(p) as first, max(p) as last, count(*) as length from i group by l_suppkey, island having count(*) >= 2""")
def consecutive_runs(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return C.runs(lines, ["l_suppkey"], "l_partkey", 2)


@query("""
select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'machine' when l.quality = 1 then 'approved' else 'edited' end as state
from documents d full join labels l on d.doc_id = l.doc_id""")
def page_status_map(spark, d):
    docs, marks = table(spark, d, "documents").select("doc_id", F.lit(1).alias("has")), table(spark, d, "labels").select("doc_id", "quality")
    state = F.when(F.col("quality").isNull(), "machine").when(F.col("quality") == 1, "approved").otherwise("edited")
    return docs.join(marks, "doc_id", "full").select("doc_id", state.alias("state"))


@query("""
select source, max(doc_id) as last_doc, max_by(lang, doc_id) as last_lang, count(*) as pages, sum(case when n_chars = 0 then 0 else 1 end)::bigint as nonempty from documents group by 1 having min(n_chars) > 0""")
def whole_document_only(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("last_doc"), F.max_by("lang", "doc_id").alias("last_lang"), F.count("*").alias("pages"), F.count(F.when(F.col("n_chars") != 0, 1)).alias("nonempty"), F.min("n_chars").alias("least"))
    return g.where("least > 0").drop("least")


@query("""
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' else 'updated' end as change
from (select * from orders where o_orderkey % 11 <> 3) a full join (select o_orderkey, case when o_orderkey % 13 = 1 then 'X' else o_orderstatus end as s from orders where o_orderkey % 11 <> 5) b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus is distinct from b.s""")
def collection_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderkey % 11 <> 5").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 1, "X").otherwise(F.col("o_orderstatus")))
    return C.changes(o.where("o_orderkey % 11 <> 3"), after, "o_orderkey", ["o_orderstatus"])


@query("""
with t as (select count(*) as orders, sum(o_totalprice)::double as logical from orders),
u as (select count(distinct o_custkey) as people from orders)
select 'orders' as measure, cast(orders as double) as value from t union all select 'logical', round(logical, 2) from t
union all select 'people', cast(people as double) from u union all select 'unique_price', round(sum(distinct o_totalprice)::double, 2) from orders""")
def archive_summary(spark, d):
    o = table(spark, d, "orders")
    one = o.agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("logical"), F.count_distinct("o_custkey").cast("double").alias("people"), F.round(F.sum_distinct("o_totalprice"), 2).alias("unique_price"))
    return one.unpivot([], ["orders", "logical", "people", "unique_price"], "measure", "value")


@query("""
select p_brand, count(*) as parts, count(*) filter (p_size > 25) as large, round(median(p_size), 3) as median_size,
       round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from part group by 1""")
def coverage_shares(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count(F.when(F.col("p_size") > 25, 1)).alias("large"), F.round(F.median("p_size"), 3).alias("median_size"))
    total = table(spark, d, "part").count()
    return g.withColumn("share", F.round(F.col("parts") / F.lit(total), 6))


@query("""
select 'region' as kind, r_name as slug from region union all select 'nation', n_name from nation union all select 'supplier', s_name from supplier""")
def sitemap_rows(spark, d):
    parts = [("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name")]
    frames = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("slug")) for t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("select doc_id from documents where n_chars > 100 union select doc_id from labels where toxic = 1")
def union_distinct_work_set(spark, d):
    return table(spark, d, "documents").where("n_chars > 100").select("doc_id").union(table(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("""
select 'order_without_customer' as rule, count(*) as violations from orders where o_custkey not in (select c_custkey from customer)
union all select 'line_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'duplicate_line', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'order_without_line', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def invariants(spark, d):
    o, l, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    lost = lambda name, left, right, on: left.join(right, on, "left_anti").agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    return (
        lost("order_without_customer", o, c, o.o_custkey == c.c_custkey)
        .union(lost("line_without_order", l, o, l.l_orderkey == o.o_orderkey))
        .union(l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("duplicate_line").alias("rule"), F.count("*").alias("violations")))
        .union(lost("order_without_line", o, l, o.o_orderkey == l.l_orderkey))
    )


@query("""
select o_orderkey, o_orderstatus, c_name, sha256(o_orderkey || '|' || o_orderstatus || '|' || c_name) as row_hash
from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O')""")
def export_catalogue(spark, d):
    w = _works(spark, d).where(F.col("o_orderstatus").isin("F", "O"))
    return w.select("o_orderkey", "o_orderstatus", "c_name", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "c_name"), 256).alias("row_hash"))


@query("""
select o_custkey, sha256(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey)) as snapshot, count(*) as items from orders group by 1""")
def manifest_hash(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return g.select("o_custkey", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("snapshot"), F.size("ids").cast("long").alias("items"))


@query("""
select n_name, count(c_custkey) as people, cast(coalesce(max(r_regionkey), 0) as int) as region_key from nation left join customer on n_nationkey = c_nationkey join region on n_regionkey = r_regionkey group by 1""")
def map_places(spark, d):
    n, c, r = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "region")
    people = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    return n.join(people, "n_nationkey", "left").join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name").agg(F.sum(F.coalesce("k", F.lit(0))).alias("people"), F.max("r_regionkey").alias("region_key"))


@query("select o_orderkey, cast(year(o_orderdate) as int) as y, o_orderpriority from orders where o_orderstatus = 'F' and year(o_orderdate) is not null")
def timeline(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority").where("y is not null")


@query("""
select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines,
       coalesce((select string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) from lineitem where l_orderkey = o_orderkey), '') as children
from orders""")
def work_detail(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"), F.count("*").alias("lines"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce(text, F.lit("")).alias("children"))


@query("""
with t as (select l_returnflag, l_linestatus, count(*) as n, count(distinct l_orderkey) as docs, count(distinct case when l_tax > 0.04 then l_orderkey end) as taxed from lineitem group by all)
select l_returnflag, l_linestatus, n, docs, taxed, sum(n) over (partition by l_returnflag)::bigint as flag_total from t""")
def text_variant_rollup(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("docs"), F.count_distinct(F.when(F.col("l_tax") > 0.04, F.col("l_orderkey"))).alias("taxed"))
    return g.withColumn("flag_total", F.sum("n").over(Window.partitionBy("l_returnflag")))
