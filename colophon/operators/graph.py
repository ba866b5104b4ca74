"""Citation graph: degrees, PageRank, same-work pairs, reconciliation, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Stored
from ..scratch import stored as _stored


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every end of (src, dst); parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """(node, rank): PageRank with fixed rounds from a uniform start.

    The rank of nodes without out-edges is dealt evenly to all; parallel edges count as
    many times. Only nodes with out-edges give rank on, so the rounds follow the edges
    between those alone; what all nodes without out-edges hold together is one number,
    carried along, and their own ranks are worked out in the last round. Edges are stored
    once with their source's share, and ranks after every round: plans stay short and a lost
    executor costs one round. The ranks of earlier rounds are deleted.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = _stored(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")), "links")
    nodes = nodes.select("node").distinct().join(links.select(F.col("src").alias("node")).distinct().withColumn("gives", F.lit(True)), "node", "left")
    nodes = _stored(nodes.select("node", F.coalesce("gives", F.lit(False)).alias("gives")), "nodes")
    n, givers = nodes.agg(F.count("*"), F.count_if("gives")).first()
    if rounds < 1:
        return nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    ends = links.join(nodes.select(F.col("node").alias("dst"), "gives"), "dst")
    inner = _stored(ends.where("gives").select("src", "dst", "share"), "inner")
    # What each node gives to nodes without out-edges.
    lost = ends.where(~F.col("gives")).groupBy(F.col("src").alias("node")).agg(F.sum("share").alias("lost"))
    core = _stored(nodes.where("gives").select("node").join(lost, "node", "left").select("node", F.coalesce("lost", F.lit(0.0)).alias("lost")), "core")
    rounds_of, base = Stored(nodes.sparkSession, "ranks"), (1 - damping) / max(n, 1)
    ranks, loose = core.withColumn("rank", F.lit(1.0 / max(n, 1))), (n - givers) / max(n, 1)
    next_rank = lambda: F.lit(base) + damping * (F.coalesce("given", F.lit(0.0)) + F.lit(loose / max(n, 1)))
    passed = lambda edges: edges.join(ranks, edges.src == ranks.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
    for _ in range(rounds - 1):
        moved = ranks.agg(F.sum(F.col("rank") * F.col("lost"))).first()[0] or 0.0
        ranks = rounds_of.keep(core.join(passed(inner), "node", "left").select("node", "lost", next_rank().alias("rank")))
        rounds_of.drop(but=1)
        loose = (n - givers) * (base + damping * loose / max(n, 1)) + damping * moved
    return _stored(nodes.join(passed(links), "node", "left").select("node", next_rank().alias("rank")), "last")


def significance(ranks: DataFrame) -> DataFrame:
    """Ranks as shares of the highest."""
    top = ranks.agg(F.max("rank")).first()[0] or 1e-9
    return ranks.select("node", F.round(F.col("rank") / F.lit(max(top, 1e-9)), 6).alias("significance"))


def same_key_pairs(df: DataFrame, key: Column, id_column: str, most: int = 30, least_key: int = 5) -> DataFrame:
    """(id_a, id_b, dup_key): pairs that share a key of at least ``least_key`` characters.

    Keys of more than ``most`` rows are no evidence and give no pairs, as in the
    inference this follows; their rows are counted before any pair is built.
    """
    keyed = df.select(F.col(id_column).alias("id"), key.alias("dup_key")).where(F.length("dup_key") >= least_key)
    groups = keyed.groupBy("dup_key").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).drop("n")
    few = keyed.join(groups, "dup_key")
    return few.select("dup_key", F.col("id").alias("id_a")).join(few.select("dup_key", F.col("id").alias("id_b")), "dup_key").where("id_a < id_b")


def citation_edges(edges: DataFrame, identifiers: DataFrame, years: DataFrame) -> DataFrame:
    """(src, dst): citations (from_ident, to_ident) between the sources that own the identifiers.

    Ends that nobody owns, loops, and works that would cite one of more than a year
    later are left out; each edge is once. ``years``: source_id, year.
    """
    owner = lambda name, end: identifiers.select(F.col("ident").alias(name), F.col("source_id").alias(end))
    of = lambda end: years.select(F.col("source_id").alias(end), F.col("year").alias(f"{end}_year"))
    found = edges.join(owner("from_ident", "src"), "from_ident").join(owner("to_ident", "dst"), "to_ident").where("src <> dst").select("src", "dst").distinct()
    dated = found.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return dated.where(~F.coalesce(F.col("src_year") < F.col("dst_year") - 1, F.lit(False))).select("src", "dst")


def work_relations(works: DataFrame, most: int = 30, least_key: int = 5) -> DataFrame:
    """(from_id, to_id, type): how works (id, key, title, author, year) of one key are related.

    Of two different titles of which one holds the other: an edition (the later of the
    earlier) if their years differ, a duplicate if they are the same. Of one title:
    the same by years, and without both years the same work if a name is shared.
    Any other pair of different titles is the same work.
    """
    sized = works.where(F.length("key") >= least_key)
    few = sized.join(sized.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("key"), "key")
    side = lambda x: few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "title", "author", "year")])
    pairs = side("a").join(side("b"), "key").where("id_a < id_b")
    same, inside = F.col("title_a") == F.col("title_b"), F.contains("title_a", "title_b") | F.contains("title_b", "title_a")
    names = lambda x: F.regexp_extract_all(F.lower(F.coalesce(f"author_{x}", F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), 0)
    dated, one_year = F.col("year_a").isNotNull() & F.col("year_b").isNotNull(), F.col("year_a") == F.col("year_b")
    kind = (
        F.when(inside & dated & one_year, "duplicate-of")
        .when(inside & dated, "edition-of")
        .when(same, F.when(F.arrays_overlap(names("a"), names("b")), "same-work"))
        .otherwise("same-work")
    )
    later = (kind == "edition-of") & (F.col("year_b") > F.col("year_a"))
    return pairs.select(F.when(later, F.col("id_b")).otherwise(F.col("id_a")).alias("from_id"), F.when(later, F.col("id_a")).otherwise(F.col("id_b")).alias("to_id"), kind.alias("type")).where("type is not null")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): every end of edges (a, b) with the smallest end that edges reach.

    Each round joins a node to the first of its neighbours and itself, in an order of the
    round's own that a hash gives, and goes on with the edges between what is joined. So a part
    of the nodes goes every round, however ends are named and chains are laid, and rounds get shorter.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct()
    kept, joined = Stored(spark, "links"), Stored(spark, "joined")
    links, steps = kept.keep(both), []
    while not steps or not links.isEmpty():
        order = lambda c, n=len(steps): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("to"))
        first = links.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["to"].alias("to"))
        steps.append(joined.keep(first))
        of = lambda c: steps[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        left = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        links = kept.keep(left)
        kept.drop()
    labels = Stored(spark, "labels")
    whole = steps.pop()
    while steps:
        further = whole.select(F.col("node").alias("to"), F.col("to").alias("end"))
        whole = labels.keep(steps.pop().join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
        labels.drop()
    least = whole.groupBy("to").agg(F.min("node").alias("component"))
    found = labels.keep(whole.join(least, "to").select("node", "component"))
    for tables in (kept, joined):
        tables.drop(but=0)
    labels.drop()
    return found


def reconcile(asserted: DataFrame, live: DataFrame, keys: list[str], most_withdrawn: float = 0.34) -> DataFrame:
    """(keys, action): add, keep or withdraw edges; refuses to withdraw too large a share."""
    a, b = asserted.select(*keys).distinct().withColumn("a", F.lit(1)), live.select(*keys).distinct().withColumn("b", F.lit(1))
    both = a.join(b, keys, "full").select(*keys, F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "withdraw").otherwise("keep").alias("action"))
    sums = {r["action"]: r["count"] for r in both.groupBy("action").count().collect()}
    standing = sums.get("keep", 0) + sums.get("withdraw", 0)
    if standing and sums.get("withdraw", 0) > most_withdrawn * standing:
        raise ValueError(f"{sums['withdraw']} of {standing} edges would be withdrawn")
    return both


def reconcile_statuses(asserted: DataFrame, live: DataFrame, keys: list[str], most_withdrawn: float = 0.34) -> DataFrame:
    """(keys, action): as ``reconcile``, and ``demote`` for accepted edges that are asserted as candidates alone.

    Both sides have a ``status``, accepted or candidate. Of several assertions of an edge an accepted
    one counts, and so of several live rows. Rows with a null key are left out.
    """
    whole = lambda df: df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys)
    sure = F.max(F.coalesce(F.col("status") == "accepted", F.lit(False)))
    wanted, held = whole(asserted).agg(sure.alias("_wanted")), whole(live).agg(sure.alias("_held"))
    actions = reconcile(wanted, held, keys, most_withdrawn)
    both = actions.join(wanted, keys, "left").join(held, keys, "left")
    return both.select(*keys, F.when((F.col("action") == "keep") & F.col("_held") & ~F.col("_wanted"), "demote").otherwise(F.col("action")).alias("action"))


def usable_rows(rows: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, usable): the row that stands for each id, over all merges it went into.

    ``rows``: id, status, into; an id has one row. Merged rows lead on to ``into``; null where a
    chain ends at no row, at a soft-deleted one, at a merged one without target, or never.
    """
    ends = final_targets(rows.where("status = 'merged'").select("id", "into"), rounds)
    last = rows.select("id", "status").join(ends, "id", "left").select("id", F.when(F.col("status") == "merged", F.col("target")).otherwise(F.col("id")).alias("end"))
    standing = rows.where("status is null or status not in ('merged', 'soft_deleted')").select(F.col("id").alias("end"), F.lit(True).alias("stands"))
    return last.join(standing, "end", "left").select("id", F.when(F.col("stands"), F.col("end")).alias("usable"))


def final_targets(pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, target): where chains of (id, into) end; ids on a cycle have a null target.

    Each round doubles the distance looked ahead, so long chains need few rounds.
    """
    at = _stored(pointers.where("into is not null").groupBy("id").agg(F.min("into").alias("into")), "pointers")
    for _ in range(rounds):
        ahead = at.select(F.col("id").alias("into"), F.col("into").alias("further"))
        at = _stored(at.join(ahead, "into", "left").select("id", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")), "pointers")
        if at.where("moved").isEmpty():
            break
        # A cycle never comes to rest: once all chains must have ended, what moves is on one.
        at = at.drop("moved") if _ < rounds - 1 else at
    on_cycle = F.col("moved") if "moved" in at.columns else F.lit(False)
    return at.select("id", F.when(~on_cycle, F.col("into")).alias("target"))


def within_hops(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, hops): nodes reached from ``seeds`` (node) over edges (a, b), with the fewest steps.

    Each round follows the edges of the newest nodes alone and is stored.
    """
    seen = _stored(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "frontier")
    for step in range(1, hops + 1):
        newest = seen.where(F.col("hops") == step - 1)
        ahead = newest.join(edges, newest.node == edges.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = _stored(seen.union(ahead.withColumn("hops", F.lit(step))), "frontier")
    return seen
