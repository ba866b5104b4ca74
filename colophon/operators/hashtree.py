"""Canonical forms of open maps, and a tree of hashes over rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Stored

#: Children of a node.
FAN = 256


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every map in byte order and no white space; null for what is no JSON.

    A VARIANT keeps the fields of a map by name, at every depth, and arrays as they are, so
    reading and writing one is the canonical form. Of a key that comes twice neither is told apart: null.
    """
    return F.to_json(F.try_parse_json(text))


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)


def hash_tree(rows: DataFrame, order: list[str], row_hash: str = "row_hash", fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, index, first, hash): a tree over rows' hashes in a total order; its one node of the highest level is the root.

    Level 0 has the rows in order of ``order`` and hash, each next level one node for
    ``fan`` consecutive ones: SHA-256 of their hashes, one after the other. ``first`` is the
    row's (or first row's) value of ``order`` as JSON. Rows are numbered over ranges, of which the driver
    knows their sizes alone; a level is a grouped fold of a ``fan``-th of the one below. Swapping,
    repeating or changing rows changes the root. No rows give no nodes. ``levels``, if given, is the
    highest level asked for: of more than ``fan ** levels`` rows it holds several nodes and no root.
    """
    spark = rows.sparkSession
    store = Stored(spark, "tree")
    keys = [F.col(c).asc_nulls_first() for c in (*order, row_hash)]
    # The id of a row is its range and place; stored, so that both stay.
    placed = rows.select(*order, row_hash).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ordered = store.keep(placed.select(F.to_json(F.struct(*order), {"ignoreNullFields": "false"}).alias("first"), F.col(row_hash).alias("hash"), F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, starts = 0, []
    for part, n in ordered.groupBy("part").count().orderBy("part").collect():
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, start long")
    level = store.keep(ordered.join(offsets, "part").select(F.lit(0).alias("level"), (F.col("start") + F.col("at")).alias("index"), "first", "hash"))
    built, n, k = [level], before, 0
    while n > 1 and (levels is None or k < levels):
        n, k = -(-n // fan), k + 1
        run = F.array_sort(F.collect_list(F.struct("index", "first", "hash")))
        nodes = level.groupBy(F.floor(F.col("index") / fan).alias("up")).agg(run.alias("run"))
        level = store.keep(nodes.select(F.lit(k).alias("level"), F.col("up").alias("index"), F.col("run")[0]["first"].alias("first"), F.sha2(F.array_join(F.transform("run", lambda r: r["hash"]), ""), 256).alias("hash")))
        built.append(level)
    whole = built[0]
    for level in built[1:]:
        whole = whole.unionByName(level)
    return whole


def root_of(tree: DataFrame) -> str | None:
    """The hash that pins all rows; null of none."""
    return tree.agg(F.max_by("hash", "level")).first()[0]


def differing(tree: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """(index, first, other_first): where two trees of equally many rows differ, found from the root down.

    Of each level only the children of nodes that differ are compared.
    """
    levels = tree.agg(F.max("level")).first()[0]
    at = lambda t, k: t.where(F.col("level") == k)
    found = None
    for k in range(levels if levels is not None else -1, -1, -1):
        mine, theirs = at(tree, k), at(other, k).select("index", F.col("first").alias("other_first"), F.col("hash").alias("other_hash"))
        if found is not None:
            mine = mine.join(found.select(F.col("index").alias("up")), F.floor(F.col("index") / fan) == F.col("up"), "left_semi")
        found = mine.join(theirs, "index").where(F.col("hash") != F.col("other_hash")).select("index", "first", "other_first")
    return tree.sparkSession.createDataFrame([], "index long, first string, other_first string") if found is None else found
