"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``links`` with the smallest node it reaches.

    Alternating large-star and small-star rounds point every node at the smallest
    neighbour known so far until nothing moves, a logarithmic number of rounds for
    chains. Each round is a grouped minimum (combined before the shuffle, so a hub
    costs one row per task) and one equi-join, whose hot keys Spark can split. Rounds
    are cut off from their history by a table in the shared folder.

    Links with a null end and loops are left out; repeated links count once; no links
    give no rows.
    """
    a, b = F.col(a), F.col(b)
    edges = stored(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    now = _signature(edges)
    while now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(low, "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        before, now = now, _signature(edges)
        if now == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
