"""Whose record is this: observations resolved against known sources, all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textstats import match_key

#: Sources of these states are not matched by title: fixed values.
GONE = ("merged", "soft_deleted")


def resolve(observations: DataFrame, identifiers: DataFrame, sources: DataFrame, redirects: DataFrame | None = None, paths: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """(obs_id, action, source_id, decision) of every observation.

    ``observations``: obs_id, target_id, ids (array of ``kind:value``), title, author,
    year, and path and match_hash where ``paths`` (path, source_id) and ``hashes``
    (match_hash, source_id) are given. ``identifiers``: ident, source_id; ``redirects``:
    from_ident, to_ident, looked up before it. ``sources``: source_id, title, author,
    year, status. In this order: a given target; one source with a same identifier
    (several are a conflict); one with the same path; one with the same hash of what
    makes a record; a new identifier creates; title, author and year that one source
    shares attach; the same title alone is a candidate; else create. Each rung is an
    equi-join whose right side has one row a key.
    """
    asked = observations.select("obs_id", F.explode("ids").alias("ident"))
    if redirects is not None:
        once = redirects.groupBy(F.col("from_ident").alias("ident")).agg(F.min("to_ident").alias("to_ident"))
        asked = asked.join(once, "ident", "left").select("obs_id", F.coalesce("to_ident", "ident").alias("ident"))
    known = identifiers.groupBy("ident").agg(F.min("source_id").alias("low"), F.max("source_id").alias("high"))
    by_id = (
        asked.join(known, "ident")
        .groupBy("obs_id").agg(F.min("low").alias("id_low"), F.max("high").alias("id_high"))
    )
    alive = sources.where(~F.col("status").isin(*GONE)).select("source_id", match_key(F.col("title")).alias("t"), match_key(F.coalesce("author", F.lit(""))).alias("a"), "year").where("t <> ''")
    by_title = alive.groupBy("t").agg(F.min("source_id").alias("title_first"))
    by_all = alive.where("a <> '' and year is not null").groupBy("t", "a", "year").agg(F.min("source_id").alias("all_first"), F.count("*").alias("all_n"))
    keyed = observations.withColumns({"t": match_key(F.coalesce("title", F.lit(""))), "a": match_key(F.coalesce("author", F.lit("")))})
    joined = keyed.join(by_id, "obs_id", "left").join(by_title, "t", "left").join(by_all, ["t", "a", "year"], "left")
    for name, table, column in (("by_path", paths, "path"), ("by_hash", hashes, "match_hash")):
        if table is None:
            joined = joined.withColumn(name, F.lit(None).cast("long"))
        else:
            # One source alone has the key, or none is meant.
            one = table.groupBy(column).agg(F.min("source_id").alias("_low"), F.max("source_id").alias("_high")).where("_low = _high").select(column, F.col("_low").alias(name))
            joined = joined.join(one, column, "left")
    has_id = F.coalesce(F.size("ids"), F.lit(0)) > 0
    decision = (
        F.when(F.col("target_id").isNotNull(), "explicit_target")
        .when(F.col("id_low") == F.col("id_high"), "strong_single")
        .when(F.col("id_low").isNotNull(), "strong_multi")
        .when(F.col("by_path").isNotNull(), "repo_path_exact")
        .when(F.col("by_hash").isNotNull(), "repo_path_rename_rebind")
        .when(has_id, "strong_new")
        .when(F.col("all_n") == 1, "medium_corroborated")
        .when(F.col("title_first").isNotNull(), F.when((F.col("a") != "") & F.col("year").isNotNull(), "medium_uncorroborated").otherwise("title_only"))
        .otherwise("new")
    )
    d = F.col("decision")
    action = F.when(d.isin("explicit_target", "strong_single", "repo_path_exact", "repo_path_rename_rebind", "medium_corroborated"), "attach").when(d == "strong_multi", "conflict").when(d.isin("medium_uncorroborated", "title_only"), "candidate").otherwise("create")
    source = F.when(d == "explicit_target", F.col("target_id")).when(d == "strong_single", F.col("id_low")).when(d == "repo_path_exact", F.col("by_path")).when(d == "repo_path_rename_rebind", F.col("by_hash")).when(d == "medium_corroborated", F.col("all_first")).when(action == "candidate", F.col("title_first"))
    return joined.withColumn("decision", decision).select("obs_id", action.alias("action"), source.alias("source_id"), "decision")
