"""Totals of nested groups in one pass, as a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_tree(chunks: DataFrame, slices: dict[str, Column] | None = None) -> DataFrame:
    """One row: works, aligned_works, pages, chunks, slices..., and ``variants`` as an array of structs.

    ``chunks``: work, variant, engine, page, chunk_id, of texts that are in use. Each variant has its
    works, those of a known engine and those without, and its engines with their works, all in
    order of name. ``slices`` are named conditions, of which the works are counted in the total and in each
    variant. The rows are read once: totals of all levels come from grouping sets, whose
    grouping id parts a level's null engine from the level above; nesting folds that small result.
    A work counts once however many chunks it has; blank engines are unknown. No chunks give zeros
    and an empty array.
    """
    slices = slices or {}
    rows = chunks.select("work", "variant", F.nullif(F.trim("engine"), F.lit("")).alias("engine"), "page", "chunk_id", *[F.when(c, F.col("work")).alias(f"_{name}") for name, c in slices.items()])
    known, unknown = F.when(F.col("engine").isNotNull(), F.col("work")), F.when(F.col("engine").isNull(), F.col("work"))
    aligned = F.col("page") > 0
    # The engine is part of a sum and of a group, so it is summed under another name.
    marked = rows.select("*", known.alias("_known"), unknown.alias("_unknown"), F.when(aligned, F.col("work")).alias("_aligned"), F.when(aligned, F.struct("work", "page")).alias("_page"))
    sums = {"works": "work", "known": "_known", "unknown": "_unknown", "aligned_works": "_aligned", "pages": "_page", "chunks": "chunk_id", **{name: f"_{name}" for name in slices}}
    sets = marked.groupingSets([[], ["variant"], ["variant", "engine"]], "variant", "engine").agg(F.grouping_id().alias("level"), *[F.count_distinct(c).alias(name) for name, c in sums.items()])
    of = lambda level, *names: F.max(F.when(F.col("level") == level, F.struct(*names)))
    engines = F.array_sort(F.collect_list(F.when((F.col("level") == 0) & F.col("engine").isNotNull(), F.struct("engine", "works"))))
    by_variant = sets.groupBy("variant", (F.col("level") == 3).alias("total")).agg(of(1, "works", "known", "unknown", *slices).alias("v"), of(3, "works", "aligned_works", "pages", "chunks", *slices).alias("t"), engines.alias("engines"))
    node = F.struct("variant", F.col("v.works").alias("works"), F.col("v.known").alias("known"), F.col("v.unknown").alias("unknown"), *[F.col(f"v.{name}").alias(name) for name in slices], "engines")
    tree = by_variant.agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.when(~F.col("total"), node))).alias("variants"))
    zero = lambda name: F.coalesce(F.col(f"t.{name}"), F.lit(0)).alias(name)
    return tree.select(*map(zero, ("works", "aligned_works", "pages", "chunks", *slices)), "variants")
