"""Mixing sources to target weights: whole copies for all, the rest by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, over and over, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: The ranks of a source are cut twice into so many ranges, until few documents are left to order.
RANGES = 4096


def bits(size: Column) -> Column:
    """Binary digits of a size: how much likelier a longer document is to get one more copy."""
    return F.length(F.bin(size)).cast("int")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, u): words of each whole text, and a number in (0, 1) drawn from the document itself."""
    text = F.coalesce("text", F.lit(""))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ((F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares of all sizes by weight.

    Sources by code point, null last, weigh ``weights`` over and over. A target stops at
    ``most`` times its source's size, and what is over is shared by weight among the
    others until none is above. With the sources in order of ``most * size / weight``
    those that stop come first, so the share of the first one that does not holds for
    all the rest: two windows over one row a source.
    """
    named = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("long")
    capped = named.withColumns({"weight": weight, "cap": F.col("source_size") * most}).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "n")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = capped.withColumn("share", (F.sum("source_size").over(every) - before) / left)
    common = F.max(F.when(F.col("ratio") > F.col("share"), F.col("share"))).over(every)
    target = F.when(F.col("ratio") <= F.col("share"), F.col("cap").cast("double")).otherwise(common * F.col("weight"))
    return shared.select("source", "source_size", target.alias("target"))


def inclusion(targets: DataFrame, classes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, class, source_size, target, copies, p, rest) of each class of sizes of each source.

    Every document has ``copies`` whole copies. One more falls to it with probability
    ``p``, which grows with the class's number and is 1 from the class on where it would
    be more; expected words are then the source's target. ``rest``: words of the
    target that the classes with ``p`` below 1 still owe.
    """
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    owed = targets.withColumn("copies", base).withColumn("owed", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    rows = classes.join(owed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    largest = Window.partitionBy("source").orderBy(F.desc("class"))
    before = F.coalesce(F.sum("words").over(largest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.nullif(F.sum(F.col("class") * F.col("words")).over(largest.rowsBetween(0, Window.unboundedFollowing)), F.lit(0))
    scaled = rows.withColumn("c", (F.col("owed") - before) / left).withColumn("sure", F.col("class") * F.col("c") >= 1)
    every = Window.partitionBy("source")
    c = F.max(F.when(~F.col("sure"), F.col("c"))).over(every)
    rest = F.col("owed") - F.coalesce(F.sum(F.when(F.col("sure"), F.col("words"))).over(every), F.lit(0))
    return scaled.select("source", "class", "source_size", "target", "copies", F.when(F.col("sure"), 1.0).otherwise(F.greatest(c * F.col("class"), F.lit(0.0))).alias("p"), rest.alias("rest"))


def _cut(rows: DataFrame, part: str, before: Column) -> DataFrame:
    """(source, cut, before): the range of ``part`` in which a source's words pass ``rest``, and the words before it."""
    by_part = rows.groupBy("source", part).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(before).alias("start"))
    words = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy(part))
    passed = by_part.withColumn("until", words).where(F.col("until") > F.col("rest"))
    return passed.groupBy(F.col("source").alias("s")).agg(F.min(part).alias("cut"), F.min(F.col("until") - F.col("words")).alias("before"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, weight: Callable[[Column], Column] = bits) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often a mix takes each document.

    Targets are shares of all words by source (``source_targets``). A document has as
    many certain copies as its source's target holds that source whole; of what is left
    of the target, documents whose inclusion probability reaches 1 have a copy for
    certain, and the others are sampled: each has a rank, its random odds ``u / (1 - u)``
    divided by its inclusion odds ``p / (1 - p)``, and documents of the lowest ranks
    are taken, equal ranks by doc_id, until their words come nearest to what is owed. The size of a
    sample is fixed in words, as targets are: taken and target differ by half of one
    document at most. ``weight`` gives a whole number from a size; ``p`` is
    proportional to it.

    ``u`` comes from a hash of seed, doc_id and text, so that reruns agree. A source is
    never ordered in one task: its ranks are summed in RANGES ranges and the one range
    where the target falls in RANGES more; only documents in that last one, some
    n / RANGES**2, are put in order. Tables of a row a source are stored, and Spark broadcasts
    them if they are small.

    Null texts have no words, and documents without words the copies of all and 0 taken;
    null sources are one source, null doc_ids documents by themselves; rows repeated in
    all of doc_id, source and text have one rank, and any of them is the next. An empty
    table gives no rows. Other columns are not looked at.
    """
    rows = stored(sized(docs, seed), "sizes").withColumn("class", F.when(F.col("size") > 0, weight(F.col("size"))).otherwise(0))
    classes = stored(rows.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    chances = stored(inclusion(targets, classes, most), "chances").withColumnsRenamed({"source": "s", "class": "c"})
    known = rows.join(chances, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c", "class")
    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    ranked = known.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0), odds))
    # Ranks from 0 to infinity become numbers below 1 and those whole numbers.
    ranked = ranked.withColumn("at", F.floor(F.col("rank") / (F.col("rank") + 1) * float(RANGES * RANGES)).cast("long")).withColumn("high", F.floor(F.col("at") / RANGES))
    open_ = ranked.where(F.col("rank").isNotNull())
    high = stored(_cut(open_, "high", F.lit(0)), "high")
    inside = open_.join(high, F.col("source").eqNullSafe(F.col("s")) & (F.col("high") == F.col("cut")))
    low = stored(_cut(inside.select("source", "at", "size", "rest", "before"), "at", F.col("before")), "low")
    cut = ranked.join(low, F.col("source").eqNullSafe(F.col("s")), "left")
    at_cut = F.coalesce(F.col("at") == F.col("cut"), F.lit(False))
    # A source without a cut takes all that can be sampled.
    under = F.when(F.col("rank").isNull(), F.col("p") >= 1).otherwise(F.coalesce(F.col("at") < F.col("cut"), F.lit(True)))
    in_order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    until = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    few = cut.where(at_cut).withColumn("more", 2 * until + F.col("size") <= 2 * F.col("rest"))
    both = cut.where(~at_cut).withColumn("more", under).unionByName(few)
    copies = F.col("copies") + F.when(F.col("more"), 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
