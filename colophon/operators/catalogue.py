"""Listing, faceting, paging and auditing of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored, tasks_for


def except_self_facets(df: DataFrame, dimensions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(dimension, key, cnt): each dimension counted under all selections but its own.

    ``dimensions`` gives for every name its key (a value or an array of values) and
    whether the row fits the selection made in it. One scan and one shuffle serve all
    dimensions: a row is counted once for each dimension that no other one rules out.
    Empty and null keys are dropped; a null selection is no match.
    """
    fits = {name: F.coalesce(match, F.lit(False)) for name, (_, match) in dimensions.items()}
    facets = []
    for name, (key, _) in dimensions.items():
        others = F.lit(True)
        for other, match in fits.items():
            others = others if other == name else others & match
        keys = key if df.select(key.alias("k")).schema["k"].dataType.typeName() == "array" else F.array(key)
        facets.append(F.when(others, _labelled(name, keys)))
    exploded = df.select(F.explode(F.flatten(F.array_compact(F.array(*facets)))).alias("f"))
    return exploded.where("f.key <> ''").groupBy(F.col("f.dimension").alias("dimension"), F.col("f.key").alias("key")).agg(F.count("*").alias("cnt"))


def _labelled(name: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias("dimension"), k.cast("string").alias("key")))


def counted(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def axis_counts(df: DataFrame, axes: dict[str, Column], unspecified: str = "unspecified") -> DataFrame:
    """(axis, bucket, cnt) of several axes in one pass; nulls are ``unspecified``."""
    entries = [F.struct(F.lit(name).alias("axis"), F.coalesce(c.cast("string"), F.lit(unspecified)).alias("bucket")) for name, c in axes.items()]
    return df.select(F.explode(F.array(*entries)).alias("e")).groupBy(F.col("e.axis").alias("axis"), F.col("e.bucket").alias("bucket")).agg(F.count("*").alias("cnt"))


def offset_page(df: DataFrame, order: list[Column], page: int, size: int = 24) -> DataFrame:
    """One page of an ordered listing; size is held within 1 to 100. Order must be total."""
    size = max(1, min(size, 100))
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """The rows after a cursor. ``keys``: columns and whether descending; nulls come last."""
    order = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in keys]
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for (k, down), value in zip(keys, after, strict=True):
            c = F.col(k)
            if value is None:
                beyond, equal = F.lit(False), c.isNull()
            else:
                beyond, equal = c.isNull() | (c < value if down else c > value), c == value
            past, same = past | (same & F.coalesce(beyond, F.lit(False))), same & F.coalesce(equal, F.lit(False))
        df = df.where(past)
    return df.orderBy(*order).limit(size)


def directory(entities: DataFrame, links: DataFrame, entity_key: str, link_key: str, name: str = "cnt") -> DataFrame:
    """Every entity with the number of its links, zero included.

    Links are counted before they are joined, so the join has one row per entity.
    """
    sums = links.groupBy(F.col(link_key).alias(entity_key)).agg(F.count("*").alias(name))
    return entities.join(sums, entity_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def best_of_each(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def same_key_groups(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(dup_key, cnt, first_id, last_id) of keys that several rows share; blank keys do not count."""
    return df.select(key.alias("dup_key"), F.col(id_column).alias("id")).where("dup_key <> ''").groupBy("dup_key").agg(F.count("*").alias("cnt"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("cnt > 1")


def ranked_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rn``, each row's place (from 1) in its group by ``order``, and the group's ``total``.

    Rows are sorted by ranges of group and order, so a group of any size is spread over
    many tasks; a place is the place within a task and the number of the group's rows in
    the tasks before it, of which there is one row for each group and task. Order must
    be total.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    at = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stored(sorted_rows.withColumns({"_p": F.shiftright(at, 33).cast("int"), "_i": at.bitwiseAND((1 << 33) - 1)}), "places")
    sums = placed.groupBy(*group, "_p").agg(F.min("_i").alias("_low"), F.count("*").alias("_n"))
    by_task = Window.partitionBy(*group).orderBy("_p")
    before = sums.select(*group, "_p", (F.sum("_n").over(by_task) - F.col("_n") - F.col("_low")).alias("_base"), F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    return placed.join(before, [*group, "_p"]).withColumn("rn", (F.col("_base") + F.col("_i") + 1).cast("int")).drop("_p", "_i", "_base")


def systematic_sample(df: DataFrame, group: list[str], order: list[str], size: int = 9) -> DataFrame:
    """At most ``size`` rows of each group at even steps of their order."""
    step = F.greatest(F.lit(1), F.floor(F.col("total") / size).cast("int"))
    return ranked_within(df, group, order).where(F.col("rn") % step == 0).where(F.col("rn") / step <= size)


def runs(df: DataFrame, group: list[str], value: str, least: int = 1) -> DataFrame:
    """(group, first, last, length) of runs of consecutive whole numbers.

    Rows are dealt by group once, to as many tasks as there are rows for (``tasks_for``).
    """
    island = F.col(value) - F.row_number().over(Window.partitionBy(*group).orderBy(value))
    rows = df.select(*group, value)
    grouped = rows.repartition(tasks_for(rows), *group).distinct().withColumn("_island", island).groupBy(*group, "_island")
    return grouped.agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_island")


def areas_of_people(orders: DataFrame, lines: DataFrame, parts: DataFrame, person: str) -> DataFrame:
    """(person, area, works): the different orders (o_orderkey, person) of each area (p_partkey, area) of their lines.

    An order's lines meet in one task, so its areas are told apart there and only counted after.
    All is dealt to as many tasks as there are lines for.
    """
    n = tasks_for(lines)
    of_lines = lines.repartition(n, "l_partkey").join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "area")
    met = of_lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    different = met.select("o_orderkey", person, "area").distinct()
    return different.repartition(n, person, "area").groupBy(person, "area").agg(F.count("*").alias("works"))


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed or updated rows between two versions; null-safe."""
    b = before.select(F.col(key).alias("b_key"), F.struct(*fields).alias("b_row"))
    a = after.select(F.col(key).alias("a_key"), F.struct(*fields).alias("a_row"))
    joined = b.join(a, F.col("b_key") == F.col("a_key"), "full")
    change = F.when(F.col("b_key").isNull(), "added").when(F.col("a_key").isNull(), "removed").when(~F.col("b_row").eqNullSafe(F.col("a_row")), "updated")
    return joined.select(F.coalesce("b_key", "a_key").alias(key), change.alias("change")).where("change is not null")


def change_lines(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, op, line): what became of each field of rows in both versions: add, update or clear."""
    text = lambda f, side: F.col(f"{side}.{f}").cast("string")
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), text(f, "b").alias("old"), text(f, "a").alias("new")) for f in fields])
    rows = joined.select(F.col(f"a.{key}").alias(key), F.explode(cells).alias("c")).where(~F.col("c.old").eqNullSafe(F.col("c.new")))
    op = F.when(F.col("c.old").isNull(), "add").when(F.col("c.new").isNull(), "clear").otherwise("update")
    line = F.concat(F.col("c.field"), F.lit(": "), F.coalesce("c.old", F.lit("(none)")), F.lit(" -> "), F.coalesce("c.new", F.lit("(none)")))
    return rows.select(key, F.col("c.field").alias("field"), op.alias("op"), line.alias("line"))


def violations(name: str, rows: DataFrame, id_column: str, most: int = 5) -> DataFrame:
    """(rule, violations, samples): how many rows break a rule, and the ids of the first few."""
    few = rows.select(F.col(id_column).alias("id")).orderBy("id").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    return rows.agg(F.lit(name).alias("rule"), F.count("*").alias("violations")).join(few)


def filled_by_priority(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, fields...): of every field the first value that is not null, by ``order``."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def renamed(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (slug, ...) under their new slugs, and redirects (old_slug, new_slug), by a plan
    (old_slug, new_slug, state) of which only ``rename`` is done."""
    moves = plan.where("state = 'rename'").select(F.col("old_slug").alias("slug"), "new_slug")
    done = rows.join(moves, "slug", "left").withColumn("slug", F.coalesce("new_slug", "slug")).select(*rows.columns)
    return done, rows.select("slug").join(moves, "slug").select(F.col("slug").alias("old_slug"), "new_slug")


def nested_children(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """``parents`` with an array column for each kind of child (key, fields...), empty where there is none.

    Each kind is gathered before it is joined, sorted by its fields.
    """
    for name, df in children.items():
        fields = [c for c in df.columns if c != key]
        gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        kind = gathered.schema[name].dataType.simpleString()
        parents = parents.join(gathered, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return parents
