"""Writers of exports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hashtree import hash_tree, root_of


def with_row_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the SHA-256 of each row as JSON with its fields in order of name."""
    return df.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_manifest(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """JSON lines with row hashes, in byte order of the key over all files."""
    with_row_hash(df.select(*columns), columns).orderBy(key).write.mode("errorifexists").json(path)


def paged_text(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, text, pages): the pages of each work as one text, form feeds between, each under its number."""
    rows = F.array_sort(F.collect_list(F.struct(page, text)))
    joined = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("⟦ p."), r[page].cast("string"), F.lit(" ⟧\n"), r[text])), "\f")
    return pages.groupBy(key).agg(rows.alias("rows"), F.count("*").alias("pages")).select(key, joined.alias("text"), "pages")


def write_text_files(pages: DataFrame, path: str, key: str, page: str, text: str) -> None:
    """``paged_text`` as text files, a folder for each work."""
    paged_text(pages, key, page, text).select(key, F.col("text").alias("value")).write.mode("errorifexists").partitionBy(key).text(path)


def write_approved(pages: DataFrame, path: str, key: str, columns: list[str]) -> str | None:
    """Approved pages (approved is true) as JSON lines with row hashes, and the hash that pins them all.

    That is the root of a tree over the rows' hashes in order of the key, which changes
    with any row, its place, and its repetition; null if nothing is approved.
    """
    rows = with_row_hash(pages.where("approved").select(key, *columns), [key, *columns])
    rows.write.mode("errorifexists").json(path)
    return root_of(hash_tree(rows, [key]))


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The newest row of each key from two tables of one schema; ties go to the incoming."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(version.desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def bibtex(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A BibTeX entry; null and empty fields are left out, braces and backslashes escaped."""
    safe = lambda c: F.regexp_replace(c.cast("string"), r"([\\{}])", r"\\$1")
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), safe(c), F.lit("}"))) for name, c in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris(kind: Column, fields: dict[str, Column]) -> Column:
    """An RIS record from two-letter tags; null and empty fields are left out."""
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c.cast("string"))) for tag, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("TY  - "), kind), *lines, F.lit("ER  - "))


def dump(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write whole tables below a folder, none over another, and return their numbers of rows."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {name: df.sparkSession.read.parquet(f"{folder}/{name}").count() for name, df in tables.items()}
