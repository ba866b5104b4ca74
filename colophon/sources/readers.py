"""Readers of catalogue feeds and text archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One line of a corpus feed.
CORPUS_LINE = "collection_lv1 string, document string, dialect string, dialect_lv1 array<string>, author string, recorded_at string, published_at string, uri string, text string, translation string"
#: One harvested academic record.
ACADEMIC_RECORD = "source string, externalId string, doi string, title string, year int, type string, language string, authors array<string>, venue string, url string, pdf string, category string, rawType string"


def json_lines(spark: SparkSession, path: str, schema: str | StructType = CORPUS_LINE) -> DataFrame:
    """JSON lines under a declared schema; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON objects or arrays under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def rename_table(spark: SparkSession, path: str) -> DataFrame:
    """(old_slug, new_slug, title, author, flags, state): a tab-separated rename plan.

    ``state`` is ``skip`` for a blank new slug, ``bad_slug`` for one of another shape,
    ``duplicate`` where a slug, old or new, is named twice, else ``rename``.
    """
    rows = spark.read.option("sep", "\t").option("header", True).schema("old_slug string, new_slug string, title string, author string, flags string").csv(path)
    named = rows.withColumn("new_slug", F.trim(F.coalesce("new_slug", F.lit(""))))
    olds = named.groupBy("old_slug").agg(F.count("*").alias("olds"))
    news = named.where("new_slug <> ''").groupBy("new_slug").agg(F.count("*").alias("news"))
    joined = named.join(olds, "old_slug", "left").join(news, "new_slug", "left")
    state = F.when(F.col("new_slug") == "", "skip").when(~F.col("new_slug").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "bad_slug").when((F.col("olds") > 1) | (F.col("news") > 1), "duplicate").otherwise("rename")
    return joined.select("old_slug", "new_slug", "title", "author", "flags", state.alias("state"))


def paged_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): text files cut at lines ``--- page N ---``; a file without is page 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split(F.regexp_replace("value", r"(?m)^--- page (\d+) ---[ \t]*\r?\n?", "\u0001$1\u0002"), "\u0001")
    page = F.when(F.instr("part", "\u0002") > 0, F.substring_index("part", "\u0002", 1).cast("int")).otherwise(0)
    text = F.when(F.instr("part", "\u0002") > 0, F.substring_index("part", "\u0002", -1)).otherwise(F.col("part"))
    rows = whole.select("path", F.explode(parts).alias("part")).select("path", page.alias("page"), F.trim(text, F.lit("\r\n")).alias("text"))
    return rows.where("page > 0 or trim(text) <> ''")


def text_variants(spark: SparkSession, path: str) -> DataFrame:
    """(scan, variant, path): text files that stand beside a scan and are named after it.

    ``book.pdf`` has the variants ``book.txt`` (empty name) and ``book.<variant>.txt``.
    Only names are read. A text without its scan is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    stem = F.regexp_replace("path", r"\.pdf$", "")
    scans = files.where(F.col("path").endswith(".pdf")).select(F.col("path").alias("scan"), stem.alias("stem"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # A scan's own name may have dots, so every cut of a text's name is tried.
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split(name, r"\."))), lambda i: F.array_join(F.slice(F.split(name, r"\."), F.lit(1), i), "."))
    texts = files.where(F.col("path").endswith(".txt")).withColumn("cut", F.explode(cuts)).withColumn("stem", F.concat(F.regexp_extract("path", r"^(.*/)", 1), F.col("cut")))
    found = scans.join(texts, "stem")
    rest = F.substr(F.regexp_extract("path", r"([^/]*)$", 1), F.length("cut") + 1)
    return found.select("scan", F.regexp_replace(rest, r"^\.|\.?txt$", "").alias("variant"), "path")


def restored(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables that ``sinks.dump`` wrote, by name."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
