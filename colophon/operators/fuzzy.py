"""A stored dictionary of the words of texts, looked up by distance or by what is left when characters are deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import spelling_alternatives
from ..functions.text import bounded_distance, tokens
from ..scratch import shared_folder, stored
from .search import query_words

#: Most edits of a lookup, and the length of words from which on they are compared one by one: such
#: words have too many deletions, and there are few.
MOST_EDITS, LONG = 2, 32
#: Folders that words and their texts are dealt to.
BUCKETS = 64
#: Asked words up to which they are compared with every word of like length; those of one query are fewer.
FEW_ASKED = 512
#: Edits that a tolerance allows: fixed values.
TOLERANCES = {"strict": 0, "normal": 1, "loose": 2}


def deletions(word: Column, most: int) -> Column:
    """The different texts that deleting up to ``most`` characters leaves, the word itself first."""
    without = lambda w: lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    each = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), without(w))).otherwise(F.array(w))
    found = F.array(word)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, each))))
    return found


class WordDictionary:
    """Words of texts below a folder: ``lengths``, the different words by length, ``words`` with their texts by hash.

    A lookup reads the folders of the lengths and words it asks for. Up to FEW_ASKED words are
    compared with each word of like length. Of more, two words within k edits (a swap of
    neighbours is one) leave a common text when each loses at most k characters, so an equi-join on
    hashes of what is left finds them all; words over LONG characters are still compared one by
    one. The distance itself is computed for the few that are found. Null texts have no words;
    rows without an id are left out.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def write(cls, texts: DataFrame, folder: str | None = None, buckets: int = BUCKETS, id_column: str = "doc_id", text: str = "text") -> WordDictionary:
        """Texts are cut once, into the different words of each; distinct words come from that table."""
        spark = texts.sparkSession
        folder = folder or f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
        rows = texts.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.explode(F.array_distinct(tokens(F.lower(F.col(text))))).alias("word"))
        loose = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")), "loose")
        loose.repartitionByRange("bucket", "word", "doc_id").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{folder}/words")
        words = loose.select("word").distinct().withColumn("length", F.length("word"))
        words.write.partitionBy("length").parquet(f"{folder}/lengths")
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{folder}/meta")
        return cls(spark, folder)

    def near(self, words: DataFrame, most: int, free: bool = False) -> DataFrame:
        """(asked, word, distance): the dictionary's words within ``most`` edits of each asked one.

        By ``free`` a swap stays one edit when characters come or go between the two that it
        exchanges (theai, etai: 2 edits, else 3).
        """
        if not 0 <= most <= MOST_EDITS:
            raise ValueError(f"at most {MOST_EDITS} edits")
        asked = words.select("asked").distinct().withColumn("asked_length", F.length("asked"))
        low, high, n = asked.agg(F.min("asked_length"), F.max("asked_length"), F.count("*")).first()
        if low is None:
            return self.spark.createDataFrame([], "asked string, word string, distance int")
        known = self.spark.read.schema("word string, length int").parquet(f"{self.folder}/lengths").where(F.col("length").between(low - most, high + most))
        # Spark's distance counts a swap twice.
        like = (F.abs(F.col("length") - F.col("asked_length")) <= most) & (F.levenshtein("word", "asked", 2 * most) >= 0)
        if n <= FEW_ASKED:
            pairs = known.join(F.broadcast(asked), like).select("asked", "word")
        else:
            # A word becomes hundreds of rows: as many tasks as there are, however few bytes the words have.
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            left = known.where(F.col("length") <= LONG).repartition(tasks, "word").select("word", "length", F.explode(deletions(F.col("word"), most)).alias("left")).select("word", "length", F.xxhash64("left").alias("hash"))
            probes = asked.where(F.col("asked_length") <= LONG + most).select("asked", "asked_length", F.explode(deletions(F.col("asked"), most)).alias("left")).select("asked", "asked_length", F.xxhash64("left").alias("hash"))
            short = left.join(probes, "hash").where(F.abs(F.col("length") - F.col("asked_length")) <= most).select("asked", "word").distinct()
            spelt = known.where(F.col("length") > LONG).join(asked.where(F.col("asked_length") > LONG - most), like).select("asked", "word")
            pairs = short.unionByName(spelt)
        return pairs.withColumn("distance", bounded_distance(most, free)("asked", "word")).where(F.col("distance") <= most)

    def texts_of(self, words: DataFrame) -> DataFrame:
        """(word, doc_id) of some words, from their folders."""
        buckets = self.spark.read.parquet(f"{self.folder}/meta").first()[0]
        asked = words.select("word").distinct().withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
        some = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        known = self.spark.read.schema("doc_id long, word string, bucket int").parquet(f"{self.folder}/words").where(F.col("bucket").isin(some))
        return known.join(asked.select("word"), "word").select("word", "doc_id")


def soft_hits(dictionary: WordDictionary, query: str, tolerance: str = "normal", free: bool = False) -> DataFrame:
    """(doc_id, rank, alignments): texts that hold every word of a query, as it is or in another spelling.

    A word and each spelling that stands for it (``spelling_alternatives``) may differ from a
    text's word by as many edits as the tolerance allows (``free``: as in ``near``). It scores 1 less the fewest edits over
    the longer length of the two words; the best word of a text counts, of equals the first by
    name. ``rank`` is 1 less the mean score; ``alignments`` says for each query word which
    word it met.
    """
    most = TOLERANCES[tolerance]
    words = sorted(set(query_words(query)))
    spellings = dictionary.spark.createDataFrame([(w, a) for w in words for a in spelling_alternatives(w)], "query_word string, asked string")
    found = dictionary.near(spellings, most, free).join(spellings, "asked").groupBy("query_word", "word").agg(F.min("distance").alias("distance"))
    scored = stored(found.withColumn("score", 1 - F.col("distance") / F.greatest(F.length("query_word"), F.length("word"))), "near")
    met = dictionary.texts_of(scored).join(scored, "word")
    best = met.groupBy("doc_id", "query_word").agg(F.min(F.struct((-F.col("score")).alias("less"), "word")).alias("b"))
    by_text = best.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("query_word", F.col("b.word").alias("word"), F.round(-F.col("b.less"), 6).alias("score")))).alias("alignments"))
    mean = F.aggregate("alignments", F.lit(0.0), lambda s, a: s + a["score"]) / F.col("n")
    return by_text.where(F.col("n") == len(words)).select("doc_id", F.round(1 - mean, 6).alias("rank"), "alignments")
