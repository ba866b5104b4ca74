"""A Merkle tree over a data set: leaves of rows, a tree a source, a tree of the sources' roots, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_folder, stored

#: Children of a node.
ARITY = 16
#: Fragments of neighbouring ranges that one task merges; the last ones go through treeReduce.
FAN_IN = 64
#: The tree whose leaves are the sources' roots, in the order of the sources.
TOP = -1


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Nodes of trees whose siblings are not all known yet, by tree, level and index.

    ``counts`` has the leaves of each tree, so the arity of every run of siblings is known:
    as soon as a run is whole it becomes its parent, and a tree's root becomes a leaf of
    the tree of roots. ``add`` and ``merge`` may come in any order and grouping; an empty
    forest changes nothing. ``closed`` keeps the runs that were completed here, and
    ``entered`` the nodes that came from elsewhere, from which ``climb`` leads on.
    """

    def __init__(self, n_trees: int):
        self.counts, self.open, self.closed, self.roots, self.entered = {TOP: n_trees}, {}, {}, {}, {}

    def width(self, tree: int, level: int) -> int:
        return -(-self.counts[tree] // ARITY**level)

    def add(self, tree: int, level: int, index: int, node: str) -> None:
        while True:
            width = self.width(tree, level)
            if width == 1:
                self.roots[tree] = node
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            key = (tree, level, index // ARITY)
            run = self.open.setdefault(key, {})
            run[index] = node
            if len(run) < min(ARITY, width - key[2] * ARITY):
                return
            children = self.closed[key] = [run[i] for i in sorted(run)]
            del self.open[key]
            level, index, node = level + 1, key[2], digest(children)

    def enter(self, tree: int, level: int, index: int, node: str, count: int) -> Forest:
        self.counts[tree] = count
        self.entered[tree, level, index] = None
        self.add(tree, level, index, node)
        return self

    def merge(self, other: Forest) -> Forest:
        self.counts |= other.counts
        self.closed |= other.closed
        self.roots |= other.roots
        self.entered |= other.entered
        for (tree, level, _), run in other.open.items():
            for index, node in run.items():
                self.add(tree, level, index, node)
        return self

    def nodes(self) -> Iterator[tuple]:
        """(tree, level, index, digest, leaves of the tree) of what is unresolved; of a whole forest its root."""
        for (tree, level, _), run in self.open.items():
            for index, node in run.items():
                yield tree, level, index, node, self.counts[tree]
        if TOP in self.roots:
            yield TOP, next(k for k in range(64) if self.width(TOP, k) == 1), 0, self.roots[TOP], self.counts[TOP]

    def climb(self, tree: int, level: int, index: int) -> tuple:
        """((left, right) siblings of each step up from a node, its tree's root if it is passed, and where it ends)."""
        path, root = [], None
        while True:
            if self.width(tree, level) == 1:
                if tree == TOP:
                    break
                root = self.roots[tree]
                tree, level, index = TOP, 0, tree
                continue
            run = self.closed.get((tree, level, index // ARITY))
            if run is None:
                break
            at = index % ARITY
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
            level, index = level + 1, index // ARITY
        return path, root, (tree, level, index)


def field(column: str, name: str | None = None) -> Column:
    """A value as a leaf holds it: its bytes' number, ``:`` and itself; ``-`` for null."""
    value = F.col(column).cast("string") if name is None else name
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, changed): each row's digest, and that of its text lower-cased where ``changed`` holds."""
    head = F.concat(*[field(c) for c in ("doc_id", "source", "lang", "n_chars")])
    of = lambda text: F.sha2(F.concat(head, field("", text)), 256)
    other = F.lit(None).cast("string") if changed is None else F.when(changed, of(ascii_lower(F.col("text"))))
    return docs.select(F.col("doc_id").cast("long"), "source", of(F.col("text")).alias("leaf"), other.alias("changed"))


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows in order of source, doc_id and leaf over ranges that stay what they are: checkpointed, each in its task."""
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint().withColumn("part", F.spark_partition_id())


EDGES = "part int, first string, n_first long, last string, n_last long, n_sources long"


def edges(ordered: DataFrame) -> list:
    """For each range with rows: its first and last source, their rows in it, and how many sources it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, n_first, n_last, n = None, None, None, 0, 0, 0
        for batch in batches:
            part = batch.column(1)[0].as_py() if part is None and batch.num_rows else part
            for source, rows in _runs(batch.column(0)):
                if n and source == last:
                    n_last += rows
                else:
                    n, last, n_last = n + 1, source, rows
                if n == 1:
                    first, n_first = source, n_last
        if n:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "n_first": n_first, "last": last, "n_last": n_last, "n_sources": n}], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("n_first", pa.int64()), ("last", pa.string()), ("n_last", pa.int64()), ("n_sources", pa.int64())]))

    return ordered.select("source", "part").mapInArrow(run, EDGES).orderBy("part").collect()


def _runs(column: pa.Array) -> Iterator[tuple]:
    """(value, length) of each run of equal neighbours, null like any other value."""
    ends = pc.run_end_encode(column.cast(pa.string()))
    at = 0
    for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
        yield value, end - at
        at = end


def placed(found: list) -> tuple[dict, int]:
    """({part: (number of its first source, rows of that source before it, rows of it in all, rows of its last source in all)}, sources).

    One step a range: this is what the driver knows of the whole.
    """
    totals, number, places, spans = {}, -1, {}, None
    for e in found:
        goes_on = spans is not None and spans[0] == e["first"]
        number += 0 if goes_on else 1
        before = spans[1] if goes_on else 0
        places[e["part"]] = (number, before)
        totals[number] = before + e["n_first"]
        if e["n_sources"] > 1:
            number += e["n_sources"] - 1
            totals[number] = e["n_last"]
            spans = (e["last"], e["n_last"])
        else:
            spans = (e["first"], before + e["n_first"])
    ends = {e["part"]: places[e["part"]][0] + e["n_sources"] - 1 for e in found}
    return {part: (*place, totals[place[0]], totals[ends[part]]) for part, place in places.items()}, number + 1


STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("leaf", pa.string()), ("changed", pa.string())]))
#: Rows of two kinds: with docs, a run of leaves (or one whose run is not whole here) and its way up; without, an unresolved node.
PIECES = pa.schema([("part", pa.int32()), ("docs", DOC), ("whole", pa.bool_()), ("path", STEP), ("subroot", pa.string()), ("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("count", pa.int64())])
PIECES_SQL = "part int, docs array<struct<doc_id:bigint,leaf:string,changed:string>>, whole boolean, path array<struct<left:string,right:string>>, subroot string, tree long, level int, index long, digest string, count long"


def range_pieces(columns: list[list], runs: list[tuple], part: int, place: tuple, n_trees: int) -> Iterator[dict]:
    """What one range resolves by itself, as rows of PIECES."""
    doc_ids, found, changed = columns
    forest, (tree, before, n_first, n_last), at = Forest(n_trees), place, 0
    steps = lambda path: [{"left": a, "right": b} for a, b in path]
    for k, (_, rows) in enumerate(runs):
        n = n_first if k == 0 else n_last if k == len(runs) - 1 else rows
        forest.counts[tree + k] = n
        for i in range(rows):
            forest.add(tree + k, 0, (before if k == 0 else 0) + i, found[at + i])
        at += rows
    at = 0
    for k, (_, rows) in enumerate(runs):
        start, i = before if k == 0 else 0, 0
        while i < rows:
            index = start + i
            whole = (tree + k, 0, index // ARITY) in forest.closed
            n = len(forest.closed[tree + k, 0, index // ARITY]) if whole else 1
            path, subroot, end = forest.climb(tree + k, 0, index)
            docs = [{"doc_id": doc_ids[j], "leaf": found[j], "changed": changed[j]} for j in range(at + i, at + i + n)]
            yield {"part": part, "docs": docs, "whole": whole, "path": steps(path[1:] if whole else path), "subroot": subroot} | dict(zip(("tree", "level", "index"), end, strict=True))
            i += n
        at += rows
    for node in forest.nodes():
        yield {"part": part} | dict(zip(("tree", "level", "index", "digest", "count"), node, strict=True))


def _in_batches(rows: Iterable[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def pieces(ordered: DataFrame, places: dict, n_trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).combine_chunks()
            part = table.column("part")[0].as_py()
            columns = [table.column(c).to_pylist() for c in ("doc_id", "leaf", "changed")]
            yield from _in_batches(range_pieces(columns, list(_runs(table.column("source").chunk(0))), part, places[part], n_trees), PIECES)

    return ordered.select("part", "source", "doc_id", "leaf", "changed").mapInArrow(run, PIECES_SQL)


def _entered(n_trees: int):
    """Three functions that fold nodes (tree, level, index, digest, count) to a forest."""
    return (lambda node: Forest(n_trees).enter(*node)), (lambda forest, node: forest.enter(*node)), Forest.merge


LINKS = "part int, tree long, level int, index long, path array<struct<left:string,right:string>>, subroot string, to_tree long, to_level int, to_index long, digest string, count long"


def _links(part: int, forest: Forest) -> Iterator[tuple]:
    """Of each node that came in its way to where it ends (path not null), and what is unresolved (path null)."""
    for key in forest.entered:
        path, root, end = forest.climb(*key)
        yield (part, *key, path, root, *end, None, None)
    for tree, level, index, node, count in forest.nodes():
        yield (part, tree, level, index, None, None, None, None, None, node, count)


def resolved(spark: SparkSession, open_: DataFrame, n_parts: int, n_trees: int, fan_in: int = FAN_IN) -> tuple[str, DataFrame]:
    """(root, links): the whole tree's root, and each unresolved node's way up to it.

    Fragments of neighbouring ranges merge first, ``fan_in`` at a time: most of what a range
    leaves open is closed by the next, so a merged fragment is no larger than one before.
    The ways up are written by the tasks that merge. Once at most ``fan_in`` fragments are
    left, treeReduce brings them together; the driver holds what these leave open, some
    hundred nodes a fragment.
    """
    rounds = []
    nodes = open_.select("part", "tree", "level", "index", "digest", "count")
    while n_parts > fan_in:
        n_parts = -(-n_parts // fan_in)
        keyed = nodes.rdd.map(lambda r: (r[0] // fan_in, tuple(r)[1:]))
        merged = keyed.combineByKey(*_entered(n_trees), n_parts).flatMap(lambda x: _links(*x))
        table = stored(spark.createDataFrame(merged, LINKS, verifySchema=False), "merged")
        rounds.append(table.where("path is not null"))
        nodes = table.where("path is null").select("part", "tree", "level", "index", "digest", "count")
    fragments = nodes.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(*_entered(n_trees), n_parts).values()
    whole = fragments.treeReduce(Forest.merge)
    rounds.append(spark.createDataFrame([x for x in _links(0, whole) if x[4] is not None], LINKS))
    links = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("index").alias("i"), F.col("path").alias("more"), F.col("subroot").alias("s"), *[F.col(f"to_{c}").alias(f"u_{c}") for c in ("tree", "level", "index")])
        links = links.join(up, (F.col("to_tree") == F.col("t")) & (F.col("to_level") == F.col("l")) & (F.col("to_index") == F.col("i")), "left").select(
            "tree", "level", "index", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.coalesce("subroot", "s").alias("subroot"), *[F.coalesce(f"u_{c}", f"to_{c}").alias(f"to_{c}") for c in ("tree", "level", "index")]
        )
    return whole.roots[TOP], links.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("index").alias("i"), F.col("path").alias("more"), F.col("subroot").alias("s"))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, changed: Column | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row in the tree, and its proof.

    Rows are dealt to ranges of (source, doc_id, leaf); a range knows from a line a range
    that the driver gathers which leaf of which source it begins with and how many there are, so it resolves
    its own runs of siblings and leaves the others open (``Forest``). Merging fragments gives the root. A row's
    proof is put together from the way up in its range, which sixteen rows share, and the
    way up of the node where that ends; ``folded_root`` is computed from the leaf, or where
    ``changed`` holds from the leaf of the lower-cased text, and all siblings on the way.

    A task holds the digests of its range, some 300 bytes a row. Null values are leaves'
    ``-``; null sources come first, null doc_ids first in their source, and rows of one doc_id in order
    of their leaves. A very long text is a digest after one pass. Empty tables give
    no rows and have no root; other columns are not looked at.
    """
    spark = docs.sparkSession
    ordered = in_ranges(stored(leaves(docs, changed), "leaves"))
    found = edges(ordered)
    if not found:
        return spark.createDataFrame([], RESULT)
    places, n_trees = placed(found)
    table = stored(pieces(ordered, places, n_trees), "pieces")
    root, links = resolved(spark, table.where("docs is null"), max(places) + 1, n_trees, fan_in)
    runs = table.where("docs is not null").join(links, (F.col("tree") == F.col("t")) & (F.col("level") == F.col("l")) & (F.col("index") == F.col("i")), "left")
    rows = runs.select("docs", "whole", F.coalesce("subroot", "s").alias("subroot"), F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.posexplode("docs").alias("at", "doc"))
    text = lambda low, n: F.array_join(F.slice(F.col("docs.leaf"), low, n), "")
    own = F.struct(text(F.lit(1), F.col("at")).alias("left"), text(F.col("at") + 2, F.size("docs") - F.col("at") - 1).alias("right"))
    rows = rows.select("doc.doc_id", "doc.leaf", "doc.changed", "subroot", F.when(F.col("whole"), F.concat(F.array(own), "path")).otherwise(F.col("path")).alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

