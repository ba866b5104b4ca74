"""Token-id shards as wavelet matrices: one file answers access, count and occurrence."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder, stored
from .tokens import encoded_batches

MAGIC = b"WMX1"
#: Bits between two entries of the rank directory.
BLOCK = 512
#: A shard closes at this many ids; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Characters of a text that the ranges of an index are parted by, after doc_id.
OPENING = 64
#: Ids of a shard that are looked up in one row.
ASKED = 1 << 16

_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("body", pa.binary())])
_SHARD_DDL = "part int, shard int, part_start long, n_tokens long, doc_ids array<long>, lengths array<long>, body binary"


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes, most significant first.

    On each plane the ids with a 0 move before those with a 1, both in order, for the
    next plane. A directory of the ones before every BLOCK bits gives rank in constant
    time and select by bisection.
    """

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], directory: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.directory = n, planes, zeros, directory

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, levels = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros, directory = [], [], []
        for level in reversed(range(levels)):
            ones = (ids >> ids.dtype.type(level) & ids.dtype.type(1)).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            planes.append(np.pad(plane, (0, -len(plane) % (BLOCK // 8))))
            counts = np.bitwise_count(planes[-1].view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            directory.append(np.concatenate(([0], np.cumsum(counts))).astype(np.uint32))
            ids = np.concatenate((ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))))
            zeros.append(n - int(directory[-1][-1]))
        return cls(n, planes, zeros, directory)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQI", MAGIC, self.n, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(p.tobytes() + d.astype("<u4").tobytes() for p, d in zip(self.planes, self.directory, strict=True))

    @classmethod
    def from_bytes(cls, body: bytes) -> WaveletMatrix:
        magic, n, levels = struct.unpack_from("<4sQI", body)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize("<4sQI")
        zeros = np.frombuffer(body, "<u8", levels, at).tolist()
        at += 8 * levels
        blocks = -(-n // BLOCK)
        planes, directory = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(body, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
            directory.append(np.frombuffer(body, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, planes, zeros, directory)

    def _ones(self, level: int, i: int) -> int:
        """Ones before bit i of a plane."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        whole = int(np.bitwise_count(part).sum()) if len(part) else 0
        if i % 8 and len(part):
            whole -= (int(part[-1]) >> (i % 8)).bit_count()
        return int(self.directory[level][block]) + whole

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi (rank)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of an id, from 0 (select)."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, i - self.zeros[level] if one else i, one)
        return i

    def _select(self, level: int, k: int, one: int) -> int:
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            lo, hi = (mid + 1, hi) if (ones if one else mid + 1 - ones) <= k else (lo, mid)
        return lo

    def ids(self) -> np.ndarray:
        """All ids in order."""
        value = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~ones)], above[np.flatnonzero(ones)] = value[: self.zeros[level]], value[self.zeros[level] :]
            value = above | ones.astype(value.dtype) << value.dtype.type(len(self.planes) - 1 - level)
        return value


def _shards(tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, start = TaskContext.get().partitionId(), 0, 0

        def closed(doc_ids: list[pa.Array], ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            tokens = tokens.astype(np.uint16) if int(tokens.max()) < 1 << 16 else tokens
            row = [[part], [shard], [start], [len(tokens)], [pa.concat_arrays(doc_ids)], [np.concatenate(sizes)], [WaveletMatrix.build(tokens).to_bytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SHARD, strict=True)], schema=_SHARD)

        held, size = ([], [], []), 0
        for doc_ids, ids, sizes in encoded_batches(batches, tokenizer, end_id):
            ends, low = np.cumsum(sizes), 0
            while low < len(sizes):
                first = int(ends[low - 1]) if low else 0
                # The shard closes with the document that fills it.
                high = min(len(sizes), int(np.searchsorted(ends, first + shard_tokens - size)) + 1)
                for kept, more in zip(held, (doc_ids[low:high], ids[first : int(ends[high - 1])], sizes[low:high]), strict=True):
                    kept.append(more)
                size, low = size + int(ends[high - 1]) - first, high
                if size >= shard_tokens:
                    yield closed(*held)
                    held, shard, start, size = ([], [], []), shard + 1, start + size, 0
        if size:
            yield closed(*held)

    return run


def write_token_index(documents: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write whole texts as token ids, in ascending doc_id order, into shards below ``path``.

    Each row of the written Parquet files is a shard: its documents' ids and lengths
    and its wavelet matrix. Documents are dealt out by ranges of doc_id; a task holds
    one shard at a time. Null texts are empty and get the end id alone; rows of one
    doc_id stand in the order of their texts; null ids come first; an empty table
    writes no shard. Other columns are not read.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # How a text begins orders it as the whole does, and parts the rows of one id, null ones too.
    ordered = ordered.repartitionByRange(parts, "doc_id", F.left("text", F.lit(OPENING))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer, end_id, shard_tokens), _SHARD_DDL).write.option("compression", "zstd").parquet(path)


def read_token_index(spark, path: str) -> DataFrame:
    """The shards of an index: part, shard, part_start, n_tokens, doc_ids, lengths, body."""
    return spark.read.schema(_SHARD_DDL).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            ids, lengths = WaveletMatrix.from_bytes(shard["body"]).ids().astype("<u4"), np.array(shard["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            crcs = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"part": np.full(len(lengths), shard["part"], np.int32), "doc_id": pa.array(shard["doc_ids"], pa.int64()), "start": starts + shard["part_start"], "n_tokens": lengths, "ids_crc32": np.array(crcs, np.int64)})


def _bases(sums: DataFrame) -> DataFrame:
    """(part, base) of (part, n): the sum before each part; one row per task that wrote, on the driver."""
    base, rows = 0, []
    for r in sorted(sums.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        rows.append((r["part"], base))
        base += r["n"]
    return sums.sparkSession.createDataFrame(rows, "part int, base long")


def indexed_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards.

    Where each task's shards begin is the only sum over the whole index: one row per
    task that wrote.
    """
    bounded_batches(spark)
    shards = read_token_index(spark, path)
    bases = _bases(shards.select("part", F.col("n_tokens").alias("n")))
    rows = shards.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(part, shard, occurrences) of a token id, by rank on the bit-planes alone."""

    def run(batches):
        for batch in batches:
            counts = [WaveletMatrix.from_bytes(b.as_py()).count(token) for b in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"part": batch.column(0), "shard": batch.column(1), "occurrences": np.array(counts, np.int64)})

    return shards.select("part", "shard", "body").mapInArrow(run, "part int, shard int, occurrences long")


def tokens_at(spark, path: str, positions: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(position, doc_id, place, token): what stands at each of ``positions`` (position) of the index.

    ``position`` counts ids over the whole index, ``place`` within the document. A
    position finds its shard by an equi-join on steps of ``shard_tokens``; of a shard
    ASKED positions at most go to a task together with its matrix. Positions outside
    the index and null ones give no row; repeated ones one.
    """
    bounded_batches(spark)
    shards = read_token_index(spark, path)
    spans = shards.select("part", "shard", "part_start", "n_tokens")
    spans = spans.join(F.broadcast(_bases(spans.select("part", F.col("n_tokens").alias("n")))), "part").select("part", "shard", (F.col("base") + F.col("part_start")).alias("first"), "n_tokens").where("n_tokens > 0")
    step = lambda at: F.floor(at / F.lit(shard_tokens))
    spans = spans.withColumn("step", F.explode(F.sequence(step(F.col("first")), step(F.col("first") + F.col("n_tokens") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct().withColumn("step", step(F.col("position")))
    met = asked.join(spans, "step").where("position >= first and position < first + n_tokens")
    local = met.select("part", "shard", "first", (F.col("position") - F.col("first")).alias("at"))
    lists = local.groupBy("part", "shard", "first", F.floor(F.col("at") / F.lit(ASKED)).alias("lot")).agg(F.sort_array(F.collect_list("at")).alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, matrix, ends = np.array(row["ats"], np.int64), WaveletMatrix.from_bytes(row["body"]), np.cumsum(row["lengths"])
                doc = np.searchsorted(ends, at, "right")
                place = at - (ends[doc] - np.array(row["lengths"], np.int64)[doc])
                tokens = np.array([matrix.access(i) for i in at.tolist()], np.int64)
                yield pa.RecordBatch.from_pydict({"position": at + row["first"], "doc_id": pa.array([row["doc_ids"][i] for i in doc.tolist()], pa.int64()), "place": place, "token": tokens})

    return lists.join(shards.select("part", "shard", "doc_ids", "lengths", "body"), ["part", "shard"]).select("first", "ats", "doc_ids", "lengths", "body").mapInArrow(run, "position long, doc_id long, place long, token long")


def nth_occurrences(spark, path: str, token: int, ks: list[int]) -> DataFrame:
    """(k, position, doc_id, place): where the k-th occurrences of a token id stand, counted from 0.

    Shards are counted by rank; sums over the parts say which shard holds the k-th, and
    select within that one finds it. A k of no occurrence, or a negative one, gives no
    row. ``ks`` is a stated list, held by the plan.
    """
    bounded_batches(spark)
    shards = read_token_index(spark, path)
    counts = stored(count_token(shards, token), "counts")
    before = F.sum("occurrences").over(Window.partitionBy("part").orderBy("shard")) - F.col("occurrences")
    counted = counts.withColumn("before", before).join(F.broadcast(_bases(counts.select("part", F.col("occurrences").alias("n")))), "part")
    low = F.col("base") + F.col("before")
    wanted = F.filter(F.array(*map(F.lit, sorted(set(ks)))).cast("array<long>"), lambda k: (k >= low) & (k < low + F.col("occurrences")))
    holding = counted.select("part", "shard", low.alias("low"), wanted.alias("ks")).where(F.size("ks") > 0)
    starts = _bases(shards.select("part", F.col("n_tokens").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ks, matrix, ends = np.array(row["ks"], np.int64), WaveletMatrix.from_bytes(row["body"]), np.cumsum(row["lengths"])
                at = np.array([matrix.occurrence(token, k) for k in (ks - row["low"]).tolist()], np.int64)
                doc = np.searchsorted(ends, at, "right")
                place = at - (ends[doc] - np.array(row["lengths"], np.int64)[doc])
                yield pa.RecordBatch.from_pydict({"k": ks, "position": at + row["base"] + row["part_start"], "doc_id": pa.array([row["doc_ids"][i] for i in doc.tolist()], pa.int64()), "place": place})

    found = holding.join(shards.select("part", "shard", "part_start", "doc_ids", "lengths", "body"), ["part", "shard"]).join(F.broadcast(starts), "part")
    return found.select("low", "ks", "base", "part_start", "doc_ids", "lengths", "body").mapInArrow(run, "k long, position long, doc_id long, place long")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write an index to the shared folder and return what it says of every document."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-index-{uuid.uuid4().hex}"
    write_token_index(documents, tokenizer, path, end_id)
    return indexed_documents(spark, path)
