"""Token ids in wavelet matrices: bit-planes with rank and select, one compressed file for each shard.

Documents are dealt into shards by ranges of their ids, so shards follow one another in ascending order.  Texts are
encoded where they are read, and only token ids are shuffled.  A shard is one Parquet file (zstd) of segments; a
segment holds the ids of whole documents, about ``SEGMENT`` of them, as one wavelet matrix: the distinct ids in
order, and for each bit of an id's number among them a plane of bits, each plane's ids being parted stably by the bit
of the plane before.  Beside each plane stands its rank directory, the ones before each block of 512 bits, so a
token, the number of times an id occurs before a place, and its k-th occurrence take one step a plane and no pass
over a plane.

`access`, `count_before` and `locate` answer from the files: a segment's totals say which segment holds the answer.
Segments bound memory and the work lost with an executor; files are written and read by Spark, so they may lie
in any store that it reaches.

Defined results: a null or empty text is the end id alone; rows with a null id come first; repeated rows are
stored as often as they come, in the order of id and ids; an empty table writes no segment; other columns are
not read; a text of any length is one segment at most; ids may be of any type that orders.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import column, texts_of
from .tokens import encoder
from .workspace import fresh_path, prepared, small_batches

SEGMENT = 1 << 20
END = 0
#: Shard totals of up to so many shards are broadcast; more are joined by shuffle.
BROADCAST_SHARDS = 100_000
_MAGIC = 0x324D5857
#: Bytes of a plane for which one number in its rank directory stands.
_BLOCK = 64
#: Rows of a shard, at least; fewer shards are made of few rows.
SHARD_ROWS = 256


class WaveletMatrix:
    """A sequence of ids that answers access, rank and select from its bit-planes."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.planes, self.ranks = n, alphabet, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        there = np.zeros(int(ids.max()) + 1 if n else 0, bool)
        there[ids] = True
        alphabet = np.flatnonzero(there).astype(np.uint32)
        depth = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        number = np.zeros(len(there), np.uint16 if depth <= 16 else np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        now, planes = number[ids], []
        for k in range(depth - 1, -1, -1):
            bit = (now & (1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            if k:
                now = np.concatenate([now[~bit], now[bit]])
        return cls(n, alphabet, planes, [_directory(p) for p in planes])

    def to_bytes(self) -> bytes:
        head = np.array([_MAGIC, len(self.planes), len(self.alphabet), self.n & 0xFFFFFFFF, self.n >> 32], "<u4")
        return b"".join([head.tobytes(), self.alphabet.astype("<u4").tobytes(), *(p.tobytes() for p in self.planes), *(r.astype("<u4").tobytes() for r in self.ranks)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, depth, letters, low, high = np.frombuffer(raw, "<u4", 5).tolist()
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, at = low | high << 32, 20 + 4 * letters
        width = -(-n // 8)
        marks = -(-width // _BLOCK) + 1
        ranks = at + depth * width
        if len(raw) != ranks + 4 * depth * marks:
            raise ValueError("a wavelet matrix of the wrong length")
        planes = [np.frombuffer(raw, np.uint8, width, at + k * width) for k in range(depth)]
        return cls(n, np.frombuffer(raw, "<u4", letters, 20), planes, [np.frombuffer(raw, "<u4", marks, ranks + 4 * k * marks) for k in range(depth)])

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, the two parts of each plane are merged again."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            if k == 0:
                now = bit.astype(kind)
                continue
            zeros = self.n - int(np.count_nonzero(bit))
            above = np.empty(self.n, kind)
            above[~bit] = now[:zeros]
            above[bit] = now[zeros:] | kind(1 << k)
            now = above
        return self.alphabet[now]

    def _before(self, level: int, i: int) -> int:
        """Ones of a plane before place i: the directory's number, and at most 512 bits counted."""
        byte, rest = divmod(i, 8)
        block = byte // _BLOCK
        plane = self.planes[level]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * _BLOCK : byte]).sum())
        return ones + (int(plane[byte] & ((1 << rest) - 1)).bit_count() if rest else 0)

    def _step(self, level: int, i: int, bit: int) -> int:
        ones = self._before(level, i)
        return self.n - self._before(level, self.n) + ones if bit else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        number = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            number = number * 2 + bit
            i = self._step(level, i, bit)
        return int(self.alphabet[number])

    def _bits(self, token: int) -> list[int] | None:
        k = int(np.searchsorted(self.alphabet, token))
        if k == len(self.alphabet) or self.alphabet[k] != token:
            return None
        return [k >> s & 1 for s in range(len(self.planes) - 1, -1, -1)]

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before place i (all of them without i)."""
        if (bits := self._bits(token)) is None:
            return 0
        lo, hi = 0, self.n if i is None else i
        for level, bit in enumerate(bits):
            lo, hi = self._step(level, lo, bit), self._step(level, hi, bit)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of ``token``."""
        if (bits := self._bits(token)) is None or not 0 <= k < self.rank(token):
            raise IndexError(k)
        lo = 0
        for level, bit in enumerate(bits):
            lo = self._step(level, lo, bit)
        i = lo + k
        for level in range(len(bits) - 1, -1, -1):
            i -= (self.n - self._before(level, self.n)) if bits[level] else 0
            a, b = 0, self.n  # the first place with more than i such bits up to it
            while a < b:
                m = (a + b) // 2
                got = self._before(level, m + 1)
                a, b = (a, m) if (got if bits[level] else m + 1 - got) > i else (m + 1, b)
            i = a
        return i


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and of the whole."""
    ones = np.bitwise_count(plane)
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK), dtype=np.uint32) if len(ones) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)


def _bounds(ids: DataFrame, most: int) -> list:
    """The first ids of all shards but the first: equal ranges of the ids alone, no text is read for them."""
    n = ids.count()
    shards = max(1, min(most, n // SHARD_ROWS))
    if shards == 1:
        return []
    dealt = ids.where("doc_id is not null").repartitionByRange(shards, "doc_id").withColumn("p", F.spark_partition_id())
    return sorted({r["b"] for r in dealt.groupBy("p").agg(F.min("doc_id").alias("b")).collect()})[1:]  # one row a shard


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, segment: int = SEGMENT) -> DataFrame:
    """Segments (shard, at, doc_ids, counts, n_tokens, matrix), shards and ``at`` (ids before, in the shard) ascending."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = prepared(docs, doc_id=id_col, text=text_col)
    key = docs.schema["doc_id"].dataType.simpleString()
    bounds = _bounds(docs.select("doc_id"), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for texts in texts_of(column(batch, "text")):
                names = batch.column(0).slice(texts.first, texts.n)
                flat, n = enc.encode(texts)
                ends = np.cumsum(n)
                ids = [flat[b - c : b].tobytes() for b, c in zip(ends.tolist(), n.tolist(), strict=True)]
                shards = [0 if x is None else bisect_right(bounds, x) for x in names.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), names, pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, shard = encoder(path).type, 0, None
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        last = np.array([end], kind)

        def close() -> pa.RecordBatch:
            nonlocal at, ids, names
            flat, n = np.concatenate([x for own in ids for x in (own, last)]), [len(x) + 1 for x in ids]
            row = [pa.array([shard], pa.int32()), pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(names)), pa.array([n], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([WaveletMatrix.of(flat).to_bytes()], pa.binary())]
            at, ids, names = at + len(flat), [], []
            return pa.RecordBatch.from_arrays(row, names=["shard", "at", "doc_ids", "counts", "n_tokens", "matrix"])

        held = 0
        for batch in batches:
            for k, (s, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                if ids and (s != shard or held >= segment):
                    yield close()
                    held = 0
                if s != shard:
                    shard, at = s, 0
                own = np.frombuffer(raw.as_buffer(), kind)
                ids.append(own)
                names.append(batch.column(1).slice(k, 1))
                held += len(own) + 1
        if ids:
            yield close()

    encoded = docs.mapInArrow(tokens, f"shard int, doc_id {key}, ids binary")
    placed = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return placed.mapInArrow(segments, f"shard int, at long, doc_ids array<{key}>, counts array<long>, n_tokens long, matrix binary")


def write(docs: DataFrame, path: str, to: str, **how) -> None:
    """Writes one compressed file for each shard."""
    encode(docs, path, **how).write.option("compression", "zstd").parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents in files that `write` made: (doc_id, start, n_tokens, ids_crc32), ids being little-endian 32-bit."""
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    near = F.broadcast(shards) if files.select("shard").distinct().count() <= BROADCAST_SHARDS else shards
    key = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[k]  # noqa: B023, E731
                ids = WaveletMatrix.from_bytes(get("matrix").as_buffer()).decode().astype("<u4")
                n = np.array(get("counts").values, np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = get("at").as_py() + get("shard_start").as_py()
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(starts + base), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(near, "shard").select("at", "shard_start", "doc_ids", "counts", "matrix")
    return rows.mapInArrow(run, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, at, n): how often each segment holds an id, counted by rank on its planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [WaveletMatrix.from_bytes(m.as_buffer()).rank(token) for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["shard", "at", "n"])

    return spark.read.parquet(path).select("shard", "at", "matrix").mapInArrow(run, "shard int, at long, n long")


def _asked(segments: DataFrame, answer, what: str) -> DataFrame:
    """(q, answer) of segments (q, x, base, matrix): one question for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x, base = (batch.column(k).to_pylist() for k in range(3))
            got = [answer(WaveletMatrix.from_bytes(m.as_buffer()), i) + b for i, b, m in zip(x, base, batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(got, pa.int64())], names=["q", what])

    return segments.select("q", "x", "base", "matrix").mapInArrow(run, f"q long, {what} long")


def access(spark: SparkSession, path: str, shard: int, places: list[int]) -> DataFrame:
    """(q, token): the token at each of some places of a shard, read from the one segment that holds it."""
    asked = F.broadcast(spark.createDataFrame([(i,) for i in places], "q long"))
    files = spark.read.parquet(path).where(F.col("shard") == shard)
    hit = files.join(asked, (F.col("q") >= F.col("at")) & (F.col("q") < F.col("at") + F.col("n_tokens")))
    return _asked(hit.select("q", (F.col("q") - F.col("at")).alias("x"), F.lit(0).cast("long").alias("base"), "matrix"), lambda m, i: m.access(i), "token")


def count_before(spark: SparkSession, path: str, token: int, shard: int, places: list[int]) -> DataFrame:
    """(q, n): how often an id occurs in a shard before each of some places."""
    asked = F.broadcast(spark.createDataFrame([(i,) for i in places], "q long"))
    files = spark.read.parquet(path).where(F.col("shard") == shard)
    hit = files.join(asked, F.col("q") > F.col("at"))
    parts = _asked(hit.select("q", F.least(F.col("q") - F.col("at"), F.col("n_tokens")).alias("x"), F.lit(0).cast("long").alias("base"), "matrix"), lambda m, i: m.rank(token, i), "n")
    return asked.join(parts.groupBy("q").agg(F.sum("n").alias("n")), "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def locate(spark: SparkSession, path: str, token: int, shard: int, ks: list[int]) -> DataFrame:
    """(q, place): where occurrence q (from 0) of an id stands in a shard; none beyond the last.

    A first pass counts the id in each segment; only segments that hold an asked occurrence are read again.
    """
    asked = F.broadcast(spark.createDataFrame([(k,) for k in ks], "q long"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment of the shard
    counts = occurrences(spark, path, token).where(F.col("shard") == shard).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = counts.join(asked, (F.col("q") >= F.col("before")) & (F.col("q") < F.col("before") + F.col("n")))
    files = spark.read.parquet(path).where(F.col("shard") == shard).select("at", "matrix")
    rows = files.join(hit.select("at", "q", (F.col("q") - F.col("before")).alias("x"), F.col("at").alias("base")), "at")
    return _asked(rows, lambda m, k: m.select(token, k), "place")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, read back from files."""
    to = fresh_path(docs.sparkSession)
    write(docs, path, to)
    return read(docs.sparkSession, to)
