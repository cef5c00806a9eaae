"""Exact top-k inner products with a bit-sliced index.

Components are integers floor(256 * x). The index holds chunks of vectors; in a chunk, every attribute's values,
less the chunk's smallest and without their SHIFT lowest bits, are kept as bitmaps, one for each binary digit. A
query adds |q| times each attribute (its complement, where q is negative) with bitmap arithmetic: each bitmap goes
to the level of its weight and full adders carry three bitmaps of a level into one there and one above. The digits
of all rows' sums come out as slices; the k best sums are selected from the most significant slice downward.
Dropped low bits move a score by a known interval, so every row whose sum is within that interval of the k-th best
is resolved with its exact inner product. No row that could be among the k best is left out.

Queries are packed in blocks, each of which meets every chunk once by an equi-join on a bucket of chunks, and the
best of each chunk are merged by a window with a group limit.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a query meets vectors
of its own length only; rows that share the query's vec_id count as the query's own; repeated query rows are asked
once; null vec_ids take no part; with no candidate a query has no row; scores must fit 64 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import workers, written

SHIFT = 2
SCALE = 256


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Slices:
    """The index of one chunk: exact integers, ids, and bitmaps of the quantised attributes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        self.words = -(-self.n // 64)
        self.low = x.min(axis=0)
        coarse = (x - self.low) >> SHIFT
        self.bits = [int(v).bit_length() for v in coarse.max(axis=0)] if x.shape[1] else []
        self.planes = [np.stack([self._bitmap((coarse[:, d] >> b) & 1) for b in range(n)]) if n else np.zeros((0, self.words), np.uint64) for d, n in enumerate(self.bits)]
        self.all = self._bitmap(np.ones(self.n))

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: self.n] = flags
        return np.packbits(out, bitorder="little").view(np.uint64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """The digits of every row's sum of |q| times attribute, least significant first."""
        levels: list[list[np.ndarray]] = []
        for value, planes in zip(q.tolist(), self.planes, strict=True):
            if value and len(planes):
                use = planes if value > 0 else ~planes
                value = abs(value)
                for a in range(value.bit_length()):
                    if value >> a & 1:
                        while len(levels) < a + len(use):
                            levels.append([])
                        for b in range(len(use)):
                            levels[a + b].append(use[b : b + 1])
        digits, at = [], 0
        while at < len(levels):
            here = np.concatenate(levels[at]) if levels[at] else np.zeros((0, self.words), np.uint64)
            up = []
            while len(here) > 1:
                third = len(here) // 3
                if third:
                    x, y, z = here[:third], here[third : 2 * third], here[2 * third : 3 * third]
                    half = x ^ y
                    up.append((x & y) | (half & z))
                    here = np.concatenate([half ^ z, here[3 * third :]])
                else:
                    up.append(here[:1] & here[1:2])
                    here = here[:1] ^ here[1:2]
            if up and at + 1 == len(levels):
                levels.append([])
            if up:
                levels[at + 1] += up
            digits.append(here[0] if len(here) else np.zeros(self.words, np.uint64))
            at += 1
        return digits

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best rows, ties to the smaller id."""
        here = self.all & ~self._bitmap(self.ids == query_id)
        digits = self.sums(q)
        sure, maybe, least = np.zeros_like(here), here, 0
        count = int(np.bitwise_count(here).sum())
        if count > k:
            for p in range(len(digits) - 1, -1, -1):
                more = sure | (maybe & digits[p])
                n = int(np.bitwise_count(more).sum())
                if n >= k:  # the k-th best has this digit
                    maybe, least = maybe & digits[p], least | 1 << p
                else:
                    sure, maybe = more, maybe & ~digits[p]
            # `least` is the k-th best sum; what the dropped bits can add decides how far below it to look
            slack = ((1 << SHIFT) - 1) * int(np.abs(q).sum())
            here = here & self._at_least(digits, least - -(-slack // (1 << SHIFT)))
        rows = self._rows(here)
        scores = self.x[rows].astype(np.int64) @ q.astype(np.int64)
        ids = self.ids[rows]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def _at_least(self, digits: list[np.ndarray], value: int) -> np.ndarray:
        if value <= 0:
            return self.all
        above, equal = np.zeros_like(self.all), self.all
        for p in range(len(digits) - 1, -1, -1):
            if value >> p & 1:
                equal = equal & digits[p]
            else:
                above, equal = above | (equal & digits[p]), equal & ~digits[p]
        return above | equal


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and integer matrices of a batch, one for each length of vector."""
    ids = np.asarray(batch.column("vec_id").to_pylist(), np.int64)
    column = batch.column("v")
    flat, sizes = np.asarray(column.flatten(), float), np.asarray(column.value_lengths(), np.int64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], np.floor(SCALE * flat[starts[at][:, None] + np.arange(size)]).astype(np.int64)


def _packed(rows: DataFrame, size: int, index: bool) -> DataFrame:
    """Rows of (dim, data): pickled Slices, or pickled (ids, matrix) of queries, of at most `size` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, data = [], []
            for ids, x in _arrays(b):
                for at in range(0, len(ids), size):
                    part = (ids[at : at + size], x[at : at + size])
                    dims.append(x.shape[1])
                    data.append(pickle.dumps(Slices(*part) if index else part, protocol=5))
            yield pa.RecordBatch.from_pydict({"dim": pa.array(dims, pa.int32()), "data": pa.array(data, pa.binary())})

    return rows.mapInArrow(pack, "dim int, data binary")


def build_index(vectors: DataFrame, chunk: int = 8192) -> DataFrame:
    """The bit-sliced index of all valid vectors, written to the shared folder."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return written(_packed(rows, chunk, True))


def search(index: DataFrame, queries: DataFrame, k: int = 5, block: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors of the index, its own id left out."""
    asked = queries.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).dropDuplicates()
    # no more copies of the queries than there are chunks to meet, and never a broadcast: its planned size leaves the copies out
    buckets = max(1, min(workers(index.sparkSession), index.select("dim").count()))
    blocks = _packed(asked, block, False).select("dim", F.col("data").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("g")).hint("merge")
    chunks = index.select("dim", "data", F.pmod(F.xxhash64("data"), F.lit(buckets)).cast("int").alias("g"))
    both = chunks.join(blocks, ["dim", "g"]).select("data", "asked")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slices = None, None
        for b in batches:
            for data, asked in zip(b.column("data"), b.column("asked"), strict=True):
                data = data.as_py()
                if data != held:
                    held, slices = data, pickle.loads(data)
                ids, x = pickle.loads(asked.as_py())
                found = [slices.top(int(i), q, k) for i, q in zip(ids, x, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(ids, [len(f[0]) for f in found]), pa.int64()),
                    "vec_id": pa.array(np.concatenate([f[0] for f in found]), pa.int64()), "score": pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                })

    got = both.mapInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
