"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length one, rotated by a fixed random rotation and kept as the signs of its
coordinates, packed in bits, with one correction scalar: the inner product of the vector and its code.
For a query, rotated alike, the inner product with the code divided by that scalar estimates the
cosine, within an error bound that the scalar gives. All vectors whose upper bound reaches the k-th best exact
cosine so far are ranked again on the original vectors, in double precision.

Queries are held in blocks of ``QUERY_BYTES`` and vectors in blocks; every pair of blocks is scanned once, the vectors'
blocks spread over salts so that few query blocks still use all tasks. A task gets a block of queries once, with the
vectors behind it, and keeps the best k of each of its queries only; these are merged. All vectors are indexed,
and nothing is fitted to them. The vectors go with their codes, in their own precision, once for each block of queries: ranking again by a
join with what the codes leave would move more, as in few dimensions the error bound leaves a good part of all pairs (a fifth at 64
dimensions without clusters), and pairs grow with the square of the table.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do null ids; vectors are
compared with those of the same number of components only; a query's own rows (equal id) are no candidates, and of
several rows with its id the smallest vector asks; repeated rows of another id are candidates of their own; ties go to the smaller id; a query with fewer candidates gets
them all, one without any gets no row; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches

#: Bytes of one block's queries, on average, and vectors that are scanned at once.
QUERY_BYTES = 4 << 20
CHUNK = 256
#: Parts that the vectors' blocks are dealt over, for each block of queries.
SALTS = 32
#: Standard deviations of the estimate that the error bound spans.
CONFIDENCE = 3.0
SEED = 20240731


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random rotation of so many dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED + size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each with its code."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def estimate(turned: np.ndarray, codes: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit queries (rows) with coded vectors (columns), and each vector's error bound."""
    size = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    guess = (turned.astype(np.float32) @ signs.T) / (np.sqrt(size) * scalar).astype(np.float32)
    bound = CONFIDENCE * np.sqrt(np.maximum(1 - scalar**2, 0)) / scalar / np.sqrt(max(size - 1, 1)) + 1e-5
    return guess, bound.astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal vectors wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Best:
    """The best k of each query of a block so far, the best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.turned = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)) @ rotation(vectors.shape[1])
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalar: np.ndarray) -> None:
        for at in range(0, len(ids), CHUNK):
            some = slice(at, at + CHUNK)
            self._scan(ids[some], vectors[some].astype(np.float64), codes[some], scalar[some])

    def _scan(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalar: np.ndarray) -> None:
        guess, bound = estimate(self.turned, codes, scalar)
        own = self.ids[:, None] == ids[None, :]
        guess[own] = -np.inf
        first = np.argpartition(-guess, min(self.k, len(ids)) - 1, axis=1)[:, : self.k] if len(ids) > self.k else np.broadcast_to(np.arange(len(ids)), guess.shape)
        who = np.repeat(np.arange(len(self.ids)), first.shape[1])
        some = first.ravel()
        value = cosines(self.vectors[who], vectors[some])
        value[own[who, some]] = -np.inf
        sure = np.sort(np.concatenate([self.score, value.reshape(first.shape)], axis=1), axis=1)[:, -self.k]
        # Rank again whatever may reach the k-th best exact cosine known.
        again = guess + bound >= (sure - 1e-9)[:, None]
        again &= ~own
        who, some = np.nonzero(again)
        for at in range(0, len(who), 1 << 17):
            self._merge(who[at : at + (1 << 17)], some[at : at + (1 << 17)], ids, vectors)

    def _merge(self, who: np.ndarray, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        value = cosines(self.vectors[who], vectors[some])
        rows = np.unique(who)
        all_who = np.concatenate([np.repeat(rows, self.k), who])
        all_value = np.concatenate([self.score[rows].ravel(), value])
        all_ids = np.concatenate([self.found[rows].ravel(), ids[some]])
        order = np.lexsort((all_ids, -all_value, all_who))
        all_who, all_value, all_ids = all_who[order], all_value[order], all_ids[order]
        begin = np.searchsorted(all_who, rows)
        take = begin[:, None] + np.arange(self.k)
        self.score[rows], self.found[rows] = all_value[take], all_ids[take]


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec, size) of the vectors that take part, with components as they are if these are floats, else in double precision."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    read = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast(kind).alias("vec"))
    return read.where(F.col("vec_id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0)).where(finite).where(F.exists(vec, lambda x: x != 0)).withColumn("size", F.size(vec))


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query (a row of ``vectors`` that ``is_query`` holds for) its k nearest other rows: query_id, rank, vec_id, score."""
    bound_batches(vectors.sparkSession)
    usable = _usable(vectors, key, vector)
    kind = usable.schema["vec"].dataType.elementType.simpleString()
    number = np.dtype(np.float32 if kind == "float" else np.float64)
    asked = _usable(vectors.where(is_query), key, vector).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("size", F.size("vec"))
    held = asked.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-held * number.itemsize // QUERY_BYTES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    # Each list holds about QUERY_BYTES, and there are as many lists as that needs.
    lists = asked.groupBy("size", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "vec")).alias("queries"))
    dealt = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.array(batch.column(0)), np.array(batch.column(2))
            flat, ends = np.array(batch.column(1).flatten()), np.cumsum(sizes)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                rows = flat[(ends[mine] - size)[:, None] + np.arange(size)]
                unit = rows.astype(np.float64)
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                codes, scalar = encode(unit)
                made = [x.tobytes() for x in (ids[mine], rows, codes, scalar)]
                salt = int(ids[mine[0]]) * 2654435761 % (1 << 32) * SALTS >> 32
                yield pa.RecordBatch.from_arrays([pa.array([int(size)], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], ["size", "salt", "ids", "rows", "codes", "scalar"])

    packed = usable.select("vec_id", "vec", "size").mapInArrow(pack, "size int, salt int, ids binary, rows binary, codes binary, scalar binary")
    order = ["size", "block", "salt", "vectors"]
    whole = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("vectors", F.lit(True))
    both = dealt.withColumn("vectors", F.lit(False)).unionByName(whole, allowMissingColumns=True).repartition("size", "block", "salt").sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                size, number_of_block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                at = (size, number_of_block)
                if not batch.column(3)[i].as_py():
                    if at not in best:
                        queries = batch.column(4)[i].values
                        vec = np.array(queries.field("vec").flatten(), np.float64).reshape(-1, size)
                        best[at] = Best(np.array(queries.field("vec_id")), vec, k)
                elif at in best:  # else no query has so many components
                    ids, rows, codes, scalar = (batch.column(c)[i].as_py() for c in (5, 6, 7, 8))
                    ids = np.frombuffer(ids, np.int64)
                    best[at].scan(ids, np.frombuffer(rows, number).reshape(len(ids), size), np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(scalar))
        for block in best.values():
            real = np.isfinite(block.score)
            columns = [np.repeat(block.ids, k)[real.ravel()], block.found[real], block.score[real]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.select(*order, "queries", "ids", "rows", "codes", "scalar").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
