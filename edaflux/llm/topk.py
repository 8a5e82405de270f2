"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integers. They are ordered by their nearest pivot and cut into ranges, each a row that holds a forward
index: the vectors in blocks, and for each block every dimension's largest and smallest value. A query's bound on a
block is the sum of the largest terms that its components can make there. A query visits the blocks of a range from the
highest bound down and stops when the next bound is below its k-th score so far; equal bounds are visited, for ties.
What a task has found for a chunk of queries goes on to bound the chunk's next range.

Every chunk of queries meets every range, as blocks: ranges are dealt to slots, and chunks are repeated once for each
slot. A slot gives at most k rows for each query and range it could not prune, and a limited window keeps the best k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.llm.frames import stored

RANGE = 4096
BLOCK = 64
CHUNK = 512
PIVOTS = 64
_LOWEST = -(1 << 63)


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as longs; null if any is null, not finite or outside the longs."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(2**62) / scale))
    return F.when(vector.isNotNull() & good, whole)


def _matrix(rows: list[list[int]], width: int | None = None) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0) if width is None else width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(matrix: np.ndarray) -> bytes:
    small = np.abs(matrix).max(initial=0) < 1 << 15
    return (b"s" if small else b"l") + matrix.astype(np.int16 if small else np.int64).tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[:1] == b"s" else np.int64, offset=1).reshape(rows, -1).astype(np.int64)


def _pack(size: int):
    """Rows (ids, matrix) of at most ``size`` vectors in their order."""

    def run(batches):
        kind = pa.schema([("ids", pa.list_(pa.int64())), ("matrix", pa.binary())])
        ids: list[int] = []
        rows: list[list[int]] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([ids], kind[0].type), pa.array([_packed(_matrix(rows))], pa.binary())], schema=kind)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield out()
                    ids, rows = [], []
        if ids:
            yield out()

    return run


class Best:
    """The best ``k`` candidates so far of each query of a chunk."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.threshold = np.full(len(ids), _LOWEST)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.threshold[query]) & (vec != self.ids[query])
        query, vec, score = (np.concatenate([a, b[keep]]) for a, b in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep = rank < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = rank == self.k - 1
        self.threshold[query[last]] = score[last]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact; beyond the longs they stay at the nearest long."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LOWEST + 1, (1 << 63) - 1).astype(np.int64)


def search_range(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> int:
    """Visit the blocks of a range for a chunk of queries; gives the number of (query, block) pairs scored."""
    width = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bound = _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    ordered = np.take_along_axis(bound, order, 1)
    at, scored, width_ = 0, 0, 1
    while at < len(starts):
        wanted = ordered[:, at : at + width_] >= best.threshold[:, None]
        if not wanted.any():
            break
        query, place = np.nonzero(wanted)
        block = order[query, at + place]
        scored += len(query)
        by = np.argsort(block, kind="stable")
        query, block = query[by], block[by]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        found = []
        for a, z in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
            rows = slice(int(starts[block[a]]), int(starts[block[a]]) + BLOCK)
            score = _products(queries[query[a:z]], vectors[rows])
            good = score >= best.threshold[query[a:z]][:, None]
            q, v = np.nonzero(good)
            found.append((query[a:z][q], ids[rows][v], score[q, v]))
        best.add(*(np.concatenate([f[i] for f in found]) for i in range(3)))
        at += width_
        width_ *= 2
    return scored


def _search(k: int):
    def run(batches):
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        chunk, best, queries = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (best.ids[best.query], best.vec, best.score)], schema=kind)

        for batch in batches:
            for number, q_ids, q_matrix, ids, matrix in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if number != chunk:
                    if best is not None:
                        yield done()
                    chunk, best = number, Best(np.array(q_ids, np.int64), k)
                    queries = _unpacked(q_matrix, len(q_ids))
                search_range(best, queries, np.array(ids, np.int64), _unpacked(matrix, len(ids)))
        if best is not None:
            yield done()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best of all vectors for each query row, itself left out.

    Scores are integer inner products of ``floor(scale * x)``; ties go to the smaller key; where fewer vectors take part,
    all are given. Rows with a null key or vector, or with a null, non-finite or too large component, take no part. The
    shorter of two vectors counts as padded with zeros. Repeated keys are candidates once for each row and are searched
    for once, with the smallest of their vectors. Empty tables give empty results. Pivots are a bounded sample; they
    only order the index, which holds every row.
    """
    usable = stored(vectors.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"), is_query.alias("ask")).where("id IS NOT NULL AND v IS NOT NULL"))
    # An empty table has one pivot without components.
    pivots = [r[0] for r in usable.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()] or [[]]
    points = _matrix(pivots).astype(float)

    def nearest(rows: pa.Array) -> pa.Array:
        x = _matrix([r[: points.shape[1]] for r in rows.to_pylist()], points.shape[1]).astype(float)
        return pa.array((x @ points.T - 0.5 * (points**2).sum(1)).argmax(1).astype(np.int32), pa.int32())

    # As many slots as there are full ranges, and no more than tasks of a shuffle.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(tasks, -(-usable.count() // RANGE)))
    placed = usable.select("id", "v", F.arrow_udf(nearest, "int")("v").alias("near"))
    ordered = placed.repartitionByRange(tasks, "near", "id").sortWithinPartitions("near", "id").select("id", "v")
    ranges = ordered.mapInArrow(_pack(RANGE), "ids array<long>, matrix binary")
    ranges = ranges.withColumn("slot", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(slots)).cast("int"))
    asked = usable.where("ask").groupBy("id").agg(F.min("v").alias("v"))
    chunks = asked.repartition("id").select("id", "v").mapInArrow(_pack(CHUNK), "q_ids array<long>, q_matrix binary")
    chunks = chunks.withColumn("chunk", F.element_at("q_ids", 1))
    spread = chunks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = spread.join(ranges.hint("shuffle_merge"), "slot").select("chunk", "q_ids", "q_matrix", "ids", "matrix")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
