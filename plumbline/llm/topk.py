"""Exact top-k search by inner product: columnar branch and bound.

Components become the integers floor(256 * x). Queries are packed into blocks of bounded size, and
every candidate batch meets one block after the other. A batch is held dimension by dimension
(vertical layout); scores are accumulated over one block of dimensions at a time, and after each
a pair lives on only if its score so far plus the largest that the remaining dimensions can add
(the product of both sides' remaining masses, by Cauchy and Schwarz) reaches the query's k-th best
score known. Survivors are compacted before the next block. Integers below 2 ** 53 are exact in
doubles, so scores and bounds are exact but for the root in a mass, which is rounded up.

A task keeps k results for each query of a block; these are merged by aggregation. What is
broadcast at once is `ROUND_QUERIES` and `ROUND_BYTES` at most (both are reached at 64 dimensions); more are
searched in further rounds, each one scan of the candidates whose k best of a task are appended to
one written table. The comparisons outweigh the scans: a vector read once meets 131,072 queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.shared import materialize, new_path

K, SCALE, EVERY = 5, 256, 50
SCHEMA = "query_id long, vec_id long, score long"
#: Queries in a pack, candidates in a batch, dimensions accumulated at a time.
PACK, BATCH, DIMS = 1024, 4096, 16
#: Queries and bytes of packed queries that are broadcast at once, at most.
ROUND_QUERIES, ROUND_BYTES = 131_072, 64 << 20


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector; without nulls and non-finite components."""
    column = pc.cast(column, pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        flat = pc.list_flatten(column.take(pa.array(rows)))
        x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), n)  # null components become nan
        good = np.isfinite(x).all(axis=1)
        yield rows[good], np.floor(SCALE * x[good])


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    out = lambda n, ids, x: pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["dims", "n", "ids", "matrix"])
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, x in _vectors(batch.column(1)):
            held.setdefault(x.shape[1], []).append((ids[rows], x))
        for n, kept in held.items():
            if sum(len(i) for i, _ in kept) >= size:
                i, x = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
                full = len(i) // size * size
                for a in range(0, full, size):
                    yield out(n, i[a : a + size], x[a : a + size])
                held[n] = [(i[full:], x[full:])]
    for n, kept in held.items():
        i, x = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        if len(i):
            yield out(n, i, x)


class Best:
    """The k best (score, smaller id first) of each query of a pack so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, matrix, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.rest = _masses(matrix)

    def offer(self, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        """`columns`: the candidates, one dimension in each row; `rest`: their remaining masses."""
        dims = len(columns)
        floor = self.score[:, -1]
        if not dims:
            q, c = np.divmod(np.arange(len(self.ids) * len(ids)), len(ids))
            self._take(q, c, np.zeros(len(q)), ids)
            return
        # the first block for all pairs at once; after it pairs are followed one by one
        part = self.q[:, :DIMS] @ columns[:DIMS]
        q, c = np.nonzero(part + self.rest[1][:, None] * rest[1][None, :] >= floor[:, None])
        part = part[q, c]
        for b, d in enumerate(range(DIMS, dims, DIMS), 2):
            if not len(q):
                return
            if len(q) * 8 > len(self.ids) * len(ids):  # hardly any dropped out: as a whole again
                part = part + (self.q[:, d : d + DIMS] @ columns[d : d + DIMS])[q, c]
            else:
                for j in range(d, min(d + DIMS, dims)):
                    part = part + self.q[q, j] * columns[j, c]
            alive = part + self.rest[b][q] * rest[b][c] >= floor[q]
            q, c, part = q[alive], c[alive], part[alive]
        self._take(q, c, part, ids)

    def _take(self, q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        other = self.ids[q] != ids[c]
        q, score, found = q[other], score[other], ids[c][other]
        touched = np.unique(q)
        if not len(touched):
            return
        q = np.concatenate((q, np.repeat(touched, self.k)))
        score = np.concatenate((score, self.score[touched].ravel()))
        found = np.concatenate((found, self.found[touched].ravel()))
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        same = np.zeros(len(q), bool)  # a vector repeated under one id counts once
        same[1:] = (q[1:] == q[:-1]) & (score[1:] == score[:-1]) & (found[1:] == found[:-1]) & np.isfinite(score[1:])
        q, score, found = q[~same], score[~same], found[~same]
        first = np.searchsorted(q, touched)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.score[q[keep], rank[keep]] = score[keep]
        self.found[q[keep], rank[keep]] = found[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.score))
        return self.ids[q], self.found[q, r], self.score[q, r].astype(np.int64)


def _masses(x: np.ndarray) -> list[np.ndarray]:
    """Euclidean norm of each row's components from block 0, 1, 2 ... of dimensions on; rounded up."""
    return [np.sqrt((x[:, d:] ** 2).sum(axis=1)) * (1 + 1e-12) for d in range(0, x.shape[1] + DIMS, DIMS)]


def _search(batches: Iterator[pa.RecordBatch], packs, k: int) -> Iterator[pa.RecordBatch]:
    best = []
    for dims, n, ids, matrix in packs.value:
        best.append(Best(np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(n, dims), k))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, x in _vectors(batch.column(1)):
            for a in range(0, len(rows), BATCH):
                part = x[a : a + BATCH]
                columns, rest = np.ascontiguousarray(part.T), _masses(part)
                for b in best:
                    if b.q.shape[1] == x.shape[1]:
                        b.offer(ids[rows[a : a + BATCH]], columns, rest)
    for b in best:
        q, found, score = b.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest scores of every query, rank from 1.

    `vectors` has vec_id and embedding. Queries: rows whose vec_id is divisible by `every`;
    candidates: all rows of other ids. Ties go to the smaller vec_id; fewer than k candidates are
    all returned. Vectors that are null or hold a null or non-finite component, and rows of null
    id, take no part; only vectors of one length are compared. A vector repeated under one id
    counts once; a query id repeated with different vectors is searched by each, and keeps the best
    of all. Scores are exact up to 2 ** 53; beyond, they are the nearest doubles, as long as they
    fit a long. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    queries = slim.where(F.col("vec_id") % every == 0)
    packs = materialize(queries.mapInArrow(lambda b: _pack(b, PACK), "dims int, n int, ids binary, matrix binary").withColumn("pack", F.monotonically_increasing_id()), "packs")
    sizes = sorted((r["pack"], r["n"], r["size"]) for r in packs.select("pack", "n", (F.length("ids") + F.length("matrix")).alias("size")).collect())  # three numbers for each 1024 queries
    rounds, queries_held, bytes_held = [], 0, 0
    for pack, n, size in sizes:
        if not rounds or queries_held + n > ROUND_QUERIES or bytes_held + size > ROUND_BYTES:
            rounds.append([])
            queries_held = bytes_held = 0
        rounds[-1].append(pack)
        queries_held += n
        bytes_held += size
    if not rounds:
        return spark.createDataFrame([], SCHEMA.replace("query_id long,", "query_id long, rank int,"))
    best_of = lambda shared: slim.mapInArrow(lambda b: _search(b, shared, k), SCHEMA)
    held = lambda numbers: spark.sparkContext.broadcast([tuple(r) for r in packs.where(F.col("pack").isin(numbers)).select("dims", "n", "ids", "matrix").collect()])
    if len(rounds) == 1:
        found = best_of(held(rounds[0]))
    else:
        path = new_path(spark, "top")
        for numbers in rounds:
            shared = held(numbers)
            best_of(shared).write.mode("append").parquet(path)
            shared.destroy()
        found = spark.read.schema(SCHEMA).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
