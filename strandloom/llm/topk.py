"""Exact top-k search by multi-resolution segment statistics.

A vector's segments are summed up by their means and deviations, at a few resolutions. For two vectors these bound the squared
distance from below, |q - c|^2 >= sum over segments of n ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), and so the inner product
from above, since both lengths are known. Pairs are looked at coarse first; what a bound can't rule out goes on to the
next resolution, and survivors are scored exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import record_batch, written

SCALE = 1024
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
RESOLUTIONS = (4, 16)
SENT_AT_ONCE = 8192
MOST_FLOAT = float(1 << 53)
LEAST = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it is not null, nor has a component that is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and v: the vector's components as floor(scale * x), x as double. Components must fit a long."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of so many segments of each row, both times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(cuts).astype(float)
    sums, squares = np.add.reduceat(x, cuts[:-1], axis=1), np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = sums / n
    return mean * np.sqrt(n), np.sqrt(np.maximum(squares - mean * mean * n, 0))


def _exact(q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray) -> np.ndarray:
    parts = [(q[at_q[i : i + 32768]] * c[at_c[i : i + 32768]]).sum(1) for i in range(0, len(at_q), 32768)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def survivors(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, candidate places, scores) of the pairs that the bounds can't rule out, and that reach the query's floor.

    floor holds a score that k candidates reach at least. It rises to the kth best exact score among the candidates of the
    highest coarse bounds, before the bounds are held against it.
    """
    dims, n = q.shape[1], len(c)
    fq, fc = q.astype(float), c.astype(float)
    alive = q_ids[:, None] != c_ids[None, :]
    exact_in_float = float(np.abs(fq).max(initial=0)) * float(np.abs(fc).max(initial=0)) * max(1, dims) < MOST_FLOAT
    if dims and exact_in_float:
        slack_q, slack_c = 1e-9 * (np.sqrt((fq * fq).sum(1)) + 1), np.sqrt((fc * fc).sum(1)) + 1
        coarse, *finer = [min(r, dims) for r in RESOLUTIONS]
        (mq, dq), (mc, dc) = _stats(fq, coarse), _stats(fc, coarse)
        bound = np.where(alive, mq @ mc.T + dq @ dc.T + np.outer(slack_q, slack_c), -np.inf)
        if n >= 2 * k:
            seeds = np.argpartition(-bound, 2 * k - 1, axis=1)[:, : 2 * k]
            rows = np.repeat(np.arange(len(q)), 2 * k)
            score = np.where(alive[rows, seeds.ravel()], _exact(q, c, rows, seeds.ravel()), LEAST).reshape(len(q), 2 * k)
            floor = np.maximum(floor, -np.sort(-score, axis=1)[:, k - 1])
        at_q, at_c = np.nonzero(bound >= floor[:, None])
        for segments in finer:  # of the pairs alone that the coarser bound left
            (mq, dq), (mc, dc) = _stats(fq, segments), _stats(fc, segments)
            sums = _exact(np.hstack([mq, dq]), np.hstack([mc, dc]), at_q, at_c) + slack_q[at_q] * slack_c[at_c]
            keep = sums >= floor[at_q]
            at_q, at_c = at_q[keep], at_c[keep]
    else:
        at_q, at_c = np.nonzero(alive)
    score = _exact(q, c, at_q, at_c)
    keep = score >= floor[at_q]
    return at_q[keep], at_c[keep], score[keep]


class Best:
    """The k best (score, id) of each query of a block so far, and thereby the floor that others must reach."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, LEAST)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        last = rank == self.k - 1
        self.floor[at[last]] = scores[last]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of dims, ids and data (whole numbers, row after row): blocks of at most so many vectors of one length."""
    schema = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dims: int) -> Iterator[pa.RecordBatch]:
            parts = waiting.pop(dims)
            ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for i in range(0, len(ids), size):
                yield record_batch({"dims": [dims], "ids": [ids[i : i + size].tobytes()], "data": [rows[i : i + size].tobytes()]}, schema)

        for batch in batches:
            ids = batch.column("id").to_numpy()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                waiting.setdefault(dims, []).append((ids[own], flat[starts[own][:, None] + np.arange(dims)]))
                if sum(len(p[0]) for p in waiting[dims]) >= size:
                    yield from out(dims)
        for dims in list(waiting):
            yield from out(dims)

    return vectors.mapInArrow(run, "dims int, ids binary, data binary")


def _matrix(dims: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, np.int64).reshape(len(own), dims)


def _search(store: DataFrame, blocks: list[tuple[int, bytes, bytes]], k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k best candidates for each query of some blocks."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    sent = store.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(dims, *_matrix(dims, ids, data)) for dims, ids, data in sent.value]
        best = [Best(len(ids), k) for _, ids, _ in asked]
        for batch in batches:
            for dims, ids, data in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "data"))):
                c_ids, c = _matrix(dims, ids, data)
                for (q_dims, q_ids, q), b in zip(asked, best):
                    if q_dims == dims:
                        at_q, at_c, score = survivors(q_ids, q, c_ids, c, k, b.floor)
                        b.add(at_q, c_ids[at_c], score)
        for (_, q_ids, _), b in zip(asked, best):
            yield record_batch({"query_id": q_ids[b.at], "vec_id": b.ids, "score": b.scores}, schema)

    return store.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of scaled vectors, ties to the smaller vec_id.

    Both tables hold vec_id and embedding; other columns are not looked at. Rows with a null id, a null vector or a component
    that is null or not finite take no part; a query is held against vectors of its own length only, and not against rows
    of its own id. Rows that repeat a candidate are candidates each; a query id that repeats is asked once, with the
    least of its vectors. Fewer than k candidates are all returned. Scores that a long can't hold wrap around.

    Blocks of queries, at most SENT_AT_ONCE of them at once, are sent to all tasks, one lot after another; a task
    holds one block of candidates, so its memory doesn't grow with either table.
    """
    asked = scaled(queries, "vec_id", "embedding", scale).groupBy("id").agg(F.min("v").alias("v"))
    blocks = written(_blocks(asked, QUERY_BLOCK), "queries")
    store = written(_blocks(scaled(candidates, "vec_id", "embedding", scale), CANDIDATE_BLOCK), "candidates")
    found, lot, size = [], [], 0
    for row in blocks.toLocalIterator():
        lot.append((row["dims"], bytes(row["ids"]), bytes(row["data"])))
        size += len(row["ids"]) // 8
        if size >= SENT_AT_ONCE:
            found.append(written(_search(store, lot, k), "found"))
            lot, size = [], 0
    if lot or not found:
        found.append(_search(store, lot, k))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_digest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the 10 best of each vec_id divisible by 100; as top_k() says of nulls, repeats and empty tables."""
    return top_k(embeddings.filter(F.col("vec_id") % 100 == 0), embeddings, 10)
