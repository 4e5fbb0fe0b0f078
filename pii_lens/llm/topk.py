"""Exact top-k by inner product with MaxScore.

A query's terms are the dimensions; what a dimension can add to a score is bounded by the query's component and the
range that a block of vectors has there. Every vector has every dimension, so a block's column is the posting list of
its dimension, and traversing postings is adding columns. Scores are taken from the block's least possible score up, so
every contribution is at least zero and at most its bound. Dimensions are ordered by bound. The essential ones are those
without which a vector can't reach the score that is needed; they are summed for all vectors of the block, and only
vectors that the rest can still lift over that score are probed in the other dimensions, in steps, while competitive.

The score that is needed starts from a bounded sample of the vectors, in which executors find each query's k best, and
rises with what a task has found. It is exact: it only ever passes over vectors below k others.

Queries are taken in blocks of a fixed size, each against all vectors in one pass whose result is written, so neither
the driver nor a plan holds more than a block. Shards are merged by query.

Vectors that are null or have a null or non-finite component take no part, nor does a null id. Vectors of another length
than the query's score as if the shorter ended in zeros. Sums are exact whatever their size: where doubles could round,
bounds are loosened by more than that and scores are summed as whole numbers; a score beyond a long is the nearest long.
Repeated rows are candidates each; a query is a distinct pair of id and vector and leaves out all rows of its id. Equal
scores go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import new_path, prepare, written


@dataclass(frozen=True)
class Search:
    k: int = 10
    every: int = 100
    scale: int = 1024
    block: int = 4096
    sample: int = 20_000
    rows: int = 2048
    seed: int = 9


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, in doubles, of the rows that take part."""
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Whole numbers, as doubles, of vectors cut or filled with zeros to a width. A double times a power of two is exact, and so is its floor."""
    flat, offsets = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return np.floor(flat.reshape(len(column), width) * scale) + 0.0  # no negative zero
    out = np.zeros((len(column), width))
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    inside = at < width
    out[np.repeat(np.arange(len(column)), sizes)[inside], at[inside]] = np.floor(flat[inside] * scale) + 0.0
    return out


def _exact(queries: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums in doubles are exact."""
    return float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_score(q: np.ndarray, x: np.ndarray) -> int:
    """The inner product in whole numbers, or the nearest long."""
    return max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(q, x) if a and b)))


def candidates(queries: np.ndarray, x: np.ndarray, need: np.ndarray, exact: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the rows of ``x`` that score at least ``need``, and their scores; if sums are not exact, also some that score less."""
    low, high = x.min(0), x.max(0)
    least = np.minimum(queries * low, queries * high)  # of each query and dimension
    room = np.maximum(queries * low, queries * high) - least
    for i, q in enumerate(queries):
        order = np.argsort(-room[i], kind="stable")
        rest = np.concatenate([np.cumsum(room[i][order][::-1])[::-1], [0.0]])  # what dimensions from here on can add
        target = need[i] - least[i].sum()
        if not exact:  # far more than what sums of so many doubles can be off by
            target -= (np.abs(q) * np.maximum(np.abs(low), np.abs(high))).sum() * (x.shape[1] + 4) * 2.0**-48
        if rest[0] < target:
            continue
        # Non-essential: the longest tail of dimensions that by themselves stay under the target.
        essential = int(np.searchsorted(-rest, -target, side="right")) if np.isfinite(target) else len(order)
        essential = min(max(essential, 1), len(order))
        dims = order[:essential]
        score = x[:, dims] @ q[dims] - least[i][dims].sum()
        alive = np.flatnonzero(score + rest[essential] >= target)
        score = score[alive]
        at = essential
        while at < len(order) and len(alive):
            dims = order[at : at + 8]
            score = score + x[np.ix_(alive, dims)] @ q[dims] - least[i][dims].sum()
            at += len(dims)
            ok = score + rest[at] >= target
            alive, score = alive[ok], score[ok]
        if len(alive):
            yield i, alive, score + least[i].sum()


def _top(best: list[list], ids: np.ndarray, queries: np.ndarray, own: np.ndarray, x: np.ndarray, need: np.ndarray, k: int) -> None:
    """Takes the rows of ``x`` into the heaps, whose least element is the lowest score and, among equals, the largest id."""
    exact = _exact(queries, x)
    for i, rows, scores in candidates(queries, x, need, exact):
        heap = best[i]
        if not exact:
            scores = [whole_score(queries[i], x[r]) for r in rows]
        for r, s in zip(ids[rows].tolist(), scores if not exact else scores.tolist()):
            if r == own[i]:
                continue
            item = (int(s), -r)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if len(heap) == k:
            need[i] = max(need[i], heap[0][0])


FOUND = "query_id long, vec_id long, score long, query long"


def _pass(rows: DataFrame, queries, spec: Search) -> DataFrame:
    """The best of each task's vectors for each query; ``queries`` is a broadcast of own ids, matrix and needed scores."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, first = queries.value
        best, need = [[] for _ in own], first.copy()
        for batch in batches:
            if len(batch):
                _top(best, batch["vec_id"].to_numpy(zero_copy_only=False), q, own, _matrix(batch["x"], q.shape[1], spec.scale), need, spec.k)
        got = [(int(own[i]), -r, s, i) for i, heap in enumerate(best) for s, r in heap]
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(4)], names=["query_id", "vec_id", "score", "query"])

    return rows.mapInArrow(shard, FOUND)


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))


def search(vectors: DataFrame, spec: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of each query."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = taking_part(vectors)
    is_query = F.pmod("vec_id", F.lit(spec.every)) == 0
    n_rows, n_asked, width = rows.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = -(-n_asked // spec.block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = int(min(1.0, spec.sample / n_rows) * (1 << 20))
    drawn = written(rows.where(F.pmod(F.xxhash64("vec_id", F.lit(spec.seed)), F.lit(1 << 20)) < share).repartition(spark.sparkContext.defaultParallelism), "sampled-vectors")  # about spec.sample vectors
    path = new_path(spark, "top-k")
    for b in range(blocks):
        asked = rows.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()  # about spec.block vectors
        ids = asked["vec_id"].to_numpy()
        q = _matrix(asked["x"].combine_chunks(), width, spec.scale) if len(ids) else np.zeros((0, width))
        if len(ids):
            once = _distinct(ids, q)
            ids, q = ids[once], q[once]
        seeds = spark.sparkContext.broadcast((ids, q, np.full(len(ids), -np.inf)))
        need = np.full(len(ids), -np.inf)
        for r in _ranked(_pass(drawn, seeds, spec)).where(F.col("rank") == spec.k).select("query", "score").collect():  # a row a query of the block
            need[r["query"]] = r["score"]
        shared = spark.sparkContext.broadcast((ids, q, need))
        best = _ranked(_pass(rows, shared, spec)).where(F.col("rank") <= spec.k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        seeds.unpersist()
        shared.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def _distinct(ids: np.ndarray, q: np.ndarray) -> list[int]:
    """Places of the distinct pairs of id and vector, by id."""
    first: dict[tuple, int] = {}
    for i, (a, row) in enumerate(zip(ids.tolist(), q)):
        first.setdefault((a, row.tobytes()), i)
    return sorted(first.values(), key=lambda i: ids[i])
