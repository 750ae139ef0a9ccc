"""Exact top-k search by vector-approximation files.

Every vector is kept twice: as one small cell number per dimension (the approximation) and exactly.
A search first scans the cells of a block: a cell's edges bound each component, and so bound the inner
product from above (the nearest that the vector can be). Vectors are then read exactly, best bound first, until the
k-th exact score is above every bound that is left.

Queries and candidates are dealt to a grid of (query lane, candidate lane) blocks of bounded size, so no
task holds all of either side; every block returns at most k rows for each of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a dimension in the approximation (4 bits).
CELLS = 16
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: From this size of a component or a sum on, longs and doubles are not exact; Python's integers are used.
LONG, EXACT = 1 << 63, 1 << 52
RESULT = "query_id long, vec_id long, score long"


def integer_vector(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part. Raises beyond the range of a long."""
    usable = embedding.isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )

    def floored(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        beyond = F.raise_error(F.lit("a component of floor(scale * x) is beyond a long")).cast("long")
        return F.when(F.abs(scaled) < F.lit(float(LONG)), F.floor(scaled)).otherwise(beyond)

    return F.when(F.coalesce(usable, F.lit(False)), F.transform(embedding, floored))


def _matrices(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors by vector length; repeated rows once."""
    ids_np = ids.to_numpy()
    lists = vectors.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        own = ids_np[rows]
        matrix = flat[starts[rows][:, None] + np.arange(d)[None, :]].astype(np.int64).reshape(len(rows), d)
        if len(np.unique(own)) < len(own):
            both = np.unique(np.column_stack([own, matrix]), axis=0)
            own, matrix = both[:, 0], both[:, 1:]
        out[int(d)] = own, matrix
    return out


def approximate(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (uint8) of every component, and the cells' last values: values[j, c - 1] < x <= values[j, c]."""
    last = np.empty((matrix.shape[1], CELLS), dtype=np.int64)
    cells = np.empty(matrix.shape, dtype=np.uint8)
    for j, column in enumerate(matrix.T):
        low, high = int(column.min()), int(column.max())
        last[j] = [low + (high - low + 1) * c // CELLS - 1 if c < CELLS else high for c in range(1, CELLS + 1)]
        cells[:, j] = np.searchsorted(last[j], column, side="left")
    return cells, last


def upper_bounds(queries: np.ndarray, cells: np.ndarray, last: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds (float64) of the inner products of queries with the vectors that lie in ``cells``."""
    dims = np.arange(cells.shape[1])[None, :]
    first = np.column_stack([low.astype(np.float64), last[:, :-1].astype(np.float64) + 1])
    q = queries.astype(np.float64)
    bounds = np.maximum(q, 0) @ last.astype(np.float64)[dims, cells].T + np.minimum(q, 0) @ first[dims, cells].T
    # Sums of small integers are exact; what rounding takes from larger ones is far below this slack.
    most = np.abs(q).sum(axis=1, keepdims=True) * max(abs(float(low.min(initial=0))), abs(float(last.max(initial=0))))
    return bounds + np.where(most < EXACT, 0.0, 1e-9 * most)


def search_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int):
    """The k best candidates of a block for each query, exactly; a query never finds its own id."""
    cells, last = approximate(matrix)
    low, d = matrix.min(axis=0), matrix.shape[1]
    peak = max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0)))) * max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0)))) * d
    exact = (lambda rows, q: matrix[rows] @ q) if peak < LONG else (lambda rows, q: matrix[rows].astype(object) @ q.astype(object))
    for start in range(0, len(q_ids), 128):
        upper = upper_bounds(queries[start : start + 128], cells, last, low)
        for i in range(len(upper)):
            q_id, q = q_ids[start + i], queries[start + i]
            bound = np.where(ids == q_id, -np.inf, upper[i])
            allowed = int(np.isfinite(bound).sum())
            read, scores, step = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), max(64, k)
            while len(read) < allowed:
                # The next vectors by bound: a growing head is split off, not the whole block sorted.
                take = min(allowed, len(read) + step)
                order = np.argpartition(-bound, take - 1)[:take] if take < len(bound) else np.arange(len(bound))
                new = order[np.isfinite(bound[order])] if take == allowed else order
                new = new[~np.isin(new, read, assume_unique=True)]
                if len(read) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > bound[new].max(initial=-np.inf):
                    break
                scores = np.concatenate([scores, exact(new, q)])
                read, step = np.concatenate([read, new]), step * 2
            best = sorted(range(len(read)), key=lambda r: (-scores[r], ids[read[r]])) if len(read) <= k else _head(scores, ids[read], k)
            if any(abs(int(scores[r])) >= LONG for r in best):
                raise OverflowError("a score is beyond the range of a long")
            yield np.full(len(best), q_id), ids[read[best]], scores[best].astype(np.int64)


def _head(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id: the rest is split off before ordering."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= least)
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            candidates = _matrices(right["vec_id"], right["v"])
            for d, (q_ids, queries) in _matrices(left["query_id"], left["q"]).items():
                if d in candidates:
                    found += search_block(q_ids, queries, *candidates[d], k)
        found = [f for f in found if len(f[0])]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(schema.names, columns)), schema=schema)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """The k candidates of highest integer inner product for each query, ties to the smaller id.

    Both frames hold (vec_id, embedding); other columns are ignored. Null ids, null vectors and vectors
    that hold a null, NaN or infinity take no part. A repeated row counts once, vectors are compared with
    vectors of their own length, and a query never finds rows of its own id. Components of
    floor(scale * x) and scores beyond the range of a long raise; all within it are exact. An empty side gives an
    empty result.
    Returns (query_id, rank from 1, vec_id, score).
    """
    side = lambda df, name, vector: df.select(
        F.col("vec_id").cast("long").alias(name), integer_vector(F.col("embedding"), scale).alias(vector)
    ).where(F.col(name).isNotNull() & F.col(vector).isNotNull())
    left, right = side(queries, "query_id", "q"), side(candidates, "vec_id", "v")
    q_lanes = max(1, math.ceil(left.count() / QUERY_BLOCK))
    c_lanes = max(1, math.ceil(right.count() / CANDIDATE_BLOCK))
    lane = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("ql", lane("query_id", q_lanes)).withColumn("cl", every(c_lanes))
    right = right.withColumn("cl", lane("vec_id", c_lanes)).withColumn("ql", every(q_lanes))
    found = left.groupBy("ql", "cl").cogroup(right.groupBy("ql", "cl")).applyInArrow(_search(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
