"""Exact top-k search over vectors, in blocks.

Both sides are dealt into blocks; every pair of blocks meets in one task, which multiplies the two
matrices and keeps the best k of each query; a ranking over at most k rows per query and block
ends it. Top-k is decomposable, so the result is exact, and no task holds more than two blocks.
Blocks are as large as ``BLOCK_BYTES`` allows, since each side is sent once for every block of the other, but small
enough to keep the cluster's cores busy; a side of one block is all that the other is sent for once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .threads import one_blas_thread

#: Bytes of a block's vectors, rows of the smallest block that is worth a task, and scores that are held at once.
BLOCK_BYTES = 64 << 20
LEAST = 4096
SCORES = 1 << 22


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64, copy=False) if n else np.zeros((0, 0))


def _first_copies(ids, x, keep: int) -> np.ndarray:
    """Places of the rows that have fewer than keep equal rows before them; rows are in id order."""
    side = np.random.default_rng(0).normal(size=(1, x.shape[1]))
    key = _exact(x, side, np.arange(len(x)), np.zeros(len(x), np.int64))  # equal rows have equal keys
    by = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[by[1:]] != key[by[:-1]]]) if len(by) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    if not len(nth) or nth.max() < keep:
        return np.arange(len(x))
    far = np.flatnonzero(nth >= keep)
    # a key that is no proof is one for itself alone: equal to the row keep places before, and that to all between
    run = np.concatenate([[0], np.cumsum(~(x[by[1:]] == x[by[:-1]]).all(axis=1))])
    return np.sort(np.delete(by, far[run[far] == run[far - keep]]))


def _exact(q, c, row, col) -> np.ndarray:
    """Products of pairs of rows, each summed in the same order wherever its rows lie."""
    out = np.empty(len(row))
    step = max(1, (SCORES // 4) // max(q.shape[1], 1))
    for i in range(0, len(row), step):
        out[i : i + step] = (q[row[i : i + step]] * c[col[i : i + step]]).sum(axis=1)
    return out


def best_of(ids_q, q, ids_c, c, k: int, exclude_self: bool):
    """Best k of each query by falling score, then id: arrays (query id, corpus id, score)."""
    row, ids, val = best_rows(ids_q, q, ids_c, c, k, exclude_self)
    return [ids_q[row], ids, val]


def best_rows(ids_q, q, ids_c, c, k: int, exclude_self: bool):
    """As best_of, with the place of the query for its id.

    Single precision finds what can be among the best: all within its rounding of a bound from below, the k-th of the
    maxima of sets of columns. Those alone are scored in double precision.
    """
    fine, whole = (np.isfinite(x).all(axis=1) for x in (c, q))
    if not fine.all():
        ids_c, c = ids_c[fine], c[fine]
    if not whole.all():
        ids_q, q = ids_q[whole], q[whole]
    place = np.flatnonzero(whole)
    if not len(ids_q) or not len(ids_c):
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if (ids_c[1:] < ids_c[:-1]).any():
        order = np.argsort(ids_c, kind="stable")
        ids_c, c = ids_c[order], c[order]
    again = int(np.unique(ids_c, return_counts=True)[1].max())  # rows of one id
    kept = _first_copies(ids_c, c, k + (again if exclude_self else 0))
    if len(kept) < len(c):
        ids_c, c = ids_c[kept], c[kept]
    scale_q, scale_c = np.maximum(q.max(axis=1, keepdims=True), -q.min(axis=1, keepdims=True)), max(c.max(), -c.min())
    # no second copy in double precision
    rough_q, rough_c = (np.divide(x, by, out=np.empty(x.shape, np.float32), casting="same_kind") for x, by in ((q, np.where(scale_q > 0, scale_q, 1)), (c, scale_c or 1)))
    longest = float(np.sqrt((rough_c * rough_c).sum(axis=1).max()))
    slack = (2 * (q.shape[1] + 8) * 2.0**-24 * longest * np.sqrt((rough_q * rough_q).sum(axis=1)) + 1e-30).astype(np.float32)
    low, high = np.searchsorted(ids_c, ids_q), np.searchsorted(ids_c, ids_q, "right")
    sets = max(256, 8 * k)
    wide = max(1, -(-min(len(c), 1 << 14) // sets)) * sets
    step = max(1, min(1024, SCORES // wide))
    out = []
    for i in range(0, len(q), step):
        n = len(q[i : i + step])
        top = np.full((n, sets), -np.inf, np.float32)
        row, col, val = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(c), wide):
            s = rough_q[i : i + step] @ rough_c[j : j + wide].T
            if exclude_self:
                for t in range(again):
                    own = low[i : i + step] + t
                    at = np.flatnonzero((own < high[i : i + step]) & (own >= j) & (own < j + s.shape[1]))
                    s[at, own[at] - j] = -np.inf
            full = s.shape[1] // sets * sets
            if full:
                np.maximum(top, s[:, :full].reshape(n, -1, sets).max(axis=1), out=top)
            if full < s.shape[1]:
                rest = top[:, : s.shape[1] - full]
                np.maximum(rest, s[:, full:], out=rest)
            least = np.partition(top, sets - k, axis=1)[:, sets - k] - slack[i : i + step]
            near = s >= np.maximum(least, np.finfo(np.float32).min)[:, None]
            r, x = np.divmod(np.flatnonzero(near), s.shape[1])
            row, col, val = np.concatenate([row, r]), np.concatenate([col, x + j]), np.concatenate([val, _exact(q[i : i + step], c, r, x + j)])
            by = np.lexsort((col, -val, row))  # columns are in id order
            row, col, val = row[by], col[by], val[by]
            first = np.searchsorted(row, np.arange(n))
            best = (np.arange(len(row)) - first[row] < k) & np.isfinite(val)
            row, col, val = row[best], col[best], val[best]
        out.append((place[i : i + step][row], ids_c[col], val))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def topk_join(queries: DataFrame, corpus: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, block: int | None = None) -> DataFrame:
    """(anchor_id, neighbor_id, rank, sim): the k highest dot products of every query against all of corpus."""
    side = lambda df: df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    q, c = side(queries), side(corpus)
    nq, nc = queries.count(), corpus.count()
    if block is None:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        block = max(LEAST, math.ceil(max(nq, nc) / math.sqrt(2 * cores)))
        if block > LEAST or max(nq, nc) > LEAST:
            one = c.select(F.size("v")).head()
            block = max(1, min(block, BLOCK_BYTES // (8 * max(one[0] if one else 1, 1))))
    bq, bc = (max(1, -(-n // block)) for n in (nq, nc))
    deal = lambda df, n, other, own, far: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    left, right = deal(q, bq, bc, "bq", "bc"), deal(c, bc, bq, "bc", "bq")

    def meet(a, b):
        schema = pa.schema([("anchor_id", pa.int64()), ("neighbor_id", pa.int64()), ("sim", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        one_blas_thread()
        cols = best_of(a.column("id").to_numpy(), matrix(a.column("v")), b.column("id").to_numpy(), matrix(b.column("v")), k, exclude_self)
        return pa.table(cols, schema=schema)

    near = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInArrow(meet, "anchor_id long, neighbor_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("sim"), "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "neighbor_id", "rank", "sim")


def self_knn(df: DataFrame, k: int = 10, **kw) -> DataFrame:
    return topk_join(df, df, k, exclude_self=True, **kw)


def tau_filter(knn: DataFrame, tau: float) -> DataFrame:
    """Neighbours that reach tau, among the first k."""
    return knn.where(F.col("sim") >= tau)


def mined_sets(knn: DataFrame, tau: float, k: int) -> DataFrame:
    """(anchor_id, neighbors): the first k that reach tau, in rank order."""
    kept = tau_filter(knn, tau).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("x"))
    return kept.select("anchor_id", F.slice(F.col("x.neighbor_id"), 1, k).alias("neighbors"))


def symmetric_edges(knn: DataFrame) -> DataFrame:
    """(a, b): the neighbour graph with every edge in both directions, once."""
    e = knn.select(F.col("anchor_id").alias("a"), F.col("neighbor_id").alias("b"))
    return e.union(e.select("b", "a")).distinct()
