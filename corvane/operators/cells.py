"""Exact top-k search that skips pairs of blocks, over blocks that are written once.

Vectors are dealt to the nearest (by angle) of a bounded number of pivots, drawn by a digest of the id. A cell knows the
widest angle to its pivot and the longest vector. Two cells whose pivots are an angle w apart, with radii u and v, hold no pair
of a smaller angle than w - u - v, so no product above cos(w - u - v) times both greatest lengths. Every block of queries first
meets the corpus cells of best bounds; the least k-th product that its queries then have is what any other cell must be able
to reach, and cells that can't are skipped. What is left is compared, so the result is that of comparing all.

Cells are written once to the shared folder, cut into blocks of at most ``BLOCK_BYTES``, a folder each. A task takes the pairs of
some query blocks with up to ``BLOCK_BYTES`` of the corpus and reads both there, so no vector is sent through a shuffle for every
block that it meets: what is shuffled is each vector once, and k rows for every query and ``BLOCK_BYTES`` of the corpus, however many cells. The store is read by pyarrow, which knows local, HDFS and S3 folders.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import shared_folder, staged
from .knn import BLOCK_BYTES, best_rows, matrix, topk_join
from .threads import one_blas_thread

#: Pivots at most, rows a pivot stands for at least, and cells that a block of queries meets before any is skipped.
PIVOTS = 1024
PER_PIVOT = 256
FIRST = 2
#: Rows of queries at most that a task compares with a block's worth of the corpus.
TOGETHER = 16384
#: Rounding that a bound allows for, in products and in angles.
SLACK, BEND = 1e-9, 1e-7


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest pivot, angle to it, length) of each vector; a zero vector is at an angle of 0."""
    size = np.linalg.norm(x, axis=1)
    cell, cos = np.zeros(len(x), np.int64), np.ones(len(x))
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ pivots.T
        cell[a : a + 4096] = s.argmax(axis=1)
        cos[a : a + 4096] = s.max(axis=1) / np.maximum(size[a : a + 4096], 1e-300)
    return cell, np.where(size > 0, np.arccos(np.clip(cos, -1, 1)), 0.0), size


class Store:
    """Blocks of one table of vectors: rows (id, v) under cell and part, and what bounds each cell."""

    def __init__(self, df: DataFrame, pivots: np.ndarray, id_col: str, vec_col: str, folder: str, rows: int):
        sent = df.sparkSession.sparkContext.broadcast(pivots)

        def run(batches):
            for b in batches:
                cell, angle, size = _angles(matrix(b.column("v")), sent.value) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle), pa.array(size)], ["id", "v", "cell", "angle", "size"])

        kept = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        placed = staged(kept.mapInArrow(run, "id long, v array<double>, cell long, angle double, size double"), "cells")
        own = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a row a pivot
        self.cells = np.array([r["cell"] for r in own], np.int64)
        self.angle, self.size = (np.array([r[c] for r in own], float) for c in ("angle", "size"))
        self.n = np.array([r["n"] for r in own], np.int64)
        self.parts = -(-self.n // rows)
        self.path = f"{folder}/blocks-{uuid.uuid4().hex}"
        many = F.create_map(*[F.lit(x) for r, n in zip(own, self.parts.tolist(), strict=True) for x in (r["cell"], n)]) if own else F.lit(None)
        if own:
            dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), many[F.col("cell")]))
            dealt.select("id", "v", "cell", "part").repartition("cell", "part").write.partitionBy("cell", "part").parquet(self.path)


def _read(path: str, cell: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    where, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    t = ds.dataset(f"{root}/cell={cell}/part={part}", filesystem=where, format="parquet").to_table(columns=["id", "v"])
    return t.column("id").to_numpy(), matrix(t.column("v"))


def _compare(left: str, right: str, k: int, exclude_self: bool):
    """The best k of each query among a unit's pairs of blocks (at, qc, qp, cc, cp): every block is read once, and query blocks that meet the same blocks are compared at once."""

    def run(pairs):
        one_blas_thread()
        met, alike, read, out = {}, {}, {}, []
        for at, qc, qp, *other in zip(*(pairs.column(c).to_pylist() for c in ("at", "qc", "qp", "cc", "cp")), strict=True):
            met.setdefault((at, qc, qp), []).append(tuple(other))
        for q, others in met.items():
            alike.setdefault(tuple(sorted(others)), []).append(q)
        for others, own in alike.items():
            read |= {x: _read(right, *x) for x in others if x not in read}
            ids_c, c = (np.concatenate([read[x][i] for x in others]) for i in (0, 1))
            got = [_read(left, qc, qp) for _, qc, qp in own]
            ids_q, block = np.concatenate([g[0] for g in got]), np.repeat(np.arange(len(own)), [len(g[0]) for g in got])
            row, n, s = best_rows(ids_q, np.concatenate([g[1] for g in got]), ids_c, c, k, exclude_self)
            at, qp = (np.array([x[i] for x in own], np.int32)[block[row]] for i in (0, 2))
            out.append(pa.table([at, qp, ids_q[row], n, s], ["at", "qp", "anchor_id", "neighbor_id", "sim"]))
        return pa.concat_tables(out)

    return run


def _groups(parts: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each cell's first block, group of each block): blocks in order, rows of vectors to a group."""
    size = np.repeat(n / parts, parts)
    return np.cumsum(parts) - parts, ((np.cumsum(size) - size) // rows).astype(np.int64)


def _spread(left: Store, right: Store, cells: np.ndarray, least: bool, rows: tuple[int, int]):
    """Pairs of blocks, of blocks (at, qp, least): a query block with all blocks of the corpus cells marked for its cell or, with least, of those whose bound reaches what its queries have. A unit is so many rows of queries and of the corpus."""
    lc, rc, parts = left.cells, right.cells, right.parts
    (lf, lg), (rf, rg) = _groups(left.parts, left.n, rows[0]), _groups(right.parts, right.n, rows[1])

    def run(batches):
        for b in batches:
            for at, qp, low in zip(*(b.column(c).to_pylist() for c in ("at", "qp", "least")), strict=True):
                met = np.flatnonzero((cells[at] >= low) & np.isfinite(cells[at])) if least else np.flatnonzero(cells[at])
                cc = np.repeat(rc[met], parts[met])
                cp = np.concatenate([np.arange(x) for x in parts[met]]) if len(met) else np.zeros(0, np.int64)
                unit = lg[lf[at] + qp] * (rg[-1] + 1) + rg[np.repeat(rf[met], parts[met]) + cp]
                yield pa.RecordBatch.from_arrays([pa.array(unit)] + [pa.array(np.full(len(cc), x, t)) for x, t in ((at, np.int32), (lc[at], np.int64), (qp, np.int32))] + [pa.array(cc), pa.array(cp)], ["unit", "at", "qc", "qp", "cc", "cp"])

    return run


def cell_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, pivots: int | None = None, block: int | None = None, seen: dict | None = None) -> DataFrame:
    """(anchor_id, neighbor_id, rank, sim) as by ``knn.topk_join``; seen is told the numbers of pairs of blocks in all, and compared."""
    spark = corpus.sparkSession
    folder = shared_folder(spark)
    n = corpus.count()
    p = pivots or max(1, min(PIVOTS, n // PER_PIVOT))
    own = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    drawn = matrix(own.orderBy(F.xxhash64(F.lit("pivots"), "id"), "id").limit(p).toArrow().column("v"))
    if not len(drawn):
        return topk_join(queries, corpus, k, id_col, vec_col, exclude_self)
    drawn = drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300)
    rows = block or max(1, BLOCK_BYTES // (8 * drawn.shape[1]))
    right = Store(corpus, drawn, id_col, vec_col, folder, rows)
    left = right if queries is corpus else Store(queries, drawn, id_col, vec_col, folder, rows)
    if not len(left.cells) or not len(right.cells):
        return topk_join(queries, corpus, k, id_col, vec_col, exclude_self)
    apart = np.arccos(np.clip(drawn[left.cells] @ drawn[right.cells].T, -1, 1)) - left.angle[:, None] - right.angle[None] - BEND
    cos = np.cos(np.clip(apart, 0, math.pi))
    bound = np.maximum(cos, 0) * left.size[:, None] * right.size[None] + SLACK  # beyond a right angle no product is above 0
    nearest = np.zeros(bound.shape, bool)
    np.put_along_axis(nearest, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
    enough = (nearest * right.n).sum(axis=1) > k  # else some query hasn't k others there
    cores = spark.sparkContext.defaultParallelism
    together = max(1, min(TOGETHER, int(left.n.sum()) // (4 * cores))), rows
    begin = spark.createDataFrame([(at, q, 0.0) for at in range(len(left.cells)) for q in range(left.parts[at])], "at int, qp int, least double")  # a row a block
    compare = lambda pairs: pairs.repartition(16 * cores, "unit").groupBy("unit").applyInArrow(_compare(left.path, right.path, k, exclude_self), "at int, qp int, anchor_id long, neighbor_id long, sim double")
    schema = "unit long, at int, qc long, qp int, cc long, cp long"
    first = begin.mapInArrow(_spread(left, right, nearest, False, together), schema)
    begun = staged(compare(first), "cells-first")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("sim"), "neighbor_id"))
    kth = begun.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("at", "qp", "anchor_id").agg(F.when(F.count(F.lit(1)) == k, F.min("sim")).otherwise(-math.inf).alias("least"))
    full = F.create_map(*[F.lit(x) for at, ok in enumerate(enough.tolist()) for x in (at, ok)])
    reach = begin.drop("least").join(kth.groupBy("at", "qp").agg(F.min("least").alias("least")), ["at", "qp"], "left").withColumn("least", F.when(full[F.col("at")], F.coalesce("least", F.lit(-math.inf))).otherwise(-math.inf))
    rest = staged(reach.mapInArrow(_spread(left, right, np.where(nearest, -np.inf, bound), True, together), schema).where("cc is not null"), "cells-rest")
    if seen is not None:
        seen |= {"all": int(left.parts.sum() * right.parts.sum()), "compared": first.count() + rest.count()}
    return begun.unionByName(compare(rest)).withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "neighbor_id", "rank", "sim")


def cell_self_knn(df: DataFrame, k: int = 10, **kw) -> DataFrame:
    return cell_topk(df, df, k, exclude_self=True, **kw)
