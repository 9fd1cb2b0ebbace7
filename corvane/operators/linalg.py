"""Moments of vector columns, gathered in Spark, and small dense algebra on the driver (D x D)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import matrix


def moments(df: DataFrame, vec: str = "embedding", weight: str | None = None):
    """(n, sum, X'WX) as numpy. Partitions send one partial each, as a row of the matrix a row of the table; rows of one number are added up as they stream by, so a task holds D x D numbers at most, divided by the tasks."""
    cols = [F.col(vec).cast("array<double>").alias("v")] + ([F.col(weight).cast("double").alias("w")] if weight else [])
    names = ["i", "n", "s", "g"]

    def rows(i, n, s, g):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * g.shape[1], pa.int32()), pa.array(g.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(n), pa.array(s), flat], names)

    def partial(batches):
        n, s, g = 0.0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0))
            w = b.column(1).to_numpy() if weight else np.ones(len(x))
            a, c = w @ x, (x * w[:, None]).T @ x
            n += w.sum()
            s, g = (a, c) if s is None else (s + a, g + c)
        if s is not None:
            yield rows(np.arange(len(s)), np.full(len(s), n), s, g)

    def add(batches):
        n, s, g = {}, {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            for i, x, y, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), matrix(b.column(3)), strict=True):
                n[i], s[i] = n.get(i, 0.0) + x, s.get(i, 0.0) + y
                g[i] = g[i] + z if i in g else z
        if g:
            yield rows(np.array(list(g)), np.array(list(n.values())), np.array(list(s.values())), np.stack(list(g.values())))

    schema = "i int, n double, s double, g array<double>"
    parts = df.where(F.col(vec).isNotNull()).select(*cols).mapInArrow(partial, schema)
    got = parts.repartition(F.col("i")).mapInArrow(add, schema).toArrow()  # D rows of D numbers
    if not got.num_rows:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    order = np.argsort(got.column("i").to_numpy())
    return float(got.column("n")[0].as_py()), got.column("s").to_numpy()[order], matrix(got.column("g"))[order]


def central(n: float, s: np.ndarray, g: np.ndarray):
    """(mean, sample covariance) of moments."""
    mu = s / max(n, 1)
    return mu, (g - n * np.outer(mu, mu)) / max(n - 1, 1)


def covariance(df: DataFrame, vec: str = "embedding"):
    """(mean, sample covariance)."""
    return central(*moments(df, vec))


def mean(df: DataFrame, vec: str = "embedding") -> np.ndarray:
    """The mean as numpy."""
    return np.array([r["mean"] for r in mean_vector(df.where(F.col(vec).isNotNull()), vec).orderBy("pos").collect()])  # D rows


def shrink(cov: np.ndarray, s: float = 0.08) -> np.ndarray:
    d = len(cov)
    return (1 - s) * cov + s * np.trace(cov) / d * np.eye(d)


def eig_desc(a: np.ndarray):
    w, v = np.linalg.eigh((a + a.T) / 2)
    return w[::-1], v[:, ::-1]


def mean_vector(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """(pos, mean), one row per component."""
    return df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def covariance_frame(df: DataFrame, vec: str = "embedding", shrinkage: float = 0.0) -> DataFrame:
    """(i, j, cov), one row per cell."""
    _, c = covariance(df, vec)
    c = shrink(c, shrinkage) if shrinkage else c
    d = len(c)
    i, j = np.divmod(np.arange(d * d), max(d, 1))
    cells = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "cov": pa.array(c.ravel())})
    return df.sparkSession.createDataFrame(cells)
