"""Leading directions without the D x D moments: a randomised range finder with power passes.

A pass multiplies the covariance with D x (r + p) numbers without forming it: every partition turns its vectors X into
X'(X Q) and X'1, and the partials are added up in Spark, so the driver holds a few matrices of D x (r + p) whatever D and
the number of rows. After the passes the covariance restricted to the space found gives values and directions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import matrix
from .projector import Projector, Step

#: Additional directions, and passes over the data, of a search.
EXTRA = 10
PASSES = 4


def _times(df: DataFrame, vec: str, q: np.ndarray, mu: np.ndarray | None):
    """(rows, sum of rows, X'X q): of rows less mu."""
    sent = df.sparkSession.sparkContext.broadcast((q, mu))
    d, r = q.shape

    def run(batches):
        q, mu = sent.value
        n, total, out = 0, np.zeros(d), np.zeros((d, r))
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                x = x if mu is None else x - mu
                n += len(x)
                total += x.sum(axis=0)
                out += x.T @ (x @ q)
        rows = np.concatenate([total[:, None], out], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["i", "n", "v"])

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "i int, n long, v array<double>")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(r + 1)]).alias("v"))
    n, total, out = 0, np.zeros(d), np.zeros((d, r))
    for row in sums.toLocalIterator():
        n, total[row["i"]], out[row["i"]] = row["n"], row["v"][0], row["v"][1:]
    sent.unpersist()
    return n, total, out


def leading(df: DataFrame, r: int, vec: str = "embedding", mu: np.ndarray | None = None, extra: int = EXTRA, passes: int = PASSES, seed: int = 42):
    """(mean, values, directions): the r largest eigenvalues of the covariance and their directions, columns of a D x r matrix. With mu the moments are taken about it."""
    first = df.select(vec).where(F.col(vec).isNotNull()).head()
    d = len(first[0])
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, r + extra))))[0]
    if mu is None:
        n, total, _ = _times(df, vec, np.zeros((d, 1)), None)
        mu = total / n
    for turn in range(passes + 1):
        n, _, y = _times(df, vec, q, mu)
        if turn < passes:
            q = np.linalg.qr(y)[0]
    small = q.T @ y / max(n - 1, 1)
    lam, v = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-lam)[:r]
    return mu, lam[order], q @ v[:, order]


def abtt(df: DataFrame, vec: str = "embedding", m: int = 5, **kw) -> Projector:
    """As ``fits.abtt``, with a step that holds the m directions instead of a D x D matrix."""
    mu, _, c = leading(df, m, vec, **kw)
    return Projector("abtt", [Step(c, mu, norm="clamp", less=True)])


def pca(df: DataFrame, r: int, vec: str = "embedding", shrunk: float = 0.0, total: float | None = None, **kw) -> Projector:
    """PCA whitening at r; with a shrinkage the mean of all eigenvalues (trace over D) is needed, which one more sum gives."""
    mu, lam, v = leading(df, r, vec, **kw)
    if shrunk:
        lam = (1 - shrunk) * lam + shrunk * (variance(df, vec, mu) if total is None else total) / len(mu)
    return Projector("pca", [Step(v / np.sqrt(np.maximum(lam, 1e-12)), mu)])


def variance(df: DataFrame, vec: str, mu: np.ndarray) -> float:
    """The covariance's trace."""
    x = df.select(F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    n, squares = x.agg(F.count(F.lit(1)), F.sum(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).head()
    return (squares - n * float(mu @ mu)) / max(n - 1, 1)
