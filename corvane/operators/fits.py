"""Closed-form projections: moments from Spark, eigenproblems of size D on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .knn import self_knn, symmetric_edges
from .linalg import covariance, eig_desc, mean, moments, shrink
from .projector import Projector, Step

SHRINK = 0.08


def _zca_matrix(cov, s=SHRINK):
    lam, v = eig_desc(shrink(cov, s))
    return (v / np.sqrt(np.maximum(lam, 1e-6))) @ v.T


def identity(df: DataFrame, r: int = 0, vec: str = "embedding") -> Projector:
    d = len(df.select(F.col(vec)).where(F.col(vec).isNotNull()).head()[0])
    return Projector("base", [Step(np.eye(d))])


def zca(df: DataFrame, r: int = 0, vec: str = "embedding", s: float = SHRINK) -> Projector:
    """Full-dimensional whitening with a shrunk covariance."""
    mu, cov = covariance(df, vec)
    return Projector("zca", [Step(_zca_matrix(cov, s), mu, norm="clamp")])


def pca_white(df: DataFrame, r: int, vec: str = "embedding", s: float = SHRINK, norm: str = "add") -> Projector:
    mu, cov = covariance(df, vec)
    lam, v = eig_desc(shrink(cov, s))
    return Projector("pca", [Step(v[:, :r] / np.sqrt(np.maximum(lam[:r], 1e-12)), mu, norm=norm)])


def soft_exp(df: DataFrame, r: int, vec: str = "embedding", power: float = 0.25, s: float = SHRINK) -> Projector:
    """Whitening by a fractional power of the eigenvalues."""
    mu, cov = covariance(df, vec)
    lam, v = eig_desc(shrink(cov, s))
    return Projector("soft_exp", [Step(v[:, :r] * np.maximum(lam[:r], 1e-6) ** -power, mu)])


def soft_shrink(df: DataFrame, r: int, vec: str = "embedding", a: float = 0.1) -> Projector:
    """Whitening by eigenvalues drawn towards the mean of those kept."""
    mu, cov = covariance(df, vec)
    lam, v = eig_desc(cov)
    lam = lam[:r]
    return Projector("soft_shrink", [Step(v[:, :r] / np.sqrt((1 - a) * lam + a * lam.mean() + 1e-8), mu)])


def zca_topr(df: DataFrame, r: int, vec: str = "embedding") -> Projector:
    """Whitening, then the leading directions of the whitened unit vectors."""
    first = zca(df, vec=vec)
    mu, cov = covariance(first.transform(df.select(vec), vec), vec)
    return Projector("zca_topr", [*first.steps, Step(eig_desc(cov)[1][:, :r], mu)])


def random_matrix(d: int, r: int, seed: int = 42) -> np.ndarray:
    return np.linalg.qr(np.random.RandomState(seed).randn(d, r))[0]


def random_projection(df: DataFrame, r: int, vec: str = "embedding", seed: int = 42, centred: bool = True) -> Projector:
    mu = mean(df, vec)
    return Projector("random", [Step(random_matrix(len(mu), r, seed), mu if centred else None)])


def _graph_moments(df: DataFrame, knn: DataFrame, vec: str, id_col: str, mu=None):
    """X'DX and X'LX of the symmetric neighbour graph, from vectors joined to its edges."""
    edges = staged(symmetric_edges(knn), "edges")  # read twice, and the search behind it is quadratic
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("deg"))
    n, s, xdx = moments(rows.join(degree, F.col("id") == F.col("a")), "v", "deg")
    if mu is not None:
        xdx = xdx - np.outer(s, mu) - np.outer(mu, s) + n * np.outer(mu, mu)
    ends = edges.join(rows.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    xlx = moments(ends.select(F.zip_with("va", "vb", lambda x, y: x - y).alias("v")), "v")[2] / 2
    return xdx, xlx


def lpp(df: DataFrame, r: int, vec: str = "embedding", id_col: str = "vec_id", k: int = 10, mode: str = "generalized") -> Projector:
    """Locality-preserving projection.

    generalized: least solutions of X'LX w = lambda X'DX w on uncentred rows. eigh_of_solve: centred,
    ridged, and the symmetric eigensolver applied to the lower triangle of the (unsymmetric) quotient.
    """
    mu = mean(df, vec)
    if mode == "generalized":
        knn = self_knn(df.select(id_col, F.col(vec)), k, id_col=id_col, vec_col=vec)
        xdx, xlx = _graph_moments(df, knn, vec, id_col)
        lam, v = eig_desc(xdx)
        keep = lam > 1e-10 * lam[0]
        white = v[:, keep] / np.sqrt(lam[keep])
        w = white @ np.linalg.eigh(white.T @ xlx @ white)[1]
        return Projector("lpp", [Step(w[:, :r], mu)])
    centred = Projector("centre", [Step(np.eye(len(mu)), mu)])
    knn = self_knn(centred.transform(df.select(id_col, F.col(vec)), vec), k, id_col=id_col, vec_col=vec)
    xdx, xlx = _graph_moments(df, knn, vec, id_col, mu)
    lam, v = np.linalg.eigh(np.linalg.solve(xdx + 1e-3 * np.eye(len(mu)), xlx))
    return Projector("lpp_eigh_of_solve", [Step(v[:, np.argsort(lam)][:, :r], mu)])


def abtt(df: DataFrame, r: int = 0, vec: str = "embedding", m: int = 5) -> Projector:
    """Without the mean and the m leading directions."""
    mu, cov = covariance(df, vec)
    c = eig_desc(cov)[1][:, :m]
    return Projector("abtt", [Step(np.eye(len(mu)) - c @ c.T, mu, norm="clamp")])


def abtt_pca(df: DataFrame, r: int, vec: str = "embedding", m: int = 5) -> Projector:
    first = abtt(df, vec=vec, m=m)
    mu, cov = covariance(first.transform(df.select(vec), vec), vec)
    return Projector("abtt_pca", [*first.steps, Step(eig_desc(cov)[1][:, :r], mu)])


def condition_number(p: Projector) -> float:
    return float(np.linalg.cond(p.steps[0].w))


FITTERS: dict[str, Callable[..., Projector]] = {
    "base": identity, "zca": zca, "pca": pca_white, "soft_exp": soft_exp, "soft_shrink": soft_shrink,
    "zca_topr": zca_topr, "random": random_projection, "lpp": lpp, "abtt": abtt, "abtt_pca": abtt_pca,
}
