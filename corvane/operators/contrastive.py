"""Neighbour-contrastive projection: a D x r matrix fitted by stochastic gradients in numpy.

All rows of the table are fit rows: whitening comes from the moments of all, neighbours are searched among all, and each
step draws its batch among all by a generator of its own, so that what a step needs is known beforehand. Few rows are held
by a task; of more, a task reads those that its batches draw (a number that the protocol bounds). The gradient is analytic. Three protocols keep their own names: ``annealed`` (whitens inside, falling
temperature, frequent retraction, one refinement that goes on with the same optimiser), ``banked``
(whitened input, memory bank and hardest negatives) and ``ablation`` (as banked without both, with
a refinement that starts its optimiser anew).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from . import store
from .fits import _zca_matrix
from .knn import best_of, matrix, self_knn, topk_join
from .linalg import central, moments
from .projector import Projector, Step


@dataclass(frozen=True)
class Protocol:
    k: int
    tau: float
    temperature: float
    temperature_end: float
    batch: int | None
    warmup: int
    hard: int | None
    bank: int
    retract: int
    refine: int
    restart: bool
    penalties: str
    lam_cov: float = 0.05
    lam_orth: float = 0.02
    lr: float = 8e-3
    floor: float = 0.2
    decay: float = 1e-4
    epochs: int = 20
    patience: int = 6
    positives: str = "knn"
    sigma: float = 0.05
    steps: int | None = None


PROTOCOLS = {
    "annealed": Protocol(10, 0.0, 0.12, 0.06, None, 100, 256, 0, 10, 1, False, "mean"),
    "banked": Protocol(40, 0.2, 0.07, 0.07, 256, 200, 32, 4096, 200, 0, False, "offdiag"),
    "ablation": Protocol(40, 0.2, 0.07, 0.07, 256, 200, None, 0, 0, 1, True, "offdiag"),
}
#: What each ablation changes in a protocol.
VARIANTS = {
    "full": {}, "random_pairs": {"positives": "random"}, "noise": {"positives": "noise"}, "no_hardneg": {"hard": None}, "no_qr": {"retract": 0},
    "no_refinement": {"refine": 0}, "no_cov": {"lam_cov": 0.0}, "no_orth": {"lam_orth": 0.0}, "no_both": {"lam_cov": 0.0, "lam_orth": 0.0}, "dropout": {"positives": "same"},
    "bank_no_hardneg": {"bank": 4096}, "hardneg_no_bank": {"hard": 32}, "full_qr": {"bank": 4096, "hard": 32, "retract": 200},
}


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def neighbours(x: np.ndarray, k: int, block: int | None = None):
    """(index, similarity) of each row's k nearest others, the first ones on ties; block rows are searched at once, or all."""
    k = max(1, min(k, len(x) - 1))
    x, rows = x.astype(np.float64, copy=False), np.arange(len(x))
    idx, sim = np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
    for i in range(0, len(x), block or len(x)):
        own, other, value = best_of(rows[i : i + (block or len(x))], x[i : i + (block or len(x))], rows, x, k, True)
        at = own, np.arange(len(own)) - np.searchsorted(own, own)
        idx[at], sim[at] = other, value
    return idx, sim


def _hardest(s: np.ndarray, h: int) -> np.ndarray:
    """Columns of each row's h largest values, in no order: the h-th largest of the maxima of sets of columns bounds the h-th from below, so few values are compared."""
    n, m = s.shape
    if m < 8 * h:
        return np.argpartition(s, m - h, axis=1)[:, m - h :]
    sets = 2 * h
    top = s[:, :sets].copy()
    for a in range(sets, m - sets + 1, sets):  # a set is every so many columns, so that whole rows are compared at once
        np.maximum(top, s[:, a : a + sets], out=top)
    least = np.partition(top, h, axis=1)[:, h]
    row, col = np.divmod(np.flatnonzero(s >= least[:, None]), m)
    first = np.searchsorted(row, np.arange(n + 1))
    wide = np.full((n, int(np.diff(first).max())), -np.inf)
    at = np.arange(len(row)) - first[row]
    wide[row, at] = s[row, col]
    back = np.zeros(wide.shape, np.int64)
    back[row, at] = col
    return np.take_along_axis(back, np.argpartition(-wide, h - 1, axis=1)[:, :h], axis=1)


def _kept(s: np.ndarray, h: int) -> np.ndarray:
    """Marks each row's h largest values, where h is no small part of them, so that gathering them would cost more than leaving the others out."""
    m = s.shape[1]
    kept = s >= np.partition(s, m - h, axis=1)[:, m - h, None]
    for i in np.flatnonzero(np.count_nonzero(kept, axis=1) > h):  # ties
        kept[i] = False
        kept[i, np.argpartition(s[i], m - h)[m - h :]] = True
    return kept


def loss_and_gradient(x, w, temperature, p: Protocol, bank=None):
    """Loss and d loss / d W of a batch whose second half holds the positives of its first."""
    n, r = len(x), w.shape[1]
    y = x @ w
    size = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    z = y / size
    pos = (np.arange(n) + n // 2) % n
    rows = np.arange(n)
    own = (z * z[pos]).sum(axis=1) / temperature
    every = z if bank is None or not len(bank) else np.concatenate([z, bank])
    few = p.hard and p.hard < len(every) - 1  # not all others count
    if few and 8 * p.hard <= len(every):
        # single precision is enough to find the hardest negatives; all that follows is n x hard, on exact values
        rough = z.astype(np.float32, copy=False) @ every.T.astype(np.float32, copy=False)
        rough[rows, rows] = rough[rows, pos] = -np.inf
        col = _hardest(rough, p.hard)
        hard = every[col]
        s = np.matmul(hard, z[:, :, None])[:, :, 0] / temperature
        s[(col == rows[:, None]) | (col == pos[:, None])] = -np.inf
    else:
        col = None
        s = z @ every.T
        s /= temperature
        s[rows, rows] = s[rows, pos] = -np.inf
        kept = _kept(s, p.hard) if few else None
    top = x.dtype.type(1 / temperature)  # no cosine is above 1
    s -= top
    g = np.exp(s, out=s)
    if col is None and kept is not None:
        g *= kept
    total = g.sum(axis=1) + np.exp(own - top)
    loss = float(np.mean(top + np.log(total) - own))
    g *= (1 / (n * total))[:, None]
    if col is None:
        inner, outer = g[:, :n], g[:, n:]
        dz = outer @ bank / temperature if outer.shape[1] else 0.0
    else:
        near = col < n
        inner = np.zeros((n, n), x.dtype)
        inner[np.nonzero(near)[0], col[near]] = g[near]
        dz = np.matmul(np.where(near, x.dtype.type(0), g)[:, None], hard)[:, 0] / temperature
    inner[rows, pos] = (np.exp(own - top) / total - 1) / n
    dz = dz + (inner @ z + inner.T @ z) / temperature
    zc = z - z.mean(axis=0)
    cov = zc.T @ zc / max(n - 1, 1)
    eye = np.eye(r)
    if p.penalties == "mean":
        off = cov - eye
        loss += p.lam_cov * np.mean(off * off)
        dz += p.lam_cov * 4 / (r * r * max(n - 1, 1)) * zc @ off
        gap = w.T @ w - eye
        loss += p.lam_orth * np.mean(gap * gap)
        dw = p.lam_orth * 4 / (r * r) * w @ gap
    else:
        off = cov - np.diag(np.diag(cov))
        loss += p.lam_cov * np.sum(off * off) / r
        dz += p.lam_cov * 4 / (r * max(n - 1, 1)) * zc @ off
        length = np.maximum(np.linalg.norm(w, axis=0), 1e-12)
        wn = w / length
        gap = wn.T @ wn - eye
        loss += p.lam_orth * np.mean(gap * gap)
        d = p.lam_orth * 4 / (r * r) * wn @ gap
        dw = (d - wn * (wn * d).sum(axis=0)) / length
    dy = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / size
    return loss, dw + x.T @ dy, z


class Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, w, g, lr, decay):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return w * (1 - lr * decay) - lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


#: Bytes of drawn rows that are read at once.
DRAWN_BYTES = 64 << 20


class Held:
    """Rows in memory, with (index, similarity) of the nearest others of each."""

    def __init__(self, x: np.ndarray, found=None):
        self.x, self.found, self.shape = x, found, x.shape

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.x[at]

    def near(self, at: np.ndarray, k: int):
        return tuple(v[at, :k] for v in self.found)


class Stored:
    """Rows of a store, and a store of their nearest others: indices, then similarities."""

    def __init__(self, rows, n: int, near=None):
        self.rows, self.found, self.shape = rows.read, near, (n, rows.width)

    def near(self, at: np.ndarray, k: int):
        both = self.found.read(at)
        most = both.shape[1] // 2
        return both[:, : min(k, most)].astype(np.int64), both[:, most : most + min(k, most)]


def schedule(p: Protocol, n: int) -> tuple[int, int]:
    """(rows of a batch, steps of an epoch) for n rows."""
    batch = p.batch or max(64, min(1024, n // 64))
    return batch, p.steps or min(160, max(100, math.ceil(n / (2 * batch))))


def draw(p: Protocol, n: int, d: int, seed: int, turn: int, t: int):
    """(rows of the batch of step t of a turn among all n, what finds their positives), whatever was drawn before."""
    rng, batch = np.random.default_rng((seed, turn, t)), schedule(p, n)[0]
    a = rng.integers(0, n, batch)
    if p.positives == "noise":
        return a, rng.normal(size=(batch, d)).astype(np.float32)
    return a, rng.integers(0, n, batch) if p.positives == "random" else rng.random(batch)


def batches(data, p: Protocol, seed: int, turn: int, first: int, last: int):
    """(rows, their positives) of steps first to last; as many steps as ``DRAWN_BYTES`` hold are read at once."""
    n, d = data.shape
    batch = schedule(p, n)[0]
    step = max(1, DRAWN_BYTES // (8 * d * batch))
    for i in range(first, last, step):
        drawn = [draw(p, n, d, seed, turn, t) for t in range(i, min(i + step, last))]
        a, by = (np.concatenate(x) for x in zip(*drawn, strict=True))
        xa = data.rows(a)
        if p.positives == "noise":
            other = unit(xa + p.sigma * by)
        elif p.positives == "same":
            other = xa
        elif p.positives == "random":
            other = data.rows(by)
        else:
            idx, sim = data.near(a, p.k)
            ok = np.count_nonzero(sim >= p.tau, axis=1)  # the first ones, as similarities fall
            ok[ok == 0] = idx.shape[1]
            other = data.rows(idx[np.arange(len(a)), (by * ok).astype(np.int64)])
        for j in range(0, len(a), batch):
            yield xa[j : j + batch], other[j : j + batch]


@dataclass
class State:
    """What a fit carries from turn to turn."""

    w: np.ndarray
    best: np.ndarray
    adam: Adam
    bank: np.ndarray
    best_loss: float = math.inf
    least: float = math.inf  # of this round, where rounds are counted by themselves
    since: int = 0
    at: int = 0


def begin(d: int, rank: int, seed: int) -> State:
    r = min(rank, d)
    w = (np.random.default_rng(seed).normal(size=(d, r)) / math.sqrt(d)).astype(np.float32)
    return State(w, w, Adam(w.shape), np.zeros((0, r), np.float32))


def train_turn(data, p: Protocol, seed: int, turn: int, s: State) -> State:
    """One turn of a fit over batches drawn among all rows of data; later turns go on from the best of those before."""
    steps = schedule(p, data.shape[0])[1]
    span = p.epochs * steps
    if turn:
        s.w = s.best
        if p.restart:
            s.adam, s.bank, s.at, s.since, s.least = Adam(s.w.shape), s.bank[:0], 0, 0, math.inf
    for epoch in range(p.epochs):
        total = 0.0
        for x, other in batches(data, p, seed, turn, epoch * steps, (epoch + 1) * steps):
            t = max(0.0, s.at - p.warmup) / max(1, span - p.warmup)
            low = p.floor * p.lr
            lr = low + (p.lr - low) * s.at / max(1, p.warmup) if s.at < p.warmup else low + 0.5 * (p.lr - low) * (1 + math.cos(math.pi * t))
            temp = p.temperature_end + 0.5 * (p.temperature - p.temperature_end) * (1 + math.cos(math.pi * s.at / max(1, span - 1)))
            loss, g, z = loss_and_gradient(np.concatenate([x, other]), s.w, temp, p, s.bank if p.bank else None)
            s.w = s.adam.step(s.w, g, lr, p.decay)
            if p.bank:
                s.bank = np.concatenate([s.bank, z])[-p.bank :]
            s.at += 1
            if p.retract and s.at % p.retract == 0:
                s.w = np.linalg.qr(s.w)[0]
            total += loss
        if total / steps + 1e-6 < s.least:
            s.least, s.since = total / steps, 0
            if s.least < s.best_loss:
                s.best, s.best_loss = s.w.copy(), s.least
        else:
            s.since += 1
            if s.since >= p.patience:
                break
    return s


def train(xw: np.ndarray, rank: int, p: Protocol, seed: int = 42, search=neighbours, first=None) -> np.ndarray:
    """W for whitened unit rows, in single precision; search finds the nearest others of each row, first has those of the rows as they are."""
    xw = xw.astype(np.float32, copy=False)
    s = begin(xw.shape[1], rank, seed)
    for turn in range(p.refine + 1):
        found = None
        if p.positives == "knn":
            found = first if turn == 0 and first is not None else search(xw if turn == 0 else unit(xw @ s.best), p.k)
        s = train_turn(Held(xw, found), p, seed, turn, s)
    return s.best


#: Fit rows above which their neighbours are searched in Spark, since that is quadratic.
ALONE = 8192


def spark_neighbours(spark, x: np.ndarray, k: int):
    """As neighbours, by the block top-k join; k neighbours of each row come back."""
    k = max(1, min(k, len(x) - 1))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    got = self_knn(spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat})), k).toArrow()
    at = got.column("anchor_id").to_numpy() * k + got.column("rank").to_numpy() - 1
    idx, sim = np.zeros(len(x) * k, np.int64), np.zeros(len(x) * k)
    idx[at], sim[at] = got.column("neighbor_id").to_numpy(), got.column("sim").to_numpy()
    return idx.reshape(-1, k), sim.reshape(-1, k)


def fit_rows(df: DataFrame, vec: str, id_col: str, limit: int) -> np.ndarray:
    """The vectors, in id order; of more than limit ones, a sample of limit rows drawn over the whole table by a digest of the id. Fits don't use it.

    The reference draws RandomState(42).choice over positions, which needs a number for every row; a digest
    needs none, and depends neither on the order nor on the partitions of the table.
    """
    t = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    drawn = t.orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(limit)
    return matrix(drawn.orderBy("id").toArrow().column("v"))


class Sample:
    """All vectors of a table that one task can hold, whitened, and the projector that a trained matrix makes; ``StoredSample`` is that of a larger table."""

    def __init__(self, df: DataFrame, vec: str = "embedding", id_col: str = "vec_id", whiten: bool = True):
        self.spark = df.sparkSession
        x = matrix(df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).orderBy("id").toArrow().column("v"))
        self.mu = x.mean(axis=0)
        self.centred = x - self.mu
        self.s = _zca_matrix(self.centred.T @ self.centred / max(len(x) - 1, 1)) if whiten else np.eye(x.shape[1])
        self.unit = unit(self.centred @ self.s).astype(np.float32)

    def neighbours(self, k: int):
        """Of few rows here, of many in Spark."""
        return neighbours(self.unit, k) if len(self.unit) <= ALONE else spark_neighbours(self.spark, self.unit, k)

    def projector(self, w: np.ndarray, protocol: str, variant: str = "full", seed: int = 42) -> Projector:
        params = {"protocol": protocol, "variant": variant, "seed": str(seed)}
        if protocol == "annealed":
            y = self.centred @ self.s @ w
            return Projector("contrastive", [Step(self.s @ w, self.mu, y.mean(axis=0), np.maximum(y.std(axis=0, ddof=1), 1e-6), "add")], params)
        return Projector("contrastive", [Step(self.s, self.mu, norm="clamp"), Step(w, None, (self.unit @ w).mean(axis=0))], params)


class StoredSample:
    """As ``Sample``, of a table of any size: the whitened rows are a table and a store by ordinal, and moments stand for sums over rows."""

    def __init__(self, df: DataFrame, vec: str = "embedding", id_col: str = "vec_id", whiten: bool = True):
        from ..sources.cache import ordinals

        rows = staged(ordinals(df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")), "id").select("ordinal", "v"), "fit-rows")
        n, total, square = moments(rows, "v")
        self.n = int(n)
        self.mu, self.cov = central(n, total, square)
        self.s = _zca_matrix(self.cov) if whiten else np.eye(len(self.mu))
        mu, s = self.mu, self.s
        self.units = staged(_mapped(rows, lambda x: unit((x - mu) @ s)), "fit-units")
        self.mean = moments(self.units, "v")[1] / n
        self.store = store.write(self.units, "ordinal", "fit-store", len(mu), "f4", _fill_rows)

    def neighbours(self, k: int, jobs, turn: int, w: np.ndarray | None = None):
        """Store of the k nearest others, after the projection w, of the rows that jobs (settings, seed) draw in a turn, or of all where that is no fewer."""
        k = max(1, min(k, self.n - 1))
        rows = self.units if w is None else _mapped(self.units, lambda x: unit(x.astype(np.float32) @ w))
        rows = staged(rows.select(F.col("ordinal").alias("vec_id"), F.col("v").alias("embedding")), "fit-searched")
        size = [(p, seed, p.epochs * schedule(p, self.n)[1]) for p, seed in jobs]
        asked = rows
        if sum(steps * schedule(p, self.n)[0] for p, _, steps in size) < self.n:
            n, d = self.n, len(self.mu)

            def run(steps):
                for b in steps:
                    for j, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array(draw(size[j][0], n, d, size[j][1], turn, t)[0])], ["vec_id"])

            spark = rows.sparkSession
            steps = reduce(DataFrame.unionAll, [spark.range(s).select(F.lit(j).alias("j"), "id") for j, (_, _, s) in enumerate(size)])
            asked = staged(rows.join(steps.mapInArrow(run, "vec_id long").distinct(), "vec_id", "left_semi"), "fit-asked")
        return store.write(topk_join(asked, rows, k, exclude_self=True), "anchor_id", "fit-near", 2 * k, "f8", _fill_near)

    def projector(self, w: np.ndarray, protocol: str, variant: str = "full", seed: int = 42) -> Projector:
        params = {"protocol": protocol, "variant": variant, "seed": str(seed)}
        sw = self.s @ w
        if protocol == "annealed":
            std = np.sqrt(np.maximum(((self.cov @ sw) * sw).sum(axis=0), 0))
            return Projector("contrastive", [Step(sw, self.mu, np.zeros(sw.shape[1]), np.maximum(std, 1e-6), "add")], params)
        return Projector("contrastive", [Step(self.s, self.mu, norm="clamp"), Step(w, None, self.mean @ w)], params)


def _mapped(rows: DataFrame, f) -> DataFrame:
    """(ordinal, v) with f of the vectors, in single precision."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = f(matrix(b.column("v"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("ordinal"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], ["ordinal", "v"])

    return rows.select("ordinal", "v").mapInArrow(run, "ordinal long, v array<float>")


def _fill_rows(records, at, table):
    records[at] = matrix(table.column("v"))


def _fill_near(records, at, table):
    rank = table.column("rank").to_numpy() - 1
    records[at, rank] = table.column("neighbor_id").to_numpy()
    records[at, records.shape[1] // 2 + rank] = table.column("sim").to_numpy()


def contrastive(df: DataFrame, r: int, vec: str = "embedding", id_col: str = "vec_id", protocol: str = "annealed", variant: str = "full", seed: int = 42, whiten: bool = True, limit: int = 50_000, **over) -> Projector:
    """Learned projection, fitted to all rows; up to limit ones are held by a task, more are read from a store; over replaces single settings of the protocol."""
    from .grid import Job, fit_grid

    return next(iter(fit_grid({0: df}, [Job(0, r, protocol, variant, seed, tuple(sorted(over.items())))], vec, id_col, whiten, limit).values()))
