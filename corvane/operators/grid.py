"""A grid of learned fits as Spark tasks: a job is a sample, a protocol's settings, a rank and a seed.

Samples are whole tables of vectors, whitened and searched once, however many jobs train on them. Those of up to ``limit``
vectors are sent to the executors as bounded broadcasts; larger ones are stores that tasks read the rows of their batches
from, and Spark searches among all their rows before every turn. Every job is a row of a table with a partition for each,
so it is a task of its own with one BLAS thread; what comes back is a D x r matrix a job, and between turns the
optimiser's state. A lost executor costs the jobs it held.
"""

from __future__ import annotations

import pickle
from collections.abc import Hashable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contrastive as con
from .projector import SCHEMA, Projector
from .threads import one_blas_thread


@dataclass(frozen=True)
class Job:
    """protocol and variant as in ``contrastive``; over: single settings of the protocol, as sorted pairs."""

    sample: Hashable
    rank: int
    protocol: str = "annealed"
    variant: str = "full"
    seed: int = 42
    over: tuple = ()

    def settings(self) -> con.Protocol:
        return replace(con.PROTOCOLS[self.protocol], **(con.VARIANTS[self.variant] | dict(self.over)))


def _train(samples, near, jobs):
    """Runs the jobs of the ids it gets."""

    def run(batches):
        one_blas_thread()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                job = jobs[i]
                p, x = job.settings(), samples.value[job.sample]
                found = near.value.get(job.sample)
                w = con.train(x, job.rank, p, job.seed, first=found and tuple(v[:, : p.k] for v in found))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w.shape[1]], pa.int32()), pa.array([w.ravel().astype(np.float64).tolist()], pa.list_(pa.float64()))], ["job", "r", "w"])

    return run


def _train_turn(stores, states, jobs, turn):
    """Runs one turn of the jobs of the ids it gets, over the rows and neighbours of stores, from states."""

    def run(batches):
        one_blas_thread()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows, n, near = stores[i]
                s = con.train_turn(con.Stored(rows, n, near), jobs[i].settings(), jobs[i].seed, turn, states.value[i])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(s)], pa.binary())], ["job", "state"])

    return run


def _fit_stored(samples: dict[Hashable, con.StoredSample], jobs: list[Job], spark) -> dict[Job, Projector]:
    """As fit_grid, of samples that no task can hold."""
    p = {j: j.settings() for j in jobs}
    state = {j: con.begin(len(samples[j.sample].mu), j.rank, j.seed) for j in jobs}
    for turn in range(max(x.refine for x in p.values()) + 1):
        now = [j for j in jobs if turn <= p[j].refine]
        near = {}
        if turn:
            near = {j: samples[j.sample].neighbours(p[j].k, [(p[j], j.seed)], turn, state[j].best) for j in now if p[j].positives == "knn"}
        else:
            for s, x in samples.items():
                if own := [j for j in now if j.sample == s and p[j].positives == "knn"]:
                    near |= dict.fromkeys(own, x.neighbours(max(p[j].k for j in own), list(dict.fromkeys((p[j], j.seed) for j in own)), turn))
        stores = [(samples[j.sample].store, samples[j.sample].n, near.get(j)) for j in now]
        sent = spark.sparkContext.broadcast([state[j] for j in now])
        got = spark.range(0, len(now), 1, len(now)).mapInArrow(_train_turn(stores, sent, now, turn), "job long, state binary").collect()  # a few D x r matrices and the bank a job
        sent.unpersist()
        state |= {now[x["job"]]: pickle.loads(x["state"]) for x in got}
    return {j: samples[j.sample].projector(state[j].best.astype(np.float64), j.protocol, j.variant, j.seed) for j in jobs}


def fit_grid(samples: dict[Hashable, DataFrame], jobs: list[Job], vec: str = "embedding", id_col: str = "vec_id", whiten: bool = True, limit: int = 50_000) -> dict[Job, Projector]:
    """The projector of each job, fitted to all vectors of its sample; samples: the tables of vectors by name. Up to limit vectors are held by a task, more are read from a store. Equal jobs are trained once."""
    jobs = list(dict.fromkeys(jobs))
    if not jobs:
        return {}
    spark = next(iter(samples.values())).sparkSession
    used = list(dict.fromkeys(j.sample for j in jobs))
    large = {s for s in used if samples[s].where(F.col(vec).isNotNull()).count() > limit}
    out = {}
    if large:
        out = _fit_stored({s: con.StoredSample(samples[s], vec, id_col, whiten) for s in used if s in large}, [j for j in jobs if j.sample in large], spark)
        if len(large) == len(used):
            return out
    jobs = [j for j in jobs if j.sample not in large]
    ready = {s: con.Sample(samples[s], vec, id_col, whiten) for s in used if s not in large}
    most = {}  # neighbours of a sample are searched once, for the job that wants the most; all others take the first of them
    for j in jobs:
        if (p := j.settings()).positives == "knn":
            most[j.sample] = max(p.k, most.get(j.sample, 0))
    near = {s: ready[s].neighbours(k) for s, k in most.items()}
    sent = spark.sparkContext.broadcast({s: x.unit for s, x in ready.items()}), spark.sparkContext.broadcast(near)
    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(_train(*sent, jobs), "job long, r int, w array<double>").collect()  # D x r numbers a job
    for b in sent:
        b.unpersist()
    return out | {jobs[x["job"]]: ready[jobs[x["job"]].sample].projector(np.array(x["w"]).reshape(-1, x["r"]), jobs[x["job"]].protocol, jobs[x["job"]].variant, jobs[x["job"]].seed) for x in rows}


def projector_rows(spark, fits: dict[Job, Projector]) -> DataFrame:
    """The grid as a table: sample, protocol, variant, rank, seed, and the projector's rows (see ``Projector.save``)."""
    rows = [(str(j.sample), j.protocol, j.variant, j.rank, j.seed, *r) for j, p in fits.items() for r in p.rows()]
    return spark.createDataFrame(rows, f"sample string, protocol string, variant string, rank int, seed int, {SCHEMA}")
