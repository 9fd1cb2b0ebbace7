"""Fitted projections: a chain of affine steps, applied to vector columns in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knn import matrix

EPS = 1e-12


@dataclass
class Step:
    """((x - mu_in) W - mu_out) / std_out, then normalised: 'add', 'clamp' or not at all. With less, x - mu_in without its part along W's columns takes the place of the product, so that no D x D matrix is held."""

    w: np.ndarray
    mu_in: np.ndarray | None = None
    mu_out: np.ndarray | None = None
    std_out: np.ndarray | None = None
    norm: str = "add"
    less: bool = False

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = x if self.mu_in is None else x - self.mu_in
        y = x @ self.w
        if self.less:
            y = x - y @ self.w.T
        if self.mu_out is not None:
            y = y - self.mu_out
        if self.std_out is not None:
            y = y / self.std_out
        if not self.norm:
            return y
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return y / (n + EPS) if self.norm == "add" else y / np.maximum(n, EPS)


@dataclass
class Projector:
    name: str
    steps: list[Step]
    params: dict[str, str] = field(default_factory=dict)

    def apply(self, x: np.ndarray) -> np.ndarray:
        for s in self.steps:
            x = s.apply(x)
        return x

    def transform(self, df: DataFrame, vec: str = "embedding", out: str | None = None) -> DataFrame:
        """df with vec (or out) holding the projected vectors; stateless, so it serves streams as well. Null vectors stay null."""
        out = out or vec
        sent, index = self.steps, df.columns.index(vec)
        model = Projector(self.name, sent)
        names = [c for c in df.columns if c != out] + [out]
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join(f"`{c}` {kinds[c] if c != out else 'array<double>'}" for c in names)

        def run(batches):
            for b in batches:
                v = b.column(index)
                full = np.flatnonzero(~np.asarray(v.is_null()))
                y = model.apply(matrix(v.take(pa.array(full)))) if len(full) else np.zeros((0, 0))
                n = np.zeros(b.num_rows + 1, np.int32)
                n[full + 1] = y.shape[1]
                mask = np.ones(b.num_rows, bool)
                mask[full] = False
                got = pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(y.ravel()), mask=pa.array(mask))
                cols = {c: b.column(i) for i, c in enumerate(b.schema.names)} | {out: got}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

        return df.mapInArrow(run, schema)

    def rows(self) -> list[tuple]:
        """A row of SCHEMA for each step."""
        row = lambda a: None if a is None else np.asarray(a, float).ravel().tolist()
        return [(self.name, i, len(s.w), s.w.shape[1], row(s.w), row(s.mu_in), row(s.mu_out), row(s.std_out), s.norm, s.less, self.params) for i, s in enumerate(self.steps)]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.rows(), SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Projector:
        rows = spark.read.schema(SCHEMA).parquet(path).orderBy("step").collect()  # a row a step
        arr = lambda a: None if a is None else np.array(a)
        steps = [Step(np.array(r["W"]).reshape(r["d"], r["r"]), arr(r["mu_in"]), arr(r["mu_out"]), arr(r["std_out"]), r["norm"], bool(r["less"])) for r in rows]
        return cls(rows[0]["name"], steps, dict(rows[0]["params"] or {}))


    def save_npz(self, path: str) -> None:
        """One affine step as a NumPy archive (SW, mu_in, mu_out, std_out and the parameters), on the driver's files."""
        (s,) = self.steps
        d, r = s.w.shape
        parts = {"SW": s.w, "mu_in": np.zeros(d) if s.mu_in is None else s.mu_in, "mu_out": np.zeros(r) if s.mu_out is None else s.mu_out, "std_out": np.ones(r) if s.std_out is None else s.std_out}
        np.savez(path, **{k: np.asarray(v, np.float32) for k, v in parts.items()}, **({"dim": r} | {k: int(v) if v.isdigit() else v for k, v in self.params.items()}))

    @classmethod
    def load_npz(cls, path: str) -> Projector:
        with np.load(path, allow_pickle=False) as z:
            step = Step(z["SW"], z["mu_in"], z["mu_out"], z["std_out"], "add")
            params = {k: str(z[k]) for k in z.files if k not in ("SW", "mu_in", "mu_out", "std_out")}
        return cls("contrastive", [step], params)


SCHEMA = "name string, step int, d int, r int, W array<double>, mu_in array<double>, mu_out array<double>, std_out array<double>, norm string, less boolean, params map<string,string>"


def project_expression(vec: str, w: np.ndarray, mu: np.ndarray | None = None):
    """(x - mu) W as one Catalyst expression, for small W."""
    from ..functions.vectors import dot, doubles, minus

    x = doubles(vec) if mu is None else minus(vec, F.lit(list(map(float, mu))))
    return F.array(*[dot(x, F.array(*[F.lit(float(a)) for a in col])) for col in np.asarray(w).T])
