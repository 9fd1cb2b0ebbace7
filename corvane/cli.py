"""Command line: fit a projector to a file, apply it to another, run a workload or a registered query.

    python -m corvane.cli fit --input corpus.txt --dim 80 --out projector [--vectors] [--model module:function] [--pool last] [--seed 42]
    python -m corvane.cli apply --projector projector --input more.txt --out vectors
    python -m corvane.cli run sts_testonly --data folder --out results [--methods base,pca --dims 8,16 --seeds 42]

Input is a text file with a line an item, which is encoded, or with --vectors a Parquet table (vec_id, embedding).
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.contrastive import contrastive
from .operators.projector import Projector
from .plans.workloads import WORKLOADS
from .sources import tables
from .sources.cache import ordinals
from .sources.encoders import Encoder


def _model(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read_items(spark: SparkSession, path: str, encoder: Encoder | None) -> DataFrame:
    """(vec_id, embedding): encoded lines in order of their text, or the vectors of a table."""
    if encoder is None:
        return spark.read.parquet(path)
    lines = ordinals(tables.text_lines(spark, path), "line").select(F.col("ordinal").alias("vec_id"), "line")
    return encoder.encode(lines, "line").where("embedding is not null")


def fit(spark: SparkSession, path: str, dim: int, out: str, model: str | None = None, pool: str = "mean", seed: int = 42, vectors: bool = False) -> Projector:
    encoder = None if vectors else Encoder(model or "digest", pool=pool, model=_model(model))
    p = contrastive(read_items(spark, path, encoder), dim, seed=seed)
    p.params |= {"model": model or "", "pool": pool, "dim": str(dim), "vectors": str(vectors)}
    p.save(spark, out)
    return p


def apply(spark: SparkSession, projector: str, path: str, out: str) -> DataFrame:
    p = Projector.load(spark, projector)
    encoder = None if p.params["vectors"] == "True" else Encoder(p.params["model"] or "digest", pool=p.params["pool"], model=_model(p.params["model"]))
    p.transform(read_items(spark, path, encoder)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def run(spark: SparkSession, name: str, data: str, out: str, **choice) -> tuple[str, str]:
    """Results of a workload; choice: its methods, dims or seeds."""
    return tables.save_results(WORKLOADS[name](spark, data, **choice), out)


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="corvane")
    sub = top.add_subparsers(dest="call", required=True)
    a = sub.add_parser("fit")
    a.add_argument("--input", required=True)
    a.add_argument("--dim", type=int, required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--model", help="module:function from texts to (states, mask)")
    a.add_argument("--pool", default="mean", choices=["mean", "last", "second_last"])
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--vectors", action="store_true")
    a = sub.add_parser("apply")
    for x in ("--projector", "--input", "--out"):
        a.add_argument(x, required=True)
    a = sub.add_parser("run")
    a.add_argument("name", choices=sorted(WORKLOADS))
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    for x in ("--methods", "--dims", "--seeds"):
        a.add_argument(x)
    o = top.parse_args(args)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    if o.call == "fit":
        fit(spark, o.input, o.dim, o.out, o.model, o.pool, o.seed, o.vectors)
    elif o.call == "apply":
        apply(spark, o.projector, o.input, o.out)
    else:
        choice = {k: tuple(x if k == "methods" else int(x) for x in v.split(",")) for k in ("methods", "dims", "seeds") if (v := getattr(o, k))}
        run(spark, o.name, o.data, o.out, **choice)


if __name__ == "__main__":
    main()
