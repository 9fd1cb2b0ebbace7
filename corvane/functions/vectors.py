"""Vector expressions on array columns; every one is a Catalyst expression in double precision."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda refers to outside itself is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v, by) -> Column:
    """v / by, where by may depend on v."""
    return let(by, lambda n: F.transform(doubles(v), lambda x: x / n))


def normalize_added(v) -> Column:
    """v / (|v| + eps)."""
    return let(doubles(v), lambda x: scaled(x, norm(x) + F.lit(EPS)))


def normalize_clamped(v) -> Column:
    """v / max(|v|, eps)."""
    return let(doubles(v), lambda x: scaled(x, F.greatest(norm(x), F.lit(EPS))))


def cosine(a, b) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))


def minus(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


SQL_FUNCTIONS = {
    "vec_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_l2norm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vec_cosine": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN vec_dot(a, b) / ((vec_l2norm(a) + 1e-12D) * (vec_l2norm(b) + 1e-12D))",
    "token_jaccard": "(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(try_divide(size(array_intersect(filter(split(lower(a), '\\\\s+'), x -> x <> ''), filter(split(lower(b), '\\\\s+'), x -> x <> ''))), size(array_union(filter(split(lower(a), '\\\\s+'), x -> x <> ''), filter(split(lower(b), '\\\\s+'), x -> x <> '')))), 0D)",
}


def register(spark: SparkSession) -> None:
    """Make the expressions callable from SQL text."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
