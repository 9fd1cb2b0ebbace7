"""Cached embeddings: building them with an encoder, and loading evaluation sets on top of them.

The cache is one Parquet table (see ``tables.EMBEDDINGS``), laid out by model, source, layer, pooling and split, with a
row a text or id. Building encodes only what the cache lacks. A set's folder holds its texts and judgments:
``sts_{valid,train,test}.json``, or ``corpus.jsonl``, ``queries.jsonl`` and ``qrels.csv``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .encoders import Encoder
from .stage import staged


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """df with ordinal: the place of each row in the order of key, counted inside range partitions on top of those before."""
    rows = staged(df.orderBy(key).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    per = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    per = per.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row a partition
    return rows.join(F.broadcast(per), "_p").withColumn("ordinal", F.col("_base") + F.col("_i")).drop("_p", "_m", "_i", "_base")


def drawn(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """df's rows at the places, in key order, that the seeded draw picks, with their draw."""
    placed = staged(ordinals(df, key), "placed")
    return placed.join(F.broadcast(tables.seeded_rows(df.sparkSession, placed.count(), size, seed)), "ordinal").drop("ordinal")


def cached(spark: SparkSession, path: str, encoder: Encoder, source: str, split: str) -> DataFrame | None:
    """(id, embedding) of a part of the cache, or None where there is no cache."""
    if not tables.exists(spark, path):
        return None
    part = {"model": encoder.name, "source": f"{source}-{encoder.template}", "layer": encoder.layer, "pool": encoder.pool, "split": split}
    return tables.read_embeddings(spark, path, **part).select("id", "embedding")


def encode_missing(wanted: DataFrame, path: str, encoder: Encoder, source: str, split: str) -> DataFrame:
    """(id, embedding) of wanted (id, text): read where the cache has them, encoded and added to it otherwise. A cache of more texts serves as well."""
    spark = wanted.sparkSession
    have = cached(spark, path, encoder, source, split)
    new = tables.to_encode(wanted.dropDuplicates(["id"]), have, "id")
    rows = encoder.encode(new).where("embedding is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(encoder.name).alias("model"), F.lit(f"{source}-{encoder.template}").alias("source"), F.lit(encoder.layer).alias("layer"), F.lit(encoder.pool).alias("pool"), F.lit(split).alias("split"))
    tables.write_embeddings(rows, path)
    return wanted.select("id").distinct().join(cached(spark, path, encoder, source, split), "id")


def encode_layers(wanted: DataFrame, path: str, encoder: Encoder, layers, pools, source: str, split: str) -> None:
    """Every layer and pooling of wanted (id, text) that the cache lacks, by one pass of the model over the texts that lack any."""
    spark = wanted.sparkSession
    outputs = [(layer, pool) for layer in layers for pool in pools]
    lacking = wanted.select("id").distinct().withColumn("o", F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(pool).alias("pool")) for layer, pool in outputs]))).select("id", "o.*")
    have = [(o, cached(spark, path, replace(encoder, layer=o[0], pool=o[1]), source, split)) for o in outputs]
    for (layer, pool), rows in have:
        if rows is not None:
            lacking = lacking.join(rows.select("id", F.lit(layer).alias("layer"), F.lit(pool).alias("pool")), ["id", "layer", "pool"], "left_anti")
    lacking = staged(lacking, "lacking")
    texts = wanted.dropDuplicates(["id"]).join(lacking.select("id").distinct(), "id", "left_semi")
    rows = encoder.encode_many(texts.select("id", "text"), outputs).join(lacking, ["id", "layer", "pool"], "left_semi")
    rows = rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(encoder.name).alias("model"), F.lit(f"{source}-{encoder.template}").alias("source"), "layer", "pool", F.lit(split).alias("split"))
    tables.write_embeddings(rows, path)


def build_sts(spark: SparkSession, folder: str, path: str, encoder: Encoder) -> DataFrame:
    """Vectors of the distinct sentences of all three splits."""
    splits = [tables.read_pairs(spark, folder, s) for s in ("valid", "train", "test")]
    every = tables.sentences(splits[0].unionByName(splits[1]).unionByName(splits[2]))
    return encode_missing(every.select(F.col("text").alias("id"), "text"), path, encoder, "sts", "all")


def build_layers(spark: SparkSession, folder: str, path: str, encoder: Encoder, layers, pools=("mean", "last")) -> None:
    """Vectors of the fit and evaluation sentences at each layer and pooling; the evaluation part covers train and test, so that either can be read from it."""
    fit, pairs = tables.sts_pairs(spark, folder, "train+test")
    for split, texts in (("fit", fit), ("eval", tables.sentences(pairs))):
        encode_layers(texts.select(F.col("text").alias("id"), "text"), path, encoder, layers, pools, "layers", split)


def _retrieval_tables(spark: SparkSession, folder: str):
    read = lambda n: tables.documents(spark.read.schema(tables.CORPUS).json(f"{folder}/{n}.jsonl"))
    qrels = spark.read.schema(tables.QRELS).option("header", True).csv(f"{folder}/qrels.csv")
    return read("corpus"), read("queries"), qrels


def build_retrieval(spark: SparkSession, folder: str, path: str, encoder: Encoder, name: str, fit_size: int, fit_from: str = "queries") -> None:
    """Vectors of the corpus, of the judged queries, and of a seeded sample of all queries or of the corpus to fit on."""
    corpus, queries, qrels = _retrieval_tables(spark, folder)
    judged = tables.judged_queries(queries.withColumnRenamed("id", "query_id"), qrels).withColumnRenamed("query_id", "id")
    encode_missing(corpus, path, encoder, name, "corpus")
    encode_missing(judged, path, encoder, name, "queries")
    encode_missing(drawn(queries if fit_from == "queries" else corpus, "id", fit_size).select("id", "text"), path, encoder, name, f"fit-{fit_size}")


@dataclass
class RetrievalSet:
    corpus: DataFrame
    queries: DataFrame
    fit: DataFrame | None
    #: (query_id, corpus_id, score)
    qrels: DataFrame
    texts: DataFrame


def load_retrieval(spark: SparkSession, folder: str, path: str, encoder: Encoder, name: str, fit_size: int | None = None) -> RetrievalSet:
    """The parts of a built retrieval set; an error names the call that builds what is missing."""
    parts = {s: cached(spark, path, encoder, name, s) for s in ("corpus", "queries", *([f"fit-{fit_size}"] if fit_size else []))}
    for s, p in parts.items():
        if p is None or p.isEmpty():
            raise FileNotFoundError(f"no {s} of {name} for {encoder.name} in {path}; build it with build_retrieval({folder!r}, ...)")
    corpus, queries, qrels = _retrieval_tables(spark, folder)
    texts = corpus.withColumn("side", F.lit("corpus")).unionByName(queries.withColumn("side", F.lit("queries")))
    return RetrievalSet(parts["corpus"], parts["queries"], parts.get(f"fit-{fit_size}"), qrels.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi"), texts)


def load_sts(spark: SparkSession, folder: str, path: str, encoder: Encoder, split: str = "test"):
    """(vectors of the fit sentences, evaluation pairs, vectors of their sentences); an error if the cache lacks any."""
    fit, pairs = tables.sts_pairs(spark, folder, split)
    have = cached(spark, path, encoder, "sts", "all")
    if have is None:
        raise FileNotFoundError(f"no sentences for {encoder.name} in {path}; build them with build_sts({folder!r}, ...)")
    look = lambda t: tables.lookup(t.select(F.col("text").alias("id")), have, "id")
    return look(fit), pairs, look(tables.sentences(pairs))


def load_target(spark: SparkSession, folder: str, path: str, encoder: Encoder, name: str):
    """(pairs, vectors) of the test split of a pair set, its sentences in order, or None where nothing is cached, so that callers skip it."""
    have = cached(spark, path, encoder, name, "test")
    if have is None or have.isEmpty():
        return None
    pairs = tables.read_pairs(spark, folder, "test")
    return pairs, tables.lookup(tables.sentences(pairs).select(F.col("text").alias("id")), have, "id").orderBy("id")


def build_target(spark: SparkSession, folder: str, path: str, encoder: Encoder, name: str) -> DataFrame:
    texts = tables.sentences(tables.read_pairs(spark, folder, "test"))
    return encode_missing(texts.select(F.col("text").alias("id"), "text"), path, encoder, name, "test")
