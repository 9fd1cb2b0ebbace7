"""Sources and sinks: declared schemas, checked look-ups, partitioned embedding tables, result files."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, title_body

PAIRS = "sentence1 string, sentence2 string, score double"
CORPUS = "_id string, title string, text string"
QRELS = "query_id string, corpus_id string, score int"
EMBEDDINGS = "id string, embedding array<float>, model string, source string, layer int, pool string, split string"
TOKENS = "id long, tokens array<struct<pos:int,mask:int,h:array<float>>>"
RESULTS = (
    "dataset string, split string, model_nickname string, hf_model_id string, embedding_type string, method string, layer_name string, layer_idx int, pooling string, space string, k int, "
    "tau double, gold_threshold double, r int, seed string, fit_mode string, fit_size int, eval_size int, metric_name string, metric_value double, std_if_available double, recall_at_10 double, "
    "recall_at_k double, anchor_hit_rate double, cond_number double, offdiag_cov double, avg_feature_std double, anisotropy_mean double, median double, p25 double, p75 double, pct_ge_4_0 double, "
    "pct_ge_4_5 double, matched_pairs int, train_dataset string, test_dataset string, drop_vs_refit double, still_above_base boolean, notes string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none, so that callers can skip it."""
    return spark.read.parquet(path) if exists(spark, path) else None


def read_pairs(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return spark.read.schema(PAIRS).option("multiLine", True).json(f"{folder}/sts_{split}.json")


def sts_pairs(spark: SparkSession, folder: str, split: str = "test"):
    """(fit sentences, evaluation pairs) of a folder of JSON splits; split is 'test' or 'train+test' (with repeats)."""
    read = lambda s: read_pairs(spark, folder, s)
    if split not in ("test", "train+test"):
        raise ValueError(f"unknown split {split!r}")
    return sentences(read("valid")), read("test") if split == "test" else read("train").unionAll(read("test"))


def sentences(pairs: DataFrame, a: str = "sentence1", b: str = "sentence2") -> DataFrame:
    """Distinct sentences of both columns."""
    return pairs.select(F.col(a).alias("text")).union(pairs.select(F.col(b).alias("text"))).distinct()


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return wanted.join(found.select(key), key, "left_anti")


def lookup(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """wanted joined to found; an error if found lacks any."""
    absent = missing(wanted, found, key).limit(3).collect()  # for the message
    if absent:
        raise ValueError(f"no {key} such as {[r[key] for r in absent]} in the table; encode these first")
    return wanted.join(found, key)


def ordered_subset(wanted: DataFrame, found: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    return lookup(wanted, found, key).orderBy(pos)


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a judgment, in id order."""
    return queries.withColumn("query_id", F.col("query_id").cast("string")).join(qrels.select(F.col("query_id").cast("string").alias("query_id")), "query_id", "left_semi").orderBy("query_id")


def grouped_qrels(qrels: DataFrame, graded: bool = False) -> DataFrame:
    """One row per query: the sorted set of its documents, or a map to their grades."""
    if graded:
        return qrels.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("corpus_id", "score")))).alias("grades"))
    return qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("corpus_id")).alias("docs"))


def documents(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("_id").cast("string").alias("id"), title_body("title", "text").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, stripped, without blank ones."""
    return spark.read.text(path).select(strip("value").alias("line")).where(F.length("line") > 0)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Cache table laid out so that a model, source, layer, pooling or split is a folder to prune."""
    df.write.mode("append").partitionBy("model", "source", "layer", "pool", "split").parquet(path)


def read_embeddings(spark: SparkSession, path: str, **part) -> DataFrame:
    df = spark.read.schema(EMBEDDINGS).parquet(path)
    for k, v in part.items():
        df = df.where(F.col(k) == v)
    return df


def to_encode(wanted: DataFrame, cache: DataFrame | None, key: str = "text") -> DataFrame:
    """Rows that the cache lacks."""
    return wanted if cache is None else missing(wanted, cache, key)


def seeded_rows(spark: SparkSession, n: int, size: int, seed: int = 42) -> DataFrame:
    """(draw, ordinal): the positions that RandomState(seed).choice draws without replacement."""
    picked = np.random.RandomState(seed).choice(n, min(size, n), replace=False)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(picked)], "draw int, ordinal long")


def random_pairs(n: int, size: int, seed: int = 0, tries: int = 200) -> np.ndarray:
    """The stream of index pairs that is searched for annotated ones; pairs of one item with itself are dropped."""
    draws = np.random.RandomState(seed).randint(0, n, (tries * size, 2))
    return draws[draws[:, 0] != draws[:, 1]]


def ensure_dir(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def metadata_row(**values) -> dict:
    """values without those that are None."""
    return {k: v for k, v in values.items() if v is not None}


def set_seed(seed: int) -> np.random.RandomState:
    """Seeds the global generators of the driver, and gives one of its own; fits and draws take their seeds as arguments."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.RandomState(seed)


def results(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows with any columns of RESULTS; the others are null."""
    return spark.createDataFrame([metadata_row(**r) for r in rows], RESULTS)


def save_results(rows: DataFrame, path: str) -> tuple[str, str]:
    """Result rows as CSV with a header and as JSON lines, nulls left out of the latter; returns both places."""
    places = f"{path}.csv", f"{path}.jsonl"
    rows.write.mode("overwrite").option("header", True).csv(places[0])
    rows.write.mode("overwrite").json(places[1])
    return places


def save_scores(scores: DataFrame, path: str, by: str = "space", value: str = "score") -> None:
    scores.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("scores")).write.mode("overwrite").json(path)


def save_failures(cases: DataFrame, counts: dict[str, int], path: str, top: int = 30) -> str:
    """Cases (see ``operators.failures``) as CSV of ten columns, and a Markdown report of the first, with the counts of all; at most top rows reach the driver."""
    cases.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{path}.csv")
    lines = ["# Mined neighbours that are lexically close, but not alike", "", *[f"- {k}: {v}" for k, v in counts.items()], ""]
    for r in cases.limit(top).collect():
        lines += [f"**[{r['dataset']}/{r['model']}]** rank {r['rank']}, cos={r['cosine_similarity']}, gold={r['gold_label_or_score']}, jaccard={r['lexical_overlap']}", f"- anchor: {r['anchor_text']}", f"- neighbor: {r['neighbor_text']}", ""]
    report = "\n".join(lines)
    cases.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.md")
    return report
