"""Failure cases: mined neighbours that share words with their anchor, but aren't alike by judgment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard

COLUMNS = ("dataset", "model", "anchor_text", "neighbor_text", "space", "rank", "cosine_similarity", "gold_label_or_score", "lexical_overlap", "notes")


def _cases(pairs: DataFrame, dataset: str, model: str, space: str, jac_min: float, notes: str) -> DataFrame:
    """pairs: (anchor_id, neighbor_id, rank, sim, anchor_text, neighbor_text, gold)."""
    near = pairs.withColumn("jac", jaccard("anchor_text", "neighbor_text")).where(F.col("jac") >= jac_min)
    fixed = [F.lit(v).alias(k) for k, v in (("dataset", dataset), ("model", model), ("space", space), ("notes", notes))]
    out = near.select("anchor_id", "neighbor_id", *fixed, "anchor_text", "neighbor_text", F.col("rank").cast("int").alias("rank"), F.round("sim", 4).alias("cosine_similarity"), F.col("gold").cast("string").alias("gold_label_or_score"), F.round("jac", 3).alias("lexical_overlap"))
    return out.select("anchor_id", "neighbor_id", *COLUMNS)


def _texts(pairs: DataFrame, anchors: DataFrame, others: DataFrame) -> DataFrame:
    one = anchors.select(F.col("id").alias("anchor_id"), F.col("text").alias("anchor_text"))
    two = others.select(F.col("id").alias("neighbor_id"), F.col("text").alias("neighbor_text"))
    return pairs.join(one, "anchor_id").join(two, "neighbor_id")


def scored_failures(knn: DataFrame, texts: DataFrame, gold: DataFrame, tau: float = 0.0, gold_max: float = 2.0, jac_min: float = 0.5, dataset: str = "pairs", model: str = "", space: str = "raw") -> DataFrame:
    """Neighbours at tau or above whose pair (gold: lo, hi, score) is scored at most gold_max."""
    pairs = knn.where(F.col("sim") >= tau).withColumn("lo", F.least("anchor_id", "neighbor_id")).withColumn("hi", F.greatest("anchor_id", "neighbor_id"))
    pairs = pairs.join(gold.where(F.col("score") <= gold_max), ["lo", "hi"]).withColumnRenamed("score", "gold")
    return _cases(_texts(pairs, texts, texts), dataset, model, space, jac_min, f"gold<= {gold_max}, jaccard>= {jac_min}")


def unjudged_failures(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame, jac_min: float = 0.5, dataset: str = "search", model: str = "", space: str = "raw") -> DataFrame:
    """Results of a search that are no judged answer of their query."""
    judged = qrels.select(F.col("query_id").alias("anchor_id"), F.col("corpus_id").alias("neighbor_id")).distinct()
    pairs = ranked.join(judged, ["anchor_id", "neighbor_id"], "left_anti").withColumn("gold", F.lit("not_duplicate"))
    return _cases(_texts(pairs, queries, corpus), dataset, model, space, jac_min, f"mined but not duplicate, jaccard>= {jac_min}")


def label_unjudged_failures(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, labels: DataFrame, id_col: str = "vec_id", label: str = "label", **kw) -> DataFrame:
    """As unjudged_failures, where another vector of the query's label is a judged answer: only labels of the results are looked up, and judgments are never made."""
    of = lambda x, l: labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias(x), F.col(label).alias(l)).distinct()  # noqa: E731, E741
    own = ranked.where("anchor_id <> neighbor_id").select("anchor_id", "neighbor_id").join(of("anchor_id", "_a"), "anchor_id").join(of("neighbor_id", "_b"), "neighbor_id")
    return unjudged_failures(ranked, queries, corpus, own.where("_a = _b").select(F.col("anchor_id").alias("query_id"), F.col("neighbor_id").alias("corpus_id")), **kw)


def first(cases: DataFrame, top: int = 30) -> DataFrame:
    """The top cases by falling overlap, then cosine."""
    return cases.orderBy(F.desc("lexical_overlap"), F.desc("cosine_similarity"), "anchor_id", "neighbor_id").limit(top)
