"""Exact deduplication by content sort, in DataFrame operations only.

Splitters that Spark samples range-partition the normalised content; each partition is sorted
externally, so equal contents lie next to each other, and every row is compared in full with its
neighbour. Rows that are equal make a run, whose first row stays, since longer originals and then smaller ids
come first in it; the size of a group is that of its run. The range key is (first bytes, hash,
salt): sampled keys stay short however long the texts are, and a shared beginning does not fill one
partition. Texts that hold more than one part in ``HOT_SHARE`` of all rows are salted by document,
so a group with a third of the corpus is sorted in many partitions; only their runs, at most
``HOT_SHARE * SALTS``, are joined up by the digest of the content.

Defined results: a null text counts as empty; all empty texts form one group; null ids come last;
rows that repeat the kept id with the same content are all marked kept; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_keys, materialize, table

SALTS = HOT_SHARE
PREFIX = 32


def normalise(text):
    """The text without the characters 9 to 13 and 32."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = base.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_cp"), normalise(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    hot = F.broadcast(materialize(hot_keys(rows.select("h"), "h").withColumn("hot", F.lit(True)), "exact-hot"))
    salted = rows.join(hot, "h", "left").select(
        "doc_id", "n_cp", "norm", "h",
        F.substring("norm", 1, PREFIX).alias("head"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0).cast("int").alias("salt"),
    )
    key = ("head", "h", "salt")
    near = Window.partitionBy(*key).orderBy("norm", F.desc("n_cp"), F.col("doc_id").asc_nulls_last())
    # a row that differs from its neighbour in front begins a run and stays; the others follow it
    runs = salted.repartitionByRange(*key).withColumn("first", ~F.col("norm").eqNullSafe(F.lag("norm").over(near)))
    begun = F.when(F.col("first"), F.struct(F.sha2("norm", 256).alias("sha"), F.col("n_cp").alias("n_cp"), F.col("doc_id").alias("doc_id")))
    runs = runs.select("doc_id", *key, begun.alias("begun"), F.sum(F.col("first").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.last(begun, ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("top"))
    runs = runs.select("doc_id", "salt", "begun", "top", F.count(F.lit(1)).over(Window.partitionBy(*key, "run")).alias("n"))
    runs = materialize(runs, "exact-runs")
    # runs that salting has split: one row each, at most HOT_SHARE contents after the merge
    last = F.struct(F.col("top.n_cp").alias("n_cp"), F.col("top.doc_id").isNotNull().alias("known"), (-F.col("top.doc_id")).alias("neg"))
    parts = runs.where("salt > 0 and begun is not null").groupBy("top.sha").agg(F.max(last).alias("best"), F.sum("n").alias("n"))
    parts = F.broadcast(parts.select("sha", (-F.col("best.neg")).alias("keep"), F.col("n").alias("size")))
    one = runs.where("salt = 0").select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("top.sha").alias("sha"))
    many = runs.where("salt > 0").select("doc_id", "top.sha").join(parts, "sha").select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "sha")
    return one.unionByName(many).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
"""
