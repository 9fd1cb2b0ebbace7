"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_folder

#: Word separators of every contract: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, see ``stage.shared_folder``."""
    return shared_folder(spark).removesuffix("/corvane")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    for made in _SCRATCH:
        made.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that materialize makes inside are deleted at the end; what is to stay is written outside."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession, more: dict[str, str] | None = None):
    """Shuffle files of the jobs run inside go as soon as the job is over; more: other settings that hold inside."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (more or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A key is hot if it holds more than one part in this of all rows, and more than HOT_ROWS of them.
HOT_SHARE = 1024
HOT_ROWS = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than one part in HOT_SHARE of all rows: fewer than HOT_SHARE rows, whatever the input."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, rows.count() // HOT_SHARE)
    return n.where((F.col("n") > least) & F.col(key).isNotNull()).select(key)


def lookup(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """rows left-joined to right, which has one row a key: hot keys by broadcast, so none fills a task, all others by shuffle. rows should be stored, since it is read several times."""
    hot = materialize(hot_keys(rows, key), "hot")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))  # fewer than HOT_SHARE rows
    return marked.where("_hot").drop("_hot").join(few, key, "left").unionByName(marked.where("_hot is null").drop("_hot").join(right, key, "left"))


def bounded(df: DataFrame, limit: int = 1 << 15) -> DataFrame:
    """df (stored), to be broadcast if it has at most limit rows and joined by shuffle beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
