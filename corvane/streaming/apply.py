"""Projection of a stream: the fitted steps are stateless, so a streaming table is transformed as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.projector import Projector


def read_vectors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def project_stream(stream: DataFrame, model: Projector, path: str, checkpoint: str, vec: str = "embedding"):
    """Start a query that writes projected vectors to Parquet, exactly once."""
    return model.transform(stream, vec).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
