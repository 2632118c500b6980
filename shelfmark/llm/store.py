"""Intermediate tables in the folder all executors share, and bounds on what Python is sent at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfmark.sources.scratch import discard, materialise, shared_dir

__all__ = ["bounded_batches", "discard", "materialise", "shared_dir"]


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches between the JVM and Python hold about so many bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
