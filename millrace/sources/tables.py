"""Corpora that already are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_source(
    spark: SparkSession, path: str, columns: list[str] | None = None, spread_by: str | None = None
) -> DataFrame:
    """Read only ``columns`` of a Parquet table.

    A table of fewer files than there are cores is spread by the hash of
    ``spread_by`` so that the work on its rows runs in parallel; a table of
    many files is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if spread_by and len(df.inputFiles()) < cores:
        df = df.repartition(cores, F.col(spread_by))
    return df
