"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Table ``table`` of ``sf_dir``, cut down to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before heavy per-row work, where a small input came as fewer splits.

    Each task of a large scan already has its share; then nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
