"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_views(spark: SparkSession, folder: str) -> None:
    """All tables as temporary views, for SQL."""
    for name in NAMES:
        table(spark, folder, name).createOrReplaceTempView(name)
