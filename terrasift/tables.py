"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the folder's tables."""
    for name in names or NAMES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
