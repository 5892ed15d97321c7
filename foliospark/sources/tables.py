"""Table scans. Everything goes through Spark's readers, so any store Spark can read will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; columns are pruned by whatever reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
