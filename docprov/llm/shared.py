"""Reading tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions.workers import ship
from docprov.sources import files

shared_dir = files.shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, and read from it: its lineage ends there."""
    ship(df.sparkSession)
    return files.written(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
