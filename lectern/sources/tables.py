"""Parquet tables of a folder, as attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import log


class Tables:
    """Tables(spark, folder).orders reads folder/orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def latest_json_lines(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Records of a log of JSON lines (see log.py); blank lines don't count, and the last record of each key wins."""
    return log.latest(spark, path, schema, key)


def last_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def append_json_lines(rows: DataFrame, path: str) -> int:
    """Adds rows to a log of JSON lines that latest_json_lines() reads; gives the append's number."""
    return log.append(rows, path)
