"""Streams over tables that are there: sources, and runs to the end of what a source has now."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import rocksdb
from .views import fresh

T = TypeVar("T")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as (event_id, user_id, at, refused, step): step is the third of the month, in which it arrives."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    return rows.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("refused"), "event_type", F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("step"))


def in_steps(rows: DataFrame, step: Column, steps: int, run: Callable[[DataFrame], T], name: str) -> T:
    """Gives what run(stream) gives after the last of `steps`: each step adds its rows to the folder that the stream reads, and
    run goes on from its checkpoint, as a job that is started again does."""
    spark = rows.sparkSession
    at = fresh(spark, f"{name}-source")
    for i in range(steps):
        rows.filter(step == i).write.mode("append").parquet(at)
        out = run(spark.readStream.schema(rows.schema).parquet(at))
    return out


def appended(stream: DataFrame, at: str) -> DataFrame:
    """Runs a stream over what its source has now, from the checkpoint in `at`; gives all that it has written so far."""
    spark: SparkSession = stream.sparkSession
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
