"""Keyed tables that a stream keeps up by changes.

A view is a folder of commits as in sources/log.py, with Parquet in place of lines: each batch commits the rows of the keys
that it touches and nothing else, a deleted key as a row that is marked. A reader takes the last row of each key. When the
changes since the last compaction hold more than `share` of the view's bytes, the view is compacted: its rows are written
anew, and what they stand for is deleted once it is `retain` seconds old. So a batch writes as many rows as it touches
keys, and compactions at most 1 / share times that.

A batch that is run again after a failure commits nothing a second time: its number is in its commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import log
from ..sources.tables import last_rows


class View:
    """The table behind a folder; key and order name columns of schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, share: float = 0.5, retain: float = 3600.0) -> None:
        self.spark, self.path, self.key, self.order, self.share, self.retain = spark, path, key, order, share, retain
        self.schema = f"{schema}, __gone boolean"
        self.folder = log.Folder(spark, path)

    def said(self, number: int) -> dict:
        return json.loads(self.folder.read(f"commits/{number:020d}"))

    def size(self, folder: str) -> int:
        return self.folder.fs.getContentSummary(self.folder.at(f"data/{folder}")).getLength()

    def table(self) -> DataFrame:
        """The view as it is now."""
        return self.rows(log.commits(self.folder)).filter("not __gone").drop("__gone")

    def rows(self, known: list[log.Commit]) -> DataFrame:
        """The last row of each key in these commits."""
        if not known:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{c.folder}" for c in known])
        order = self.spark.createDataFrame([(c.folder, c.upto) for c in known], "__folder string, __number long")
        # of one order the later commit counts, so a change to a row needs no greater one
        read = read.withColumn("__folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(order), "__folder").drop("__folder")
        return last_rows(read, [self.key], [self.order, "__number"]).drop("__number")

    def merge(self, changes: DataFrame, gone: Column | None = None, batch: int | None = None) -> None:
        """Commits the last change of each key; gone tells which changes delete theirs."""
        if batch is not None and any(self.said(int(n)).get("batch", -1) >= batch for n in self.folder.names("commits")[-1:]):
            return
        rows = last_rows(changes.withColumn("__gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)), [self.key], [self.order])
        at = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{at}")
        log.commit(self.folder, {"folder": at} | ({} if batch is None else {"batch": batch}))
        self.settle(batch)

    def settle(self, batch: int | None = None) -> None:
        """Compacts the view if its changes have grown beyond their share."""
        known = log.commits(self.folder)
        base = [c for c in known if c.compact]
        changes = [c for c in known if not c.compact]
        if len(changes) > 1 and sum(self.size(c.folder) for c in changes) > self.share * sum(self.size(c.folder) for c in base):
            at = uuid.uuid4().hex
            self.rows(known).filter("not __gone").write.parquet(f"{self.path}/data/{at}")
            log.commit(self.folder, {"folder": at, "upto": max(c.upto for c in known)} | ({} if batch is None else {"batch": batch}))
            log.vacuum(self.spark, self.path, self.retain)


def kept_up(stream: DataFrame, path: str, key: str, order: str, gone: Column | None = None, **settings: float) -> View:
    """Runs a stream of changes over what its source has now into the view at path; gives the view."""
    spark = stream.sparkSession
    view = View(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), key, order, **settings)
    q = stream.writeStream.foreachBatch(lambda batch, number: view.merge(batch, gone, number)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return view


def counted(stream: DataFrame, path: str, key: str, **settings: float) -> View:
    """Runs a count of rows by key, kept up in a view: each batch only emits the keys whose count it changes."""
    counts = stream.groupBy(key).agg(F.count("*").alias("n"))
    spark = stream.sparkSession
    view = View(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields), key, "n", **settings)
    q = counts.writeStream.foreachBatch(lambda batch, number: view.merge(batch, None, number)).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return view


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
