"""A log of JSON lines with an order: appends get numbers, and the last record of a key wins.

    folder/data/<id>/...        the lines of one append or compaction, written by Spark
    folder/commits/<number>     names the folder of lines; made at once, and only if the number is free

append() writes its lines first and then takes the next free number, so a reader sees an append wholly or not at all, and
of two writers one gets the number and the other the next. What counts as last is the number, then the place in the
append (file, block, line).

compact() writes the last record of each key as of the greatest number that it has read, and commits that as standing for
all numbers up to there; appends made meanwhile come after it. Commits and lines that nothing stands for any more are
deleted by vacuum().

Numbers are taken by a rename that fails if the name exists (a hard link on local disks). A log without commits, such as
one file or a folder that others write, is read in the order of modification times, then names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    number: int
    upto: int  # the number that its lines stand at: its own, or for a compaction the last one it has read
    folder: str
    compact: bool


class Folder:
    """A folder in a store that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age(self, name: str) -> float:
        """Seconds since this file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def created(self, name: str, text: str) -> bool:
        """Makes a file with this text at once, unless there is one of the name."""
        draft = f".{uuid.uuid4().hex}"
        out = self.fs.create(self.at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.at(name).getParent())
        try:
            if self.local:
                plain = lambda n: self.at(n).toUri().getPath()
                try:
                    os.link(plain(draft), plain(name))
                except FileExistsError:
                    return False
                return True
            if self.fs.exists(self.at(name)):
                return False
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            none[0] = self.jvm.java.lang.Enum.valueOf(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
            try:
                context.rename(self.at(draft), self.at(name), none)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        finally:
            self.fs.delete(self.at(draft), False)


def commits(folder: Folder) -> list[Commit]:
    """The commits that count, in order: the compaction that reaches furthest, and the appends after it."""
    all_ = []
    for name in folder.names("commits"):
        if name.isdigit():
            try:
                said = json.loads(folder.read(f"commits/{name}"))
            except Exception as e:
                if "FileNotFound" in str(e):  # vacuumed since it was listed, so a later compaction stands for it
                    continue
                raise
            all_.append(Commit(int(name), said.get("upto", int(name)), said["folder"], "upto" in said))
    base = max((c for c in all_ if c.compact), key=lambda c: (c.upto, c.number), default=None)
    later = sorted(c for c in all_ if not c.compact and (base is None or c.number > base.upto))
    return ([base] if base else []) + later


def commit(folder: Folder, said: dict, before: Callable[[int], None] = lambda n: None) -> int:
    """Takes the next free number for lines that are written; before(n) is called when n is about to be tried."""
    while True:
        taken = [int(n) for n in folder.names("commits") if n.isdigit()]
        number = max(taken, default=-1) + 1
        before(number)
        if folder.created(f"commits/{number:020d}", json.dumps(said)):
            return number


def append(rows: DataFrame, path: str, before: Callable[[int], None] = lambda n: None) -> int:
    """Adds rows to a log; gives the number of the append."""
    folder = Folder(rows.sparkSession, path)
    at = uuid.uuid4().hex
    rows.write.json(f"{folder.path}/data/{at}")
    return commit(folder, {"folder": at}, before)


def within() -> Column:
    """Where a line stands in what is written at once."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def committed(folder: Folder, spark: SparkSession, known: list[Commit]) -> DataFrame:
    """(value, place): the lines of these commits, and a struct that orders them."""
    read = spark.read.text([f"{folder.path}/data/{c.folder}" for c in known])
    rows = read.select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), within().alias("file"))
    # a number for each commit since the last compaction: a small table
    order = spark.createDataFrame([(c.folder, c.upto) for c in known], "folder string, number long")
    return rows.join(F.broadcast(order), "folder").select("value", F.struct("number", "file").alias("place"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): the lines of a log that aren't blank, and a struct that orders them."""
    folder = Folder(spark, path)
    known = commits(folder)
    if known:
        rows = committed(folder, spark, known)
    elif folder.fs.exists(folder.at("commits")):
        rows = spark.createDataFrame([], "value string, place struct<number:long,file:struct<file:string,block:long,line:long>>")
    else:
        rows = spark.read.text(path).select("value", F.struct(F.unix_micros("_metadata.file_modification_time").alias("number"), within().alias("file")).alias("place"))
    return rows.filter(F.trim("value") != "")


def latest(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The last record of each key. Records without a key, and lines that are no record, don't count."""
    rows = lines(spark, path).withColumn("r", F.from_json("value", schema)).filter(f"r.`{key}` is not null")
    # last of a key by a partial aggregate; the log is never sorted
    return rows.groupBy(F.col("r")[key].alias("k")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, schema: str, key: str = "id", before: Callable[[int], None] = lambda n: None) -> int | None:
    """Writes the last record of each key anew, to stand for all appends so far; gives the number, none without appends."""
    folder = Folder(spark, path)
    known = commits(folder)
    if not known:
        return None
    at = uuid.uuid4().hex
    # of what is committed now; appends that come meanwhile aren't read
    rows = committed(folder, spark, known).withColumn("k", F.from_json("value", schema)[key]).filter("k is not null")
    rows.groupBy("k").agg(F.max_by("value", "place").alias("value")).select("value").write.text(f"{folder.path}/data/{at}")
    return commit(folder, {"folder": at, "upto": max(c.upto for c in known)}, before)


def vacuum(spark: SparkSession, path: str, older: float = 86_400.0) -> int:
    """Deletes commits that don't count any more, and lines that no commit names, if they are `older` seconds; gives how many lines' folders."""
    folder = Folder(spark, path)
    live = commits(folder)
    keep = {c.number for c in live} | {max((int(n) for n in folder.names("commits") if n.isdigit()), default=-1)}
    for name in folder.names("commits"):
        if name.isdigit() and int(name) not in keep and folder.age(f"commits/{name}") >= older:
            folder.delete(f"commits/{name}")
    named = {json.loads(folder.read(f"commits/{n}"))["folder"] for n in folder.names("commits") if n.isdigit()}
    gone = [d for d in folder.names("data") if d not in named and folder.age(f"data/{d}") >= older]
    for d in gone:
        folder.delete(f"data/{d}")
    return len(gone)
