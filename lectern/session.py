"""Sessions and the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lectern", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds to it, with __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.python.filterPushdown.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where it is unset, a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    spark.conf.set("spark.checkpoint.dir", known)
    return known


def kept(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """df, written to the shared folder and read again; columns `folders` come last in it and have a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by kept() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:  # of a table with folders, each of them
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
