"""Tables that jobs write between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's checkpoint folder; a temporary one on one machine (tests), and an error on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root}/{label}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: what is dear or not repeatable runs one time, however many steps read it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, label: str, key: str, buckets: int = 32) -> DataFrame:
    """``df`` written in ``buckets`` buckets by ``key``, sorted in each, and read back as such.

    Tables that are dealt alike by their keys are joined, grouped and numbered by them without a shuffle.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", scratch(spark, label)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the files stay, and ``out`` knows how they are dealt
    return out
