"""Keyed tables that change in place: rows are dealt to buckets by a hash of their key, and a batch rewrites only the buckets of its keys.

A write replaces whole buckets (dynamic partition overwrite). One that breaks off leaves some buckets new and some old;
doing the batch again puts that right, as long as merging a batch into what it left gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import stored

BUCKETS = 64


def bucket_of(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """A keyed table of ``rows``, in place of whatever lay under ``path``."""
    _write(rows.withColumn("bucket", bucket_of(key, buckets)), path, "static")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of a keyed table of that ``schema``, of all buckets or only some."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))).drop("bucket")


def touched(keys: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets of the ``keys``: ``buckets`` numbers at most."""
    return sorted(r["b"] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def update(path: str, new: DataFrame, key: Sequence[str], schema: T.StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Replace the buckets that ``new`` rows fall into by ``merge(old, new)`` of them; gives the buckets back.

    ``merge`` is any of the keyed merges of ``changes``: of the rows of some buckets it gives the rows of those buckets.
    """
    new = stored(new, "keyed-new")
    numbers = touched(new, key, buckets)
    if numbers:
        merged = merge(read(new.sparkSession, path, schema, numbers), new)
        # what is read is overwritten, so it is written elsewhere first; a bucket that loses all its rows isn't replaced
        rows = stored(merged.select(*schema.names).withColumn("bucket", bucket_of(key, buckets)), "keyed-merged")
        _write(rows, path, "dynamic")
    return numbers
