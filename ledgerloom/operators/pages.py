"""Sorted tables that are read a page at a time: ranges of the order as parts, so that a page opens the one or two that it lies in.

Under a path lie ``rows/part=p``, the rows of one range in order with their place in it, and ``parts``, a row a part with
the number of its rows and of those before it, and its first and last key. A page by number counts nothing and sorts
nothing but its own parts; a page behind a key needs no count at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(rows: DataFrame, order: Sequence[Column], key: str, path: str, parts: int | None = None) -> None:
    """``rows`` in ``order``, of which ``key`` is a column that tells them apart (or the first of them do)."""
    line = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    line = line.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    line.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    kept = _rows(rows.sparkSession, path, rows.schema)
    ends = kept.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row a part
    ends.withColumn("before", before.cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType())])).parquet(f"{path}/rows")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts")


def page(spark: SparkSession, path: str, schema: T.StructType, limit: int = 100, offset: int = 0, most: int = 1000) -> tuple[DataFrame, int, bool]:
    """One page in order, the total, and whether more follows; limits as in ``catalog.page``."""
    n, skip = min(max(limit, 1), most), max(offset, 0)
    parts = _parts(spark, path)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = parts.where((F.col("before") < skip + n) & (F.col("before") + F.col("n") > skip)).select("part", "before").collect()  # n parts at most
    rows = _rows(spark, path, schema).where(F.col("part").isin([r["part"] for r in wanted]))
    base = min((r["before"] for r in wanted), default=0)
    return rows.orderBy("part", "place").offset(skip - base if wanted else 0).limit(n).drop("place", "part"), total, skip + n < total


def page_after(spark: SparkSession, path: str, schema: T.StructType, key: str, after: object, limit: int = 100, most: int = 1000) -> DataFrame:
    """The ``limit`` rows behind the one with the key ``after``, in ascending order of the key; the first ones if it is None."""
    n = min(max(limit, 1), most)
    parts = _parts(spark, path) if after is None else _parts(spark, path).where(F.col("last") > F.lit(after))
    # parts that hold n rows behind the key, besides the one in which it stands
    run = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)) - F.first("n").over(Window.orderBy("part"))
    wanted = parts.withColumn("run", F.coalesce(run, F.lit(0))).where(F.col("run") < n).select("part").collect()
    rows = _rows(spark, path, schema).where(F.col("part").isin([r["part"] for r in wanted]))
    rows = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rows.orderBy("part", "place").limit(n).drop("place", "part")
