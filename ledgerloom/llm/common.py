"""What the operators of this package share: word rules, let-bindings, stored tables, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words: space, \t, \n, \x0b, \x0c, \r.
WS = " \t\n\x0b\x0c\r"
WS_RE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A lambda variable can't be inlined by the optimizer, so nothing is evaluated per element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RE), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def starts(lengths: Column, block: int = 256) -> Column:
    """Sums of what stands before each element, in blocks so that long lists stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    run = lambda xs, start: F.slice(F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 1, F.size(xs))
    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(block)), lambda i: F.slice(lengths, i, block))
    return let(blocks, lambda bs: let(run(F.transform(bs, total), F.lit(0)), lambda at: F.flatten(F.transform(bs, lambda b, k: run(b, F.get(at, k))))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    A session that names none gets a temporary folder if it runs on one machine (tests), and an error on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jvm_dir.get() if jvm_dir.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows while jobs run inside; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a cached or local copy the table outlives a lost executor, and later readers take only
    the columns they name. ``batch_rows`` bounds an Arrow batch of the Python functions in ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with arrow_batches(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def packed(docs: DataFrame, *apart: str | Column) -> DataFrame:
    """``docs`` as one column ``doc`` beside the columns ``apart``, so that no name of its own clashes with an operator's; doc.* gives it back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *apart)


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch of whole texts, since single ones can be very long.
TEXT_BATCH = 512
#: Bytes of text that a Python function works on at once, unless a single text is longer.
TEXT_BYTES = 8 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = TEXT_BYTES, rows: int = TEXT_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds ``rows`` rows at most and texts of about ``limit`` bytes, or a longer one alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count shows at most ``max_rows`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table; component is the smallest node reachable.

    Alternating large-star and small-star steps on DataFrames. Each step is a min per node (combined
    before the shuffle, so a hub costs one row per task) and a join that adaptive execution can split;
    a stored table ends every round, so lineage stays short and a lost executor costs one round at most.
    Nodes without an edge aren't listed.
    """
    cur = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the smallest node around u
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = stored(small, "cc")
        changed = new.exceptAll(cur).limit(1).count() + cur.exceptAll(new).limit(1).count()
        discard(cur)
        cur = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
