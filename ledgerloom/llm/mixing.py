"""Mixing sources to target weights by hash-threshold histograms.

Sources share a budget by weight, none beyond MAX_REPEATS times its size. Each row has a uniform 60-bit
hash: 36 bits of its doc_id, then 12 of its text and 12 of its place in the table, which tell rows apart that share
an id or have none. A source takes every document ``floor(target / size)`` times, and once more those whose
hash lies below the source's threshold. The threshold comes from sums of words by hash bucket: whole
buckets below the boundary are taken, and only the boundary bucket is split into finer buckets, level
by level, until it holds one hash. Nothing is sorted, and each pass sends at most BUCKETS rows per
source and task.

Defined results: a null text has size 0; sources go by code point with null last and null is a source
of its own; an empty table gives an empty result; a source without words takes nothing; rows with the
same doc_id (null too) are rows of their own, so a source's sum comes near its target whatever its ids. Same
input, same result; only which of the rows alike in id and text are taken, never how many, hangs on how files are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, n_words_of, packed, stored

WEIGHTS = (3, 1, 2)
SHARE, MAX_REPEATS = 1.5, 2
#: A hash has 15 hex digits, 9 of them from the id, and a level reads 3 of them.
DIGITS, ID_DIGITS, PER_LEVEL = 15, 9, 3
BUCKETS = 16**PER_LEVEL


def hash60(doc_id: Column, text: Column) -> Column:
    """Uniform 60 bits: of md5 of the id, the same in any engine, then of the text and of the row's place."""
    of_id = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, ID_DIGITS), 16, 10).cast("long")
    of_row = F.pmod(F.xxhash64(text), F.lit(BUCKETS)) * BUCKETS + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(BUCKETS))
    return F.shiftleft(of_id, 4 * (DIGITS - ID_DIGITS)) + of_row


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size): water filling in closed form.

    By growing ``size / weight`` the capped sources come first; source i is capped if what the ones
    before it left, shared by the weights that remain, exceeds its cap. The windows run over one row per
    source, never over documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    at = by.withColumn("w", weight.cast("double")).withColumn("cap", cap * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    at = at.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    at = at.withColumn("level", F.col("left") / F.col("w_left"))
    at = at.withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    # past the last capped source the level stays
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return at.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def thresholds(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, below): per source the hash below which documents are taken once more.

    ``hashed``: (source, size, h); ``wanted``: (source, rest) words to take. A document at the boundary
    is taken if that brings the sum nearer to ``rest``.
    """
    # lo: the prefix reached so far; got: words below it; of a done source it is final
    state = wanted.select("source", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("got"))
    for level in range(DIGITS // PER_LEVEL):
        width = 16 ** (DIGITS - (level + 1) * PER_LEVEL)
        small = broadcast_if_small(state.withColumnRenamed("source", "s"), 100_000)
        inside = hashed.join(small, F.col("source").eqNullSafe(F.col("s"))).where(
            (F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < F.lit(width * BUCKETS))
        )
        bucket = F.shiftright(F.col("h") - F.col("lo"), 4 * (DIGITS - (level + 1) * PER_LEVEL))
        sums = inside.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"), F.first("lo").alias("lo"), F.first("got").alias("got"), F.first("rest").alias("rest"))
        run = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("after", F.col("got") + F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
        # the boundary: the first bucket whose end reaches what is wanted
        hit = sums.where("after >= rest").groupBy("source").agg(F.min_by(F.struct("b", "before"), "b").alias("x"))
        hit = hit.select(F.col("source").alias("s2"), "x.b", "x.before")
        state = stored(
            state.join(hit, F.col("source").eqNullSafe(F.col("s2")), "left").select(
                "source",
                "rest",
                F.when(F.col("b").isNull(), F.col("lo") + F.lit(width * (BUCKETS - 1))).otherwise(F.col("lo") + F.col("b") * F.lit(width)).alias("lo"),
                F.coalesce("before", "got").alias("got"),
            ),
            "mix-state",
        )
    # lo is now one hash: with it or without it, whichever is nearer
    small = broadcast_if_small(state.withColumnRenamed("source", "s"), 100_000)
    edge = hashed.join(small, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("lo"))).groupBy("source").agg(F.sum("size").alias("edge"))
    edge = edge.withColumnRenamed("source", "s2")
    both = state.join(edge, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("edge", F.coalesce("edge", F.lit(0)))
    take = (F.col("rest") > 0) & (F.abs(F.col("got") + F.col("edge") - F.col("rest")) <= F.abs(F.col("got") - F.col("rest")))
    return both.select("source", (F.col("lo") + F.when(take, 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, h, source): a row per document, ``times`` it is to be repeated."""
    hashed = stored(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h")), "mix")
    goal = stored(targets(hashed, weights, share, cap), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("full", full.cast("long")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    cut = thresholds(hashed, goal.select("source", "rest")).select(F.col("source").alias("s3"), "below")
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3").withColumnRenamed("source", "s")
    out = hashed.join(broadcast_if_small(stored(plan, "mix-plan"), 100_000), F.col("source").eqNullSafe(F.col("s")))
    times = F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "h", "source")


def take_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> DataFrame:
    """``docs`` as the mix takes them: left out, once or repeated. A filter on the hash, so texts aren't shuffled."""
    plan = mix(docs, weights, share, cap).groupBy("source").agg(
        F.min("times").alias("lo"), F.max("times").alias("hi"), F.max(F.struct("times", "h")).alias("x")
    )
    # per source: everything lo times, and hi times up to the largest hash that is taken so often
    plan = stored(plan.select(F.col("source").alias("__s"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("x.h").alias("__h")), "mix-take")
    at = packed(docs, "source", hash60(F.col("doc_id"), F.col("text")).alias("__own"))
    at = at.join(broadcast_if_small(plan, 100_000), F.col("source").eqNullSafe(F.col("__s")))
    times = F.when(F.col("__own") <= F.col("__h"), F.col("__hi")).otherwise(F.col("__lo"))
    return at.select("doc", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("doc.*")
