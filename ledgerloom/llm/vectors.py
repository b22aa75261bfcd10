"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors fall into buckets of TABLES tables; a bucket is PROJECTIONS random Gaussian
projections, shifted and quantised to WIDTH. Vectors that share a bucket and a label are compared
exactly, in double precision. At the threshold (cosine 0.93, distance 0.374) one projection agrees with
probability 0.80, so a pair is met with probability 1 - (1 - 0.80**6)**18 = 0.996, and at 0.95 with 0.9993.

Exact copies are one vector with a count, named by a number of its own, so that ids may be repeated, null or of any
type that has an order. A large bucket is split into blocks, and pairs of blocks are compared as matrices, so no task
holds more than two blocks. Pairs are never rows: a comparison sends each vector's number of new links and, per
connected part, one edge a vector. A pair counts in the first table where it meets; in later tables the many
vectors of a bucket that shared a bucket of the first one stand in blocks of their own, which aren't met with each other
again, so a dense core is compared once and not in every table.

Defined results: null, zero, or partly null or non-finite vectors and null labels link with nothing,
nor do vectors of different length; repeated rows are copies and link, also under one id: n_links counts rows. The
smallest id that isn't null names a component; where all are null it is null. A row is kept if its id is that
name, so rows that repeat it are all kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

COSINE = 0.93
TABLES, PROJECTIONS, WIDTH = 18, 6, 1.5
BLOCK, VECTOR_BATCH = 512, 4096
SEED = 7


def buckets(x: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """(rows, tables) bucket numbers of normalised vectors."""
    rng = np.random.default_rng(SEED + x.shape[1])
    a = rng.normal(size=(x.shape[1], tables * projections))
    cell = np.floor((x @ a + rng.uniform(0, width, tables * projections)) / width).astype(np.int64).reshape(len(x), tables, projections)
    mix = rng.integers(1, 2**62, (tables, projections)) * 2 + 1
    return (cell * mix).sum(axis=2)


def usable(embedding: str = "embedding", label: str = "label") -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index in each index's connected part, by repeated minimum over the links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(table: int, ids: np.ndarray, x: np.ndarray, cnt: np.ndarray, b: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New links among one group's vectors: positions, weights of partners, and edges. side: 0 or 1 of two blocks, or 2 of a block met with itself."""
    two = bool((side < 2).any())
    left = np.flatnonzero(side == 0 if two else side == 2)
    right = np.flatnonzero(side == 1) if two else left
    add, ii, jj = np.zeros(len(ids), np.int64), [], []
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        r, c = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[r], right[c]
        if not two:
            i, j = i[i < j], j[i < j]
        if table and len(i):
            new = ~(b[i, :table] == b[j, :table]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(add, i, cnt[j])
        np.add.at(add, j, cnt[i])
        ii.append(i)
        jj.append(j)
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ii, jj))
    some = np.flatnonzero(add)
    low = _parts(len(ids), i, j)
    return ids[some], add[some], ids[some], ids[low[some]]


def _blocks(reps: DataFrame) -> DataFrame:
    """(rid, t, key, p, q, side): each vector of reps (rid, lab, x, b) in every pair of blocks of its buckets that are to be compared.

    Of a bucket with more than BLOCK vectors those that shared a bucket of the first table (their home) are in blocks
    of their own if they are many, and such blocks of one home don't meet in later tables.
    """
    own = F.xxhash64("lab", F.length("x"))
    keys = reps.select("rid", own.alias("own"), F.xxhash64(own, F.lit(0), F.col("b")[0]).alias("home"), F.posexplode("b").alias("t", "bucket"))
    keys = keys.select("rid", "t", F.xxhash64("own", "t", "bucket").alias("key"), "home")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    met = keys.join(sizes, F.col("key") == F.col("k")).drop("k")
    small = met.where(F.col("n") <= BLOCK).select("rid", "t", "key", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(2).alias("side"))
    large = met.where(F.col("n") > BLOCK)
    homes = large.groupBy("key", "home").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select(F.col("key").alias("k"), F.col("home").alias("hm"), "m")
    large = large.join(homes, (F.col("key") == F.col("k")) & (F.col("home") == F.col("hm")), "left")
    alone = F.xxhash64("home", F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / BLOCK)))
    label = F.when(F.col("m").isNull(), F.pmod(F.xxhash64("home"), F.ceil(F.col("n") / BLOCK))).otherwise(alone)
    large = large.select("rid", "t", "key", label.cast("long").alias("label"), F.col("hm").alias("core"))
    # blocks are few: one for BLOCK vectors or so
    labels = large.select("key", "t", "label", "core").distinct()
    a, b = (labels.select(F.col("key").alias(f"k{x}"), F.col("t").alias(f"t{x}"), F.col("label").alias(f"l{x}"), F.col("core").alias(f"c{x}")) for x in "ab")
    again = (F.col("ta") > 0) & F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    pairs = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("la") <= F.col("lb"))).where(~again).select("ka", "la", "lb")
    one = pairs.where("la = lb").select("ka", F.col("la").alias("l"), "la", "lb", F.lit(2).alias("side"))
    two = pairs.where("la < lb").select("ka", F.explode(F.array(F.struct(F.col("la").alias("l"), F.lit(0).alias("side")), F.struct(F.col("lb").alias("l"), F.lit(1).alias("side")))).alias("x"), "la", "lb")
    pairs = one.unionByName(two.select("ka", "x.l", "la", "lb", "x.side"))
    large = large.join(pairs, (F.col("key") == F.col("ka")) & (F.col("label") == F.col("l")))
    return small.unionByName(large.select("rid", "t", "key", F.col("la").alias("p"), F.col("lb").alias("q"), "side"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label", usable().alias("ok"))
    same = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), F.col("label").cast("string").alias("lab")]
    rows = stored(rows.select("vec_id", "ok", *same, F.when(F.col("ok"), F.col("embedding").cast("array<double>")).alias("e")), "vec")
    reps = rows.where("ok").groupBy("h1", "h2", "lab").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("cnt"), F.first("e").alias("e"))
    reps = reps.select("h1", "h2", "lab", "first_id", "cnt", "e")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.to_pandas()
            for _, part in p.groupby(p["e"].map(len)):
                x = np.stack(part["e"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                part = part.assign(x=[v.tobytes() for v in x], b=list(buckets(x)))
                yield pa.RecordBatch.from_arrays([pa.array(part[c], kind) for c, kind in kinds], [c for c, _ in kinds])

    kinds = [("h1", pa.int64()), ("h2", pa.int32()), ("lab", pa.string()), ("place", pa.int64()), ("cnt", pa.int64()), ("x", pa.binary()), ("b", pa.list_(pa.int64()))]
    # the number of a distinct vector is its place in the stored table
    reps = stored(reps, "vec-distinct").withColumn("place", F.monotonically_increasing_id())
    reps = stored(reps, "vec-numbered")
    names = reps.select(F.col("place").alias("rid"), "first_id", "h1", "h2", "lab", "cnt")
    reps = reps.select("h1", "h2", "lab", "place", "cnt", "e").mapInArrow(hashed, "h1 long, h2 int, lab string, place long, cnt long, x binary, b array<long>")
    reps = stored(reps.withColumnRenamed("place", "rid").drop("h1", "h2"), "vec-reps", VECTOR_BATCH)
    full = _blocks(reps).withColumnRenamed("rid", "r").join(reps.select("rid", "cnt", "x", "b"), F.col("r") == F.col("rid")).drop("r")
    full = full.select("key", "p", "q", "t", "side", "rid", "cnt", "x", "b")
    full = full.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(p: pd.DataFrame) -> pa.RecordBatch | None:
            got = []
            if len(p):
                x, b = np.stack([np.frombuffer(v) for v in p["x"]]) if p["x"].map(len).nunique() == 1 else None, np.stack(p["b"].to_numpy())
                ids, cnt, side, t = (p[c].to_numpy() for c in ("rid", "cnt", "side", "t"))
                k = p[["key", "p", "q"]].to_numpy()
                cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
                for lo, hi in zip([0, *cut], [*cut, len(p)], strict=True):
                    if hi - lo > 1:
                        xs = x[lo:hi] if x is not None else np.stack([np.frombuffer(v) for v in p["x"].iloc[lo:hi]])
                        got.append(_compare(int(t[lo]), ids[lo:hi], xs, cnt[lo:hi], b[lo:hi], side[lo:hi], cosine))
            if not got:
                return None
            cols = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*got, strict=True)]
            return pa.RecordBatch.from_arrays([cols[0], cols[1], cols[3]], ["rid", "add", "low"])

        held = pd.DataFrame()
        for batch in batches:
            p = pd.concat([held, batch.to_pandas()], ignore_index=True)
            last = p.iloc[-1]
            open_ = (p["key"] == last["key"]) & (p["p"] == last["p"]) & (p["q"] == last["q"])
            held = p[open_]  # at most two blocks
            if (out := done(p[~open_])) is not None:
                yield out
        if (out := done(held)) is not None:
            yield out

    found = stored(full.mapInArrow(links, "rid long, add long, low long"), "vec-links", VECTOR_BATCH)
    counts = found.groupBy("rid").agg(F.sum("add").alias("links"))
    parts = connected_components(found.select(F.col("rid").alias("a"), F.col("low").alias("b")))
    one = names.join(counts, "rid", "left").join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid"))
    first = one.groupBy("c").agg(F.min("first_id").alias("component_id"))
    one = one.join(first, "c").select("h1", "h2", F.col("lab").alias("l2"), (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), "component_id")
    out = rows.drop("e").withColumnRenamed("h1", "a1").withColumnRenamed("h2", "a2")
    out = out.join(one, (F.col("a1") == F.col("h1")) & (F.col("a2") == F.col("h2")) & (F.col("lab") == F.col("l2")) & F.col("ok"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
