"""A lasting vector index: cells around centres, exact nearest vectors by bounds on the sphere, runs that replace and purge.

Vectors are scaled to length one and filed in the cell of their nearest centre; within a cell they are sorted by their
angle to it and cut into blocks, so that a block is a ring around its centre. By the triangle inequality no vector of a
ring is nearer to a query than the query's angle to the centre allows. A query first opens the most promising rings,
then those whose bound reaches its last hit's cosine. Queries are a table: they are joined with the blocks they open,
many of them at a time, and multiplied as matrices.

Centres are fitted on a bounded sample (SAMPLE vectors); every vector is filed, and hits are exact whatever the centres.

Under the path lie ``centres`` (a row a cell), ``blocks/segment=r``, ``places/segment=r/part=p`` (where each id stands),
``deleted/run=r`` and ``runs/run=r``, written like the parts of the keyword index: a run that is done again replaces its
own parts, and one that broke off is never read.

Defined results: ids of any type; vectors that are null, of another length than the index's or with null or non-finite
components are left out, as are such queries; a zero vector has cosine 0 with all; of an id given twice in a run the
greatest vector is taken; null ids are left out; ties go by id.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import broadcast_if_small
from ..functions.tables import stored
from .keyword_index import bucket_of, read_parts
from .search import MAX_TERMS, best, ranked

#: Centres at most, vectors that they are fitted on at most, and rounds of fitting.
MAX_CELLS, SAMPLE, ROUNDS = 1024, 16_384, 6
#: Vectors of a block, queries multiplied with it at once, and parts that ids are dealt to.
BLOCK, QUERIES, BUCKETS = 1024, 256, 32
#: A query opens rings that hold so many times the wanted hits before it knows a bound.
EARLY = 4
#: Cosines near one lose half their digits as angles.
SLACK = 1e-6

_RUN = "segments array<bigint>, changes array<bigint>, buckets int, dims int, id_type string"
_DELETED = "segment bigint, block bigint, place int, run bigint"


@dataclasses.dataclass(frozen=True)
class State:
    run: int
    segments: list[int]
    changes: list[int]
    buckets: int
    dims: int
    id_type: str


def state(spark: SparkSession, path: str, before: int | None = None) -> State:
    """The index as its last run left it, or the last one ``before`` a run."""
    runs = spark.read.schema(f"{_RUN}, run bigint").parquet(f"{path}/runs")
    last = (runs if before is None else runs.where(F.col("run") < before)).orderBy(F.desc("run")).first()
    if last is None:
        raise ValueError(f"no index under {path}")
    return State(**last.asDict())


def _blocks(spark: SparkSession, path: str, at: State) -> DataFrame:
    return read_parts(spark, path, "blocks", "segment", at.segments, f"cell int, block bigint, n int, lo double, hi double, ids array<{at.id_type}>, matrix binary, segment bigint")


def _row(first: T.StructField | None, others: str) -> T.StructType:
    """A row's type: a field as a table has it, and others."""
    return T.StructType(([first] if first else []) + T.StructType.fromDDL(others).fields)


def usable(vector: str) -> Column:
    """Whether a vector has finite components only."""
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def unit_rows(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay zero."""
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.where(top > 0, x / np.where(top > 0, top, 1), 0)  # so that squares neither overflow nor vanish
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the rows of ``x`` by spherical k-means from evenly spread rows."""
    x = x[np.abs(x).max(axis=1) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MAX_CELLS at most
    return np.array([r["centre"] for r in rows], np.float64)


def _write_segment(path: str, run: int, vectors: DataFrame, centres: np.ndarray, at: State) -> None:
    """Blocks and places of (id, vector), one row an id."""
    spark, dims = vectors.sparkSession, at.dims
    shared = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = unit_rows(batch.column(1), dims)
            cos = x @ c.T if len(c) else np.zeros((len(x), 1))
            cell = np.where(np.abs(x).max(axis=1, initial=0) > 0, cos.argmax(axis=1), -1)
            angle = np.where(cell < 0, np.pi / 2, np.arccos(np.clip(cos.max(axis=1), -1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(angle), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "cell", "angle", "x"])

    kind = _row(vectors.schema["id"], "cell int, angle double, x binary")
    filed = stored(vectors.select("id", "vector").mapInArrow(file, kind), "vector-cells")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(p: list[list]) -> pa.RecordBatch:
            cells = np.array(p[1])
            edge = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            spans = [(i, min(i + BLOCK, b)) for a, b in zip(edge, edge[1:]) for i in range(a, b, BLOCK)]
            cols = [[p[1][i] for i, _ in spans], [j - i for i, j in spans], [p[2][i] for i, _ in spans], [p[2][j - 1] for _, j in spans], [p[0][i:j] for i, j in spans], [b"".join(p[3][i:j]) for i, j in spans]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["cell", "n", "lo", "hi", "ids", "matrix"])

        held: list[list] = [[], [], [], []]
        types = None
        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(batch.schema.field(0).type), pa.binary()]
            held = [h + batch.column(i).to_pylist() for i, h in enumerate(held)]
            full = len(held[0]) // BLOCK * BLOCK
            if full:
                yield rows([h[:full] for h in held])
                held = [h[full:] for h in held]
        if held[0]:
            yield rows(held)

    # a cell with a third of all vectors is dealt to many tasks by angle and id
    line = filed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
    kind = _row(None, f"cell int, n int, lo double, hi double, ids array<{at.id_type}>, matrix binary")
    line.mapInArrow(cut, kind).withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/blocks/segment={run}")
    blocks = _blocks(spark, path, dataclasses.replace(at, segments=[run]))
    places = blocks.select("block", F.posexplode("ids").alias("place", "id")).withColumn("part", bucket_of(F.col("id"), at.buckets))
    places.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/places/segment={run}")


def _write_run(spark: SparkSession, path: str, at: State) -> None:
    row = [tuple(getattr(at, f.name) for f in dataclasses.fields(State) if f.name != "run")]
    spark.createDataFrame(row, _RUN).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run={at.run}")


def _clean(vectors: DataFrame, dims: int) -> DataFrame:
    rows = vectors.where(F.col("id").isNotNull() & usable("vector")).select("id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.where(F.size("vector") == dims).groupBy("id").agg(F.max("vector").alias("vector"))


def build(vectors: DataFrame, path: str, run: int = 0, dims: int | None = None, cells: int | None = None, buckets: int = BUCKETS) -> None:
    """An index of ``vectors`` (id, vector) alone. ``dims``: their length, else that of most of them."""
    spark = vectors.sparkSession
    sizes = vectors.where(usable("vector")).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = dims or (sizes["d"] if sizes else 1)
    rows = _clean(vectors, dims)
    n = sizes["count"] if sizes else 0
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    centres = fit_centres(unit_rows(sample, dims), cells or min(MAX_CELLS, max(1, int(n**0.5))))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    at = State(run, [run], [run], buckets, dims, vectors.schema["id"].dataType.simpleString())
    spark.createDataFrame([], "segment bigint, block bigint, place int").write.mode("overwrite").parquet(f"{path}/deleted/run={run}")
    _write_segment(path, run, rows, centres, at)
    _write_run(spark, path, at)


def update(path: str, run: int, changed: DataFrame, purged: DataFrame | None = None) -> None:
    """Run ``run`` over an index: ``changed`` (id, vector) replace those of their ids or are new, ``purged`` ids go.

    An id whose new vector can't be filed loses its old one.
    """
    spark = changed.sparkSession
    at = state(spark, path, before=run)
    stale = changed.select("id") if purged is None else changed.select("id").unionByName(purged.select(F.col("id").cast(at.id_type)))
    stale = stored(stale.where("id is not null").distinct().withColumn("part", bucket_of(F.col("id"), at.buckets)), "vector-stale")
    parts = [r["part"] for r in stale.select("part").distinct().collect()]  # ``buckets`` numbers at most
    places = read_parts(spark, path, "places", "segment", at.segments, f"block bigint, place int, id {at.id_type}, segment bigint, part int").where(F.col("part").isin(parts))
    dead = places.join(broadcast_if_small(stale.select("id"), MAX_TERMS), "id", "left_semi").select("segment", "block", "place")
    known = read_parts(spark, path, "deleted", "run", at.changes, _DELETED).drop("run")
    dead.join(broadcast_if_small(known, MAX_TERMS), ["segment", "block", "place"], "left_anti").write.mode("overwrite").parquet(f"{path}/deleted/run={run}")
    _write_segment(path, run, _clean(changed, at.dims), _centres(spark, path), at)
    _write_run(spark, path, dataclasses.replace(at, run=run, segments=[*at.segments, run], changes=[*at.changes, run]))


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, id, score, rank) of ``queries`` (query_id, vector): the ``top`` greatest cosines of all vectors, and (query_id, opened) with the blocks read."""
    at = state(spark, path)
    dims = at.dims
    blocks = _blocks(spark, path, at)
    heads = blocks.select("segment", "block", "cell", "n", "lo", "hi")
    rings = heads.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()  # a row a cell
    centres = _centres(spark, path)
    shared = spark.sparkContext.broadcast((centres, np.array([r["cell"] for r in rings], np.int64), *(np.array([r[c] for r in rings], np.float64) for c in ("lo", "hi", "n"))))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in unit_rows(batch.column(1), dims)], pa.binary())], ["query_id", "q"])

    asked = queries.where(usable("vector")).select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dims)
    asked = stored(asked.mapInArrow(unit, _row(queries.schema["query_id"], "q binary")), "vector-queries")
    n_asked = asked.count()

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, cell, angle, least) of the cells that can hold hits: all that reach ``least``, or without it the nearest that hold enough vectors."""
        c, cell, lo, hi, n = shared.value
        for batch in batches:
            for at_row in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at_row, QUERIES)
                q = np.array([np.frombuffer(x) for x in part.column(1).to_pylist()]).reshape(-1, dims)
                cos = np.where(cell < 0, 0.0, (q @ c.T)[:, np.maximum(cell, 0)] if len(c) else 0.0) if len(cell) else np.zeros((len(q), 0))
                angle = np.arccos(np.clip(cos, -1, 1))
                bound = np.cos(np.maximum(0, np.maximum(angle - hi, lo - angle)))
                bound = np.where(cell < 0, 0.0, bound)
                least = part.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < EARLY * top, axis=1)
                r, k = np.nonzero(np.where(np.isnan(least)[:, None], first, bound + SLACK >= least[:, None]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(cell[k], pa.int32()), pa.array(angle[r, k]), pa.array(least[r])], ["query_id", "cell", "angle", "least"])

    def opened_by(rows: DataFrame) -> DataFrame:
        """(query_id, segment, block, bound, n, least) of the blocks in the cells that queries (query_id, q, least) reach."""
        kind = _row(queries.schema["query_id"], "cell int, angle double, least double")
        reached = rows.select("query_id", "q", "least").mapInArrow(cells_of, kind)
        gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("hi"), F.col("lo") - F.col("angle"))
        bound = F.when(F.col("cell") < 0, 0.0).otherwise(F.cos(gap))
        return reached.join(heads, "cell").select("query_id", "segment", "block", "n", bound.alias("bound"), "least")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, raw, ids, matrix, dead = (batch.column(i)[row] for i in range(5))
                x = np.frombuffer(matrix.as_py()).reshape(-1, dims)
                s = np.frombuffer(b"".join(raw.as_py())).reshape(-1, dims) @ x.T
                if dead.is_valid:
                    s[:, dead.as_py()] = -np.inf
                # ties at a block's last place stay, since ids decide them
                least = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else s.min(axis=1)
                r, k = np.nonzero((s >= least[:, None] - 1e-9) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([names.values.take(pa.array(r)), ids.values.take(pa.array(k)), pa.array(s[r, k])], ["query_id", "id", "score"])

    gone = read_parts(spark, path, "deleted", "run", at.changes, _DELETED).groupBy("segment", "block").agg(F.collect_list("place").alias("dead"))

    def hits_in(opened: DataFrame) -> DataFrame:
        """The best of the opened blocks; a block meets its queries many at a time."""
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_asked // QUERIES))))
        groups = opened.join(asked, "query_id").groupBy("segment", "block", chunk.alias("chunk")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        rows = groups.join(blocks.select("segment", "block", "ids", "matrix"), ["segment", "block"]).join(gone, ["segment", "block"], "left")
        kind = _row(queries.schema["query_id"], f"id {at.id_type}, score double")
        got = rows.select("qs.query_id", "qs.q", "ids", "matrix", "dead").mapInArrow(product, kind)
        return best(got.withColumn("score", F.round("score", 9)), top)

    # rings that are nearest and hold enough vectors, then all that reach the last hit of those
    near = opened_by(asked.withColumn("least", F.lit(float("nan"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
    near = near.withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < EARLY * top)
    near = stored(near.select("query_id", "segment", "block"), "vector-near")
    early = stored(hits_in(near), "vector-early")
    least = early.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("k")).where(F.col("k") >= top).select("query_id", "least")
    rows = asked.join(broadcast_if_small(least, MAX_TERMS), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    later = opened_by(rows).where(F.col("bound") + SLACK >= F.col("least")).join(near, ["query_id", "segment", "block"], "left_anti")
    later = stored(later.select("query_id", "segment", "block"), "vector-later")
    hits = ranked(early.unionByName(hits_in(later)), top).select("query_id", "id", "score", "rank")
    return hits, near.unionByName(later).groupBy("query_id").agg(F.count("*").alias("opened"))
