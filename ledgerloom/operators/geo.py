"""Geographic hierarchy: roll-ups, boundary joins, polygons, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import broadcast_if_small
from ..functions.tables import stored
from .catalog import strongest_places

MAX_UNITS = 100_000


def expand_places(chosen: DataFrame, units: DataFrame) -> DataFrame:
    """(id): the chosen units and the municipalities of the chosen oblasts, once each."""
    below = units.where("parent is not null").join(chosen.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
    return chosen.select("id").unionByName(below).distinct()


def national(datasets: DataFrame, geo_links: DataFrame) -> DataFrame:
    """Datasets without any place."""
    return datasets.join(geo_links.select(F.col("dataset_id").alias("id")).distinct(), "id", "left_anti")


def _placed(geo_links: DataFrame, units: DataFrame, level: str) -> DataFrame:
    """(dataset_id, region, confidence): each dataset once a region, at its strongest. The hierarchy, some hundred units, is broadcast up to MAX_UNITS."""
    u = broadcast_if_small(units.select(F.col("id").alias("entity_id"), "kind", "parent"), MAX_UNITS)
    target = F.when(F.col("kind") == level, F.col("entity_id")).when((F.lit(level) == "oblast") & (F.col("kind") == "municipality"), F.col("parent"))
    at = strongest_places(geo_links).join(u, "entity_id").withColumn("region", target).where("region is not null")
    return at.groupBy("dataset_id", "region").agg(F.max("confidence").alias("confidence"))


def region_rollup(geo_links: DataFrame, units: DataFrame, level: str = "oblast") -> DataFrame:
    """(region, label, parent, n_datasets, max_confidence, has_data), a row per unit of the level.

    Two steps of groupBy: datasets are made distinct per region first, so the count needs no distinct and a
    capital that half of all datasets name is combined before the shuffle.
    """
    sums = _placed(geo_links, units, level).groupBy("region").agg(F.count("*").alias("n_datasets"), F.max("confidence").alias("max_confidence"))
    every = units.where(F.col("kind") == level).select(F.col("id").alias("region"), "label", "parent")
    out = every.join(sums, "region", "left")
    return out.select("region", "label", "parent", F.coalesce("n_datasets", F.lit(0)).alias("n_datasets"), F.coalesce("max_confidence", F.lit(0.0)).alias("max_confidence"), F.col("n_datasets").isNotNull().alias("has_data"))


def region_members(geo_links: DataFrame, units: DataFrame, region: str, level: str = "oblast", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a region's datasets with their strongest confidence, by id."""
    at = _placed(geo_links, units, level).where(F.col("region") == region)
    return at.orderBy("dataset_id").offset(offset).limit(limit).select("dataset_id", "confidence")


def boundary_counts(boundaries: DataFrame, crosswalk: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every boundary feature with its region's count, 0 where none. boundaries: (feature_id); crosswalk: (entity_id, feature_id)."""
    at = crosswalk.join(rollup.select(F.col("region").alias("entity_id"), "n_datasets"), "entity_id", "left")
    at = at.groupBy("feature_id").agg(F.sum("n_datasets").alias("n"))
    out = boundaries.join(at, "feature_id", "left")
    return out.select("feature_id", F.coalesce("n", F.lit(0)).alias("n_datasets"), (F.coalesce("n", F.lit(0)) > 0).alias("has_data"))


def crosswalk(units: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units matched to boundary features by official code, and those without. units: (id, code); features: (feature_id, code)."""
    found = units.join(features, "code").select(F.col("id").alias("entity_id"), "feature_id", "code")
    return found, units.join(features, "code", "left_anti").select("id", "code")


#: Geometries: polygons of rings of (longitude, latitude) in degrees, the first ring of a polygon its outline and the others its holes.
GEOMETRY = "array<array<array<array<double>>>>"
#: Degrees of a cell of the outlines' index.
CELL = 2.0


def _xyz(points: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(points[..., 0]), np.radians(points[..., 1])
    return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=-1)


def _ring(points: list) -> np.ndarray:
    """A ring's points, the last one not repeating the first."""
    ring = np.array([p[:2] for p in points], float).reshape(-1, 2)
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def _turn(ring: np.ndarray) -> np.ndarray:
    """Change of longitude along each edge, the short way round."""
    return (np.roll(ring[:, 0], -1) - ring[:, 0] + 180) % 360 - 180


def spherical_centroid(geometry: list) -> np.ndarray:
    """Unit vector of the area's centre, holes taken out; of a geometry without area the middle of its points. NaN without points.

    The integral of the position over an area is half the sum, over its border, of each edge's angle along the edge's normal.
    """
    total, every = np.zeros(3), []
    for polygon in geometry or []:
        for number, points in enumerate(polygon or []):
            ring = _ring(points or [])
            if not len(ring):
                continue
            a = _xyz(ring)
            every.append(a)
            normal = np.cross(a, np.roll(a, -1, axis=0))
            size = np.linalg.norm(normal, axis=1)
            angle = np.arctan2(size, (a * np.roll(a, -1, axis=0)).sum(axis=1))
            area = (normal * np.where(size > 0, angle / np.where(size > 0, size, 1), 0)[:, None]).sum(axis=0) / 2
            # outlines count up and holes down, whichever way their points run
            area *= 1 if area @ a.mean(axis=0) >= 0 else -1
            total += -area if number else area
    if np.linalg.norm(total) < 1e-15 and every:
        total = np.concatenate(every).mean(axis=0)
    norm = np.linalg.norm(total)
    return total / norm if norm > 0 else np.full(3, np.nan)


def in_polygon(lon: np.ndarray, lat: np.ndarray, polygon: list) -> np.ndarray:
    """Which points lie inside a polygon whose edges are great circles: an odd number of edges stands between a point and the north pole."""
    inside = np.zeros(len(lon), bool)
    for points in polygon or []:
        ring = _ring(points or [])
        if len(ring) < 3:
            continue
        turn, here = _turn(ring), ring[:, 0]
        t1, t2 = np.tan(np.radians(ring[:, 1])), np.tan(np.radians(np.roll(ring[:, 1], -1)))
        for at in range(0, len(lon), 256):
            x = (lon[at : at + 256, None] - here + 180) % 360 - 180  # the point's longitude from each edge's start
            over = np.where(turn >= 0, (x >= 0) & (x < turn), (x < 0) & (x >= turn))
            with np.errstate(divide="ignore", invalid="ignore"):
                height = (t1 * np.sin(np.radians(turn - x)) + t2 * np.sin(np.radians(x))) / np.sin(np.radians(turn))
            above = over & (height > np.tan(np.radians(lat[at : at + 256, None])))
            inside[at : at + 256] ^= above.sum(axis=1) % 2 == 1
        if abs(turn.sum()) > 180 and ring[:, 1].mean() > 0:  # it goes round the north pole
            inside ^= True
    return inside


def _cells(polygon: list) -> list[tuple[int, int]]:
    """Cells that a polygon's outline may reach, with what great circles rise above their ends."""
    ring = _ring((polygon or [[]])[0] or [])
    if not len(ring):
        return []
    turn = _turn(ring)
    lon = ring[0, 0] + np.concatenate(([0.0], np.cumsum(turn)[:-1]))
    a = _xyz(ring)
    normal = np.cross(a, np.roll(a, -1, axis=0))
    size = np.linalg.norm(normal, axis=1)
    top = np.degrees(np.arccos(np.clip(np.abs(normal[:, 2]) / np.where(size > 0, size, 1), 0, 1)))  # an edge's circle gets so far from the equator
    end = np.roll(ring[:, 1], -1)
    far = np.where(np.abs(turn) > 0, np.minimum(top, np.maximum(np.abs(ring[:, 1]), np.abs(end)) + np.abs(turn)), np.abs(ring[:, 1]))
    low, high = min(ring[:, 1].min(), (-far[ring[:, 1] < 0]).min(initial=90)), max(ring[:, 1].max(), far[ring[:, 1] > 0].max(initial=-90))
    if abs(turn.sum()) > 180:  # round a pole
        lon, low, high = np.array([-180.0, 180.0]), (low if ring[:, 1].mean() > 0 else -90), (90 if ring[:, 1].mean() > 0 else high)
    columns = {int((x * CELL + 180) % 360 // CELL) for x in range(int(lon.min() // CELL), int(lon.max() // CELL) + 1)}
    return [(x, y) for x in columns for y in range(int(low // CELL), int(high // CELL) + 1)]


def centroids(geometries: DataFrame, key: str) -> DataFrame:
    """(key, x, y, z, lon, lat): the spherical centre of each geometry; rows whose geometry has no points fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([spherical_centroid(g) for g in batch.column(1).to_pylist()], float).reshape(-1, 3)
            lon, lat = np.degrees(np.arctan2(at[:, 1], at[:, 0])), np.degrees(np.arcsin(np.clip(at[:, 2], -1, 1)))
            out = pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (*at.T, lon, lat))], [key, "x", "y", "z", "lon", "lat"])
            yield out.filter(pa.array(~np.isnan(at[:, 0])))

    numbers = T.StructType.fromDDL("x double, y double, z double, lon double, lat double").fields
    return geometries.select(key, "geometry").mapInArrow(run, T.StructType([geometries.schema[key], *numbers]))


def assign_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child_id, parent_id): the parent whose area holds the child's centre, else the one whose centre is nearest on the sphere.

    children: (child_id, geometry), parents: (parent_id, geometry) of type GEOMETRY. Of several parents that hold a
    centre, or are as near, the smallest id counts. Outlines are indexed by the cells they reach; a child meets only
    those of its cell. A child without points has no parent; without parents there is no row.
    """
    points = stored(centroids(children, "child_id"), "geo-centres")
    polygons = parents.select("parent_id", F.explode("geometry").alias("polygon"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cells(p) for p in batch.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            flat = np.array([c for cs in found for c in cs], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["parent_id", "number", "cx", "cy"])

    polygons = stored(polygons.withColumn("number", F.monotonically_increasing_id()), "geo-polygons")
    kind = T.StructType([parents.schema["parent_id"], *T.StructType.fromDDL("number bigint, cx int, cy int").fields])
    index = polygons.select("parent_id", "polygon", "number").mapInArrow(cells, kind).select("number", "cx", "cy")
    at = points.withColumn("cx", F.floor((F.col("lon") + 180) % 360 / CELL).cast("int")).withColumn("cy", F.floor(F.col("lat") / CELL).cast("int"))
    pairs = at.join(index, ["cx", "cy"]).select("child_id", "lon", "lat", "number")
    # an outline is read once for the points that stand together; it is never sent with each of them
    pairs = pairs.groupBy("number", F.pmod(F.xxhash64("child_id"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("child_id", "lon", "lat")).alias("ps"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ps = batch.column(1)[row].values
                inside = in_polygon(ps.field("lon").to_numpy(), ps.field("lat").to_numpy(), batch.column(2)[row].as_py())
                who = ps.field("child_id").filter(pa.array(inside))
                yield pa.RecordBatch.from_arrays([who, pa.array(batch.column(0).slice(row, 1).to_pylist() * len(who), batch.schema.field(0).type)], ["child_id", "parent_id"])

    kind = T.StructType([children.schema["child_id"], parents.schema["parent_id"]])
    held = pairs.join(polygons, "number").select("parent_id", "ps", "polygon").mapInArrow(test, kind).groupBy("child_id").agg(F.min("parent_id").alias("parent_id"))
    held = stored(held, "geo-held")
    others = points.join(held.select("child_id"), "child_id", "left_anti")
    return held.unionByName(_nearest(others, centroids(parents, "parent_id")))


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(child_id, parent_id): the nearest of the centres, some hundred top-level units, which are sent to all tasks up to MAX_UNITS."""
    rows = centres.orderBy("parent_id").limit(MAX_UNITS + 1).toArrow()
    if rows.num_rows > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} parents: assign to units of a higher level first")
    matrix, ids = np.column_stack([rows[c].to_numpy() for c in "xyz"]), rows["parent_id"].combine_chunks()
    shared = points.sparkSession.sparkContext.broadcast((matrix, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids = shared.value
        for batch in batches:
            at = np.column_stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            if len(at) and len(matrix):
                best = np.concatenate([np.round(at[i : i + 64] @ matrix.T, 12).argmax(axis=1) for i in range(0, len(at), 64)])
                yield pa.RecordBatch.from_arrays([batch.column(0), ids.take(pa.array(best))], ["child_id", "parent_id"])

    kind = T.StructType([points.schema["child_id"], centres.schema["parent_id"]])
    return points.select("child_id", "x", "y", "z").mapInArrow(run, kind)


def map_anchor(cited: DataFrame, geo_links: DataFrame, units: DataFrame) -> DataFrame:
    """(region): oblasts of the cited datasets whose places lie in exactly one oblast. cited: (dataset_id)."""
    at = _placed(geo_links, units, "oblast").join(cited.select("dataset_id").distinct(), "dataset_id", "left_semi")
    single = at.groupBy("dataset_id").agg(F.count("*").alias("n"), F.min("region").alias("region")).where("n = 1")
    return single.select("region").distinct()
