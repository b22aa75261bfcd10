"""Catalogue projections, filters, facets and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.measures import SLO_SECONDS, is_stale


def with_place(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with place, 1.. in a global order, without one task holding all rows.

    A range sort numbers its partitions by a running count of their sizes; only one number per partition
    goes through a single task. The sorted rows are read twice, so a costly input should be stored first.
    """
    ranked = rows.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    sizes = ranked.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col("__part").alias("__p"), "__first", before.alias("__before"))
    out = ranked.join(F.broadcast(base), F.col("__part") == F.col("__p"))  # a row per partition
    return out.withColumn("place", F.col("__before") + F.col("__id") - F.col("__first") + 1).drop("__part", "__id", "__p", "__first", "__before")


def scope_predicate(ids: Sequence[str] = (), publishers: Sequence[str] = (), groups: Sequence[str] = (), tags: Sequence[str] = ()) -> Column:
    """OR of the named lists over id, publisher_id, groups and tags; all lists empty: everything."""
    tests = []
    if ids:
        tests.append(F.col("id").isin(list(ids)))
    if publishers:
        tests.append(F.col("publisher_id").isin(list(publishers)))
    for name, values in (("groups", groups), ("tags", tags)):
        if values:
            tests.append(F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))))
    out = F.lit(not tests)
    for x in tests:
        out = out | F.coalesce(x, F.lit(False))
    return out


def catalogue_filter(now: Column, withdrawn: bool = False, fresh: bool | None = None, tags: Sequence[str] = (), publisher: str | None = None, places: Sequence[str] = (), slo: int = SLO_SECONDS) -> Column:
    """AND of the given conditions; rows out of scope are kept. Reads lifecycle, last_synced_at, tags, publisher_id, geo_ids."""
    out = F.lit(True)
    if not withdrawn:
        out = out & (F.col("lifecycle") != "withdrawn")
    if fresh is not None:
        out = out & (is_stale(F.col("last_synced_at"), now, slo) != F.lit(fresh))
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if publisher is not None:
        out = out & (F.col("publisher_id") == publisher)
    if places:
        out = out & F.coalesce(F.arrays_overlap("geo_ids", F.array(*map(F.lit, places))), F.lit(False))
    return out


def retrieval_scope(ids: Sequence[str] | None, **filters) -> Column:
    """A hard list of ids, where given, and the catalogue filter."""
    out = catalogue_filter(**filters)
    return out & F.col("id").isin(list(ids)) if ids is not None else out


def grid_filter(filters: Mapping[str, str]) -> Column:
    """Every column holds its text, whatever the case; blank filters don't count."""
    out = F.lit(True)
    for name, wanted in filters.items():
        if wanted.strip():
            out = out & F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lower(F.lit(wanted.strip())))
    return out


def object_keys(rows: DataFrame, json: str = "row", longest: int = 12) -> DataFrame:
    """(key, first_row): keys of JSON objects in the order they first occur, ``longest`` at most. rows: (row_no, json)."""
    keys = rows.select("row_no", F.posexplode(F.json_object_keys(json)).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min(F.struct("row_no", "pos")).alias("at")).orderBy("at", "key").limit(longest).select("key", F.col("at.row_no").alias("first_row"))


def page(rows: DataFrame, key: str, limit: int = 100, offset: int = 0, most: int = 1000) -> tuple[DataFrame, int, bool]:
    """One page in order of ``key``, the total, and whether more follows."""
    n, skip = min(max(limit, 1), most), max(offset, 0)
    total = rows.count()
    return rows.orderBy(key).offset(skip).limit(n), total, skip + n < total


def first_translation(translations: DataFrame) -> DataFrame:
    """The first translation of each subject by translator. (kind, subject, translator, text)"""
    order = Window.partitionBy("kind", "subject").orderBy("translator")
    return translations.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def strongest_places(geo_links: DataFrame) -> DataFrame:
    """(dataset_id, entity_id, confidence): the best of all extractors."""
    return geo_links.groupBy("dataset_id", "entity_id").agg(F.max("confidence").alias("confidence"))


def lite(datasets: DataFrame, translations: DataFrame, organizations: DataFrame, geo_links: DataFrame) -> DataFrame:
    """The catalogue's short form: dataset, English title, publisher's title, places with their best confidence in order of id."""
    english = first_translation(translations).where("kind = 'title'").select(F.col("subject").alias("id"), F.col("text").alias("title_en"))
    places = strongest_places(geo_links).groupBy(F.col("dataset_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "confidence"))).alias("geo"))
    owners = organizations.select(F.col("id").alias("publisher_id"), F.col("title").alias("publisher"))
    return datasets.join(english, "id", "left").join(places, "id", "left").join(owners, "publisher_id", "left")


def full_record(datasets: DataFrame, resources: DataFrame, entities: DataFrame, links: DataFrame, max_links: int = 25, max_entities: int = 40) -> DataFrame:
    """Each dataset with its resources, entities and links as arrays.

    Children are ranked, cut and collected before the joins, all by dataset id: rows don't multiply and no
    dataset collects more than the caps.
    """
    return with_children(datasets, resources, entities, both_sides(links), max_links, max_entities)


def with_children(datasets: DataFrame, resources: DataFrame, entities: DataFrame, sides: DataFrame, max_links: int = 25, max_entities: int = 40) -> DataFrame:
    """full_record() of links as both_sides() has them; of tables that are bucketed alike by id and dataset_id it needs no shuffle."""
    res = resources.groupBy(F.col("dataset_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "resource_id", "format"))).alias("resources"))
    ent = cap(entities, "dataset_id", "entity_id", max_entities).groupBy(F.col("dataset_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "confidence"))).alias("entities"))
    rel = cap(sides, "dataset_id", "other_id", max_links).groupBy(F.col("dataset_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("other_id", "confidence"))).alias("links"))
    return datasets.join(res, "id", "left").join(ent, "id", "left").join(rel, "id", "left")


def both_sides(links: DataFrame) -> DataFrame:
    """(dataset_id, other_id, via, confidence) seen from either end of each link (a, b, via, confidence)."""
    one = links.select(F.col("a").alias("dataset_id"), F.col("b").alias("other_id"), "via", "confidence")
    return one.unionByName(links.select(F.col("b").alias("dataset_id"), F.col("a").alias("other_id"), "via", "confidence"))


def cap(rows: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of each ``by`` with the highest confidence."""
    order = Window.partitionBy(by).orderBy(F.desc("confidence"), tie)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def tag_facet(datasets: DataFrame) -> DataFrame:
    """A tag that a dataset repeats counts repeatedly."""
    return datasets.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def publisher_facet(datasets: DataFrame, organizations: DataFrame) -> DataFrame:
    n = datasets.where("publisher_id is not null").groupBy("publisher_id").agg(F.count("*").alias("n"))
    names = organizations.select(F.col("id").alias("publisher_id"), "title")
    return n.join(names, "publisher_id", "left").select("publisher_id", F.coalesce("title", "publisher_id").alias("label"), "n")


def freshness_facet(datasets: DataFrame, now: Column, slo: int = SLO_SECONDS) -> DataFrame:
    """Both buckets, also when one is empty."""
    stale = is_stale(F.col("last_synced_at"), now, slo)
    sums = datasets.agg(F.count_if(~stale).alias("fresh"), F.count_if(stale).alias("stale"))
    return sums.select(F.explode(F.array(F.struct(F.lit("fresh").alias("bucket"), F.col("fresh").alias("n")), F.struct(F.lit("stale").alias("bucket"), F.col("stale").alias("n")))).alias("x")).select("x.*")


def running_budget(rows: DataFrame, by: Sequence[str], order: str, size: Column, budget: int) -> DataFrame:
    """The prefix of each group whose running size fits the budget, always its first row."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("used", F.sum(size).over(run)).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return at.where((F.col("used") <= budget) | (F.col("__r") == 1)).drop("__r")


def sorted_grid(rows: DataFrame, column: str, row_no: str = "row_no", descending: bool = False) -> DataFrame:
    """Stable order of a resource by one column, ties by row number."""
    return rows.orderBy(*tx.sort_keys(F.col(column), descending), F.col(row_no).asc())
