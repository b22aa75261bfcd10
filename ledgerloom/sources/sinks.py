"""Writers: delimited text, row files with their schemas, run manifests, pages of one resource."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog


def quoted(c: Column, sep: str = ",") -> Column:
    """A cell as RFC 4180 writes it."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    special = F.rlike(text, F.lit(f'["\\r\\n{sep}]'))
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def delimited_line(cells: Column, sep: str = ",") -> Column:
    """One line of an array of cells."""
    return F.array_join(F.transform(cells, lambda c: quoted(c, sep)), sep)


def write_delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.csv(path, header=True, sep=sep, quote='"', escape='"')


def write_curated(cells: DataFrame, schemas: DataFrame, path: str) -> None:
    """Rows as JSON lines by dataset and resource, and a schema record per resource beside them.

    cells: (dataset_id, resource_id, sheet, row_no, row map<string,string>); schemas: (dataset_id, resource_id, sheet, columns).
    """
    cells.write.partitionBy("dataset_id", "resource_id").json(f"{path}/rows")
    schemas.write.partitionBy("dataset_id").json(f"{path}/schemas")


def manifest(events: DataFrame) -> DataFrame:
    """(run_id, dataset_id, resources): a manifest's entries, a row per dataset of a run with its own few resources.

    A run's datasets stay rows, so that no row grows with the catalogue; written by run they make one file set a run.
    """
    return events.groupBy("run_id", "dataset_id").agg(F.array_sort(F.collect_list(F.struct("resource_id", "outcome"))).alias("resources"))


def manifest_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("run_id").agg(F.count("*").alias("datasets"), F.sum(F.size("resources")).alias("resources"))


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.write.partitionBy("run_id").json(f"{path}/entries")
    manifest_totals(entries).write.json(f"{path}/totals")


def read_resource_page(
    spark: SparkSession, path: str, dataset_id: str, resource_id: str, sort: str | None = None, descending: bool = False, filters: Mapping[str, str] | None = None, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, int, bool]:
    """A page of one curated resource, the total after filtering, and whether more follows. Only that resource's folder is read."""
    rows = spark.read.schema("row_no long, row map<string,string>, dataset_id string, resource_id string").json(f"{path}/rows")
    rows = rows.where((F.col("dataset_id") == dataset_id) & (F.col("resource_id") == resource_id))
    for name, wanted in (filters or {}).items():
        rows = rows.withColumn("__c", F.try_element_at("row", F.lit(name))).where(catalog.grid_filter({"__c": wanted})).drop("__c")
    total = rows.count()
    n, skip = min(max(limit, 1), 1000), max(offset, 0)
    order = [*tx.sort_keys(F.try_element_at("row", F.lit(sort)), descending), F.asc("row_no")] if sort else [F.asc("row_no")]
    return rows.orderBy(*order).offset(skip).limit(n).select("row_no", "row"), total, skip + n < total
