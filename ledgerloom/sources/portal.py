"""Portal metadata and datastore payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGE = """id string, name string, title string, notes string, license_id string, metadata_created string, metadata_modified string,
    organization struct<id:string,name:string,title:string,description:string>, tags array<struct<name:string>>, groups array<struct<id:string>>,
    resources array<struct<id:string,name:string,description:string,url:string,format:string,mimetype:string,position:int,size:bigint>>"""


def flatten_packages(raw: DataFrame, column: str = "package") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Organization, dataset and resource rows of package documents. A resource without a position takes its index."""
    p = raw.select(F.from_json(column, PACKAGE).alias("p")).select("p.*")
    organizations = p.where("organization is not null").select("organization.*").dropDuplicates(["id"])
    datasets = p.select(
        "id", F.col("name").alias("slug"), "title", F.col("notes").alias("description"), F.col("license_id").alias("license"), F.col("organization.id").alias("publisher_id"),
        F.transform("tags", lambda x: x["name"]).alias("tags"), F.transform("groups", lambda x: x["id"]).alias("groups"), "metadata_created", "metadata_modified",
    )
    res = p.select(F.col("id").alias("dataset_id"), F.posexplode("resources").alias("index", "r"))
    resources = res.select("dataset_id", "r.id", "r.name", "r.description", F.col("r.url").alias("source_url"), "r.format", "r.mimetype", F.coalesce("r.position", "index").alias("position"), F.col("r.size").alias("bytes"))
    return organizations, datasets, resources


def _cells(row: Column, width: Column) -> Column:
    """A row's trimmed cells, filled up to ``width``."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.trim(F.get(row, i)), F.lit("")))


def _numeric(cell: Column) -> Column:
    plain = F.replace(F.regexp_replace(cell, r"\s", ""), F.lit(","), F.lit("."))
    return F.rlike(plain, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"))


def merged_header(rows: Column) -> Column:
    """struct<header, data_start> of a datastore's first rows (array<array<string>>).

    A second row joins the first only if it has labels and no numbers, the third isn't a row of labels, and
    the first has a label followed by blanks that the second fills; labels then run on over those blanks.
    """
    width = F.greatest(F.lit(1), F.aggregate(F.slice(rows, 1, 10), F.lit(0), lambda m, r: F.greatest(m, F.size(r))))

    def with_rows(top: Column, sub: Column, third: Column) -> Column:
        labels = lambda row: F.exists(row, lambda c: c != "") & ~F.exists(row, lambda c: (c != "") & _numeric(c))
        # run on: a blank below which there is a label takes the label to its left
        filled = F.aggregate(
            F.sequence(F.lit(0), width - 1),
            F.array().cast("array<string>"),
            lambda out, i: F.concat(out, F.array(F.when((F.get(top, i) == "") & (F.get(sub, i) != "") & (i > 0), F.coalesce(F.get(out, i - 1), F.lit(""))).otherwise(F.get(top, i)))),
        )
        group = F.exists(F.sequence(F.lit(0), width - 1), lambda i: (F.get(top, i) == "") & (F.get(filled, i) != ""))
        merge = (F.size(rows) > 2) & labels(sub) & ~labels(third) & group
        joined = F.zip_with(filled, sub, lambda a, b: F.concat_ws(" ", F.when(a != "", a), F.when(b != "", b)))
        return F.when(merge, F.struct(joined.alias("header"), F.lit(2).alias("data_start"))).otherwise(F.struct(top.alias("header"), F.lit(1).alias("data_start")))

    none = F.struct(F.array().cast("array<string>").alias("header"), F.lit(0).alias("data_start"))
    return F.when(F.size(rows) == 0, none).otherwise(with_rows(_cells(F.get(rows, F.lit(0)), width), _cells(F.get(rows, F.lit(1)), width), _cells(F.get(rows, F.lit(2)), width)))
