"""Curation: column types from cells, and cells by type. Tables of any shape stay in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def headers(cells: DataFrame) -> DataFrame:
    """(resource_id, sheet, names array): identifiers of each table's first row."""
    first = cells.where("row_no = 0")
    return first.select("resource_id", "sheet", tx.column_names("cells").alias("names"))


def long_cells(cells: DataFrame) -> DataFrame:
    """(resource_id, sheet, row_no, col_no, value) of the data rows; cells beyond the header are dropped."""
    return cells.where("row_no > 0").select("resource_id", "sheet", "row_no", F.posexplode(F.slice("cells", F.lit(1), F.col("width"))).alias("col_no", "value"))


def infer_types(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, type, nullable, confidence) of each column of cells.

    One conditional sum per candidate type, combined before the shuffle; no values are gathered. A type
    needs nine tenths of the non-blank values; whole numbers also count as decimals.
    """
    v, t = F.col(value), F.col("__t")
    # a cell is trimmed once and has one kind, so no rule runs twice on it
    kind = F.coalesce(
        F.when(v.isNull() | (t == ""), "blank"), F.when(tx.is_date(t, trimmed=True), "datetime"), tx.number_rule(t, trimmed=True), F.when(tx.parse_boolean(t, trimmed=True).isNotNull(), "boolean"), F.lit("string")
    )
    kinds = values.withColumn("__t", tx.trim(v)).select(*keys, kind.alias("__kind"))
    n = lambda *names: F.count_if(F.col("__kind").isin(*names))
    sums = kinds.groupBy(*keys).agg(F.count_if(F.col("__kind") != "blank").alias("n"), n("blank").alias("blank"), n("datetime").alias("d"), n("integer").alias("i"), n("decimal-comma-to-point", "decimal-point").alias("f"), n("boolean").alias("b"))
    enough = lambda c: c >= F.col("n") * 0.9
    chosen = [("datetime", F.col("d")), ("integer", F.col("i")), ("decimal", F.col("f") + F.col("i")), ("boolean", F.col("b"))]
    kind = F.when(F.col("n") == 0, "string")
    sure = F.when(F.col("n") == 0, 0.5)
    for name, count in chosen:
        kind = kind.when(enough(count), name)
        sure = sure.when(enough(count), F.when(count == F.col("n"), 0.95).otherwise(0.8))
    return sums.select(*keys, kind.otherwise("string").alias("type"), (F.col("blank") > 0).alias("nullable"), sure.otherwise(0.7).alias("confidence"))


def typed_text(value: Column, kind: Column) -> Column:
    """A cell in its column's type, written as text: blank is null, what can't be parsed stays."""
    once = lambda c, body: F.transform(F.array(c), body)[0]  # noqa: E731  a lambda variable is worked out once
    whole = lambda t: once(tx.parse_number(t, trimmed=True), lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")))
    out = lambda t: (
        F.when(kind == "datetime", tx.parse_date(t, trimmed=True))
        .when(kind == "integer", whole(t))
        .when(kind == "decimal", tx.parse_number(t, trimmed=True).cast("string"))
        .when(kind == "boolean", tx.parse_boolean(t, trimmed=True).cast("string"))
    )
    return once(tx.trim(value), lambda t: F.when(t != "", F.coalesce(out(t), value)))


def typed_rows(rows: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (width, cells) with ``typed``, the typed text of every cell within the width; a table's types meet its whole rows, and no cell is a row.

    types: infer_types() by ``keys`` and col_no.
    """
    own = types.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("col_no", "type"))).alias("__types"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    at = rows.join(own, same).drop(*[f"__{k}" for k in keys])
    return at.withColumn("typed", F.transform(F.slice("cells", F.lit(1), F.col("width")), lambda c, i: typed_text(c, F.try_element_at("__types", i)))).drop("__types")


def apply_types(values: DataFrame, types: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Every cell with its column's type and its typed text. types: infer_types(), a row per column of each table."""
    own = types.select(*[F.col(k).alias(f"__{k}") for k in keys], "type")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    at = values.join(own, same).drop(*[f"__{k}" for k in keys])
    return at.withColumn("typed", typed_text(F.col(value), F.col("type")))


def wide(typed: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """One table's typed cells as a DataFrame with real columns. typed: (row_no, col_no, typed) of that table alone."""
    as_type = {"integer": "long", "decimal": "double", "boolean": "boolean"}
    rows = typed.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "typed"))).alias("m"))
    return rows.select("row_no", *[F.try_element_at("m", F.lit(i)).try_cast(as_type.get(kind, "string")).alias(name) for i, (name, kind) in enumerate(zip(names, types, strict=True))])
