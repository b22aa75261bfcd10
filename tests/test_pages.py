"""Pages of sorted tables equal ORDER BY with OFFSET, and open the parts that they lie in alone."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pages


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    path = str(tmp_path_factory.mktemp("pages"))
    pages.write(rows, [F.asc("k")], "k", path, 10)
    return path, rows.schema


@pytest.mark.parametrize("limit, offset", [(20, 0), (20, 45), (7, 493), (5, 600), (0, -3), (2000, 10)])
def test_pages_by_number(spark, table, limit, offset):
    path, schema = table
    rows, total, more = pages.page(spark, path, schema, limit, offset)
    n, skip = min(max(limit, 1), 1000), max(offset, 0)
    assert [r["k"] for r in rows.collect()] == list(range(skip, min(500, skip + n))) and total == 500 and more == (skip + n < 500)
    assert rows.columns == schema.names


def test_a_page_reads_its_parts(spark, table):
    path, schema = table
    rows = pages.page(spark, path, schema, 20, 100)[0]
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() <= 2


@pytest.mark.parametrize("after", [None, -5, 0, 99, 437, 499, 700])
def test_pages_behind_a_key(spark, table, after):
    path, schema = table
    got = [r["k"] for r in pages.page_after(spark, path, schema, "k", after, 60).collect()]
    first = 0 if after is None else max(after + 1, 0)
    assert got == list(range(first, min(500, first + 60)))


def test_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "k int")
    pages.write(rows, [F.asc("k")], "k", str(tmp_path))
    assert pages.page(spark, str(tmp_path), rows.schema)[0].count() == 0 and pages.page(spark, str(tmp_path), rows.schema)[1:] == (0, False)
