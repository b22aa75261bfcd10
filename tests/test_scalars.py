"""Expected values of single functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import measures as m
from ledgerloom.functions import text as tx
from ledgerloom.plans import registry


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr(F.col("x"))).collect()]


def test_dates(spark):
    cases = {"5 май 2026": "2026-05-05", "15 декември 2024": "2024-12-15", "1 неделя 2025": None, "": None, "not a date": None, "2024-02-03T10:00": "2024-02-03", "3/4/2024": "2024-04-03", "99.99.2024": "2024-99-99", " 5 МАЙ 2026 ": "2026-05-05"}
    assert values(spark, cases, tx.parse_date) == list(cases.values())


def test_numbers(spark):
    cases = {"1 234,56": 1234.56, "1.234,56": 1234.56, "1,5": 1.5, "1234.56": 1234.56, "100": 100.0, "abc": None, "1.234": 1234.0, "1234,56": None, "-3": -3.0, "1 234": 1234.0, "NaN": None, "1d": None}
    assert values(spark, cases, tx.parse_number) == list(cases.values())
    assert values(spark, ["1,5", "12.5", "12", "x"], tx.number_rule) == ["decimal-comma-to-point", "decimal-point", "integer", None]


def test_booleans(spark):
    cases = {"Да": True, "TRUE": True, "  1  ": True, "Не": False, "false": False, "maybe": None}
    assert values(spark, cases, tx.parse_boolean) == list(cases.values())


def test_identifiers():
    assert tx.identifiers(["Пореден №", "a b", "a-b", "A  B", "2024", "", "Été"]) == ["poreden_no", "a_b", "a_b_1", "a_b_2", "c_2024", "c_", "e_te"]


def test_slug(spark):
    assert values(spark, ["Hello, World!", "---", "Ден 5", "x" * 100], tx.slug) == ["hello-world", "item", "ден-5", "x" * 80]


def test_grid_order(spark):
    cells = ["9", "100", "", "Надежда", "Дружба", None, "42"]
    df = spark.createDataFrame([(x,) for x in cells], "x string")
    assert [r[0] for r in df.orderBy(*tx.sort_keys(F.col("x"))).collect()][:5] == ["9", "42", "100", "Дружба", "Надежда"]


@pytest.mark.parametrize("own,default,want", [(500, 100, 500), (0, 100, 0), (None, 100, 100), (None, None, 0), (-5, 100, 0), (None, -5, 0)])
def test_limits(spark, own, default, want):
    row = spark.createDataFrame([(own, default)], "own long, dflt long").select(m.effective_limit(F.col("own"), F.col("dflt"))).first()
    assert row[0] == want


def test_cost(spark):
    u = spark.createDataFrame([("a", 1_000_000, 0, 0), ("a-long", 1_000_000, 1_000_000, 500_000), ("zz", 5, 5, 0)], "model string, i long, o long, c long")
    p = spark.createDataFrame([(0, "a", 3.0, 15.0)], "ord int, name string, price_in double, price_out double")
    got = m.with_price(u, p).select("model", F.round(m.token_cost(F.col("i"), F.col("o"), F.col("c"), F.col("price_in"), F.col("price_out")), 6)).collect()
    assert {r[0]: r[1] for r in got} == {"a": 3.0, "a-long": 16.65, "zz": 0.0}


def test_billable(spark):
    rows = spark.createDataFrame([(100, 50), (100, 500), (0, 5), (10, -3)], "t long, c long")
    assert [r[0] for r in rows.select(m.billable_tokens(F.col("t"), F.col("c"))).collect()] == [55, 10, 0, 10]


def test_map_scale(spark):
    row = spark.range(1).select(*[m.ramp_bucket(F.lit(c), m.ramp_breakpoints(F.lit(100))) for c in (0, 1, 10, 24, 25, 50, 75)]).first()
    assert list(row) == [0, 1, 2, 2, 3, 4, 5]


def test_cosine_and_embedding(spark):
    row = spark.range(1).select(m.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), m.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))), m.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert [round(x, 6) for x in row] == [0.707107, 0.0, 0.0]
    e = spark.createDataFrame([("\U0001f600",), ("",)], "x string").select(m.hash_embedding(8)("x")).collect()
    assert sum(x > 0 for x in e[0][0]) == 2 and set(e[1][0]) == {0.0}


def test_hash_embedding_agrees_with_its_sql(spark, tmp_path):
    """Empty and missing texts, signs beyond U+FFFF, repeated and missing ids."""
    texts = [(1, ""), (2, None), (3, "\U0001f600\U0001f601a"), (4, "abc"), (4, "\U0001f6ff d"), (5, ""), (5, "aaa"), (5, None), (None, "x"), (6, "é\r\n\0")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["b19_hash_embedding"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["b19_hash_embedding"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 6
