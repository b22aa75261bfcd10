"""Registration of queries with their SQL, and the catalogue's tables as views of the driver's tables.

Each view is defined twice, as a DataFrame and as a common table expression, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, scratch, stored  # noqa: F401  the plans take them from here

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function under its name; ``views`` names the common table expressions that ``sql`` reads."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            names = views.split()
            ORACLE_SQL[f.__name__] = (("WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)) if names else "") + sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The moment that jobs take as now.
NOW = "2026-02-01 00:00:00"

VIEW_SQL = {
    "datasets": """
        SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS description, source AS publisher_id,
               CASE WHEN doc_id % 10 = 0 THEN [lang, lang, 'size:' || CAST(least(n_chars // 1000, 9) AS VARCHAR)]
                    ELSE [lang, 'size:' || CAST(least(n_chars // 1000, 9) AS VARCHAR)] END AS tags,
               CASE doc_id % 20 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'out_of_scope' ELSE 'active' END AS lifecycle,
               TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS last_synced_at
        FROM documents""",
    "geo_units": """
        SELECT 'nation:' || n_nationkey AS id, n_name AS label, 'municipality' AS kind, 'region:' || n_regionkey AS parent FROM nation
        UNION ALL SELECT 'region:' || r_regionkey, r_name, 'oblast', NULL FROM region
        UNION ALL SELECT 'region:none', 'Nowhere', 'oblast', NULL""",
    "geo_links": """
        SELECT CAST(l_orderkey AS VARCHAR) AS dataset_id, 'nation:' || s_nationkey AS entity_id, 'supplier' AS extractor, round(1 - l_discount, 2) AS confidence
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        UNION ALL
        SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 3 = 0 THEN 'region:' || n_regionkey ELSE 'nation:' || c_nationkey END, 'customer', 0.7
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "run_events": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id, CAST(user_id AS VARCHAR) AS dataset_id, ts,
               CASE event_type WHEN 'view' THEN 'captured' WHEN 'click' THEN 'skipped_unchanged' WHEN 'error' THEN 'failed'
                    WHEN 'purchase' THEN 'withdrawn' ELSE 'out_of_scope' END AS outcome
        FROM events""",
    "usage": """
        SELECT event_id, user_id, user_id % 5 AS tenant_id, ts, CAST(floor(value * 100) AS BIGINT) AS total, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cached,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'chat' WHEN event_type = 'error' THEN 'admin' ELSE 'data' END AS route_class,
               CASE user_id % 4 WHEN 0 THEN 'small-1' WHEN 1 THEN 'small-1-long' WHEN 2 THEN 'large-2' ELSE 'other' END AS model
        FROM events""",
}


def datasets(spark: SparkSession, d: str) -> DataFrame:
    size = F.concat(F.lit("size:"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("string"))
    return t(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.col("source").alias("publisher_id"),
        F.when(F.col("doc_id") % 10 == 0, F.array("lang", "lang", size)).otherwise(F.array("lang", size)).alias("tags"),
        F.when(F.col("doc_id") % 20 == 0, "withdrawn").when(F.col("doc_id") % 20 == 1, "out_of_scope").otherwise("active").alias("lifecycle"),
        F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("last_synced_at"),
    )


def geo_units(spark: SparkSession, d: str) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    cols = "id string, label string, kind string, parent string"
    nations = t(spark, d, "nation").select(key("nation", "n_nationkey"), "n_name", F.lit("municipality"), key("region", "n_regionkey"))
    regions = t(spark, d, "region").select(key("region", "r_regionkey"), "r_name", F.lit("oblast"), F.lit(None).cast("string"))
    return nations.union(regions).union(spark.createDataFrame([("region:none", "Nowhere", "oblast", None)], cols)).toDF("id", "label", "kind", "parent")


def geo_links(spark: SparkSession, d: str) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    by_supplier = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    by_supplier = by_supplier.select(
        F.col("l_orderkey").cast("string").alias("dataset_id"), key("nation", "s_nationkey").alias("entity_id"), F.lit("supplier").alias("extractor"), F.round(1 - F.col("l_discount"), 2).alias("confidence")
    )
    by_customer = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("o_custkey") % 3 == 0, key("region", "n_regionkey")).otherwise(key("nation", "c_nationkey"))
    by_customer = by_customer.select(F.col("o_orderkey").cast("string"), place, F.lit("customer"), F.lit(0.7))
    return by_supplier.union(by_customer)


def run_events(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.create_map(*map(F.lit, ["view", "captured", "click", "skipped_unchanged", "error", "failed", "purchase", "withdrawn", "signup", "out_of_scope"]))
    return t(spark, d, "events").select(
        F.col("ts").cast("date").cast("string").alias("run_id"), "event_id", F.col("user_id").cast("string").alias("dataset_id"), F.col("ts").cast("timestamp").alias("ts"), outcome[F.col("event_type")].alias("outcome")
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(
        "event_id",
        "user_id",
        (F.col("user_id") % 5).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 100).cast("long").alias("total"),
        F.get_json_object("props", "$.k").cast("long").alias("cached"),
        F.when(F.col("event_type").isin("purchase", "signup"), "chat").when(F.col("event_type") == "error", "admin").otherwise("data").alias("route_class"),
        F.when(F.col("user_id") % 4 == 0, "small-1").when(F.col("user_id") % 4 == 1, "small-1-long").when(F.col("user_id") % 4 == 2, "large-2").otherwise("other").alias("model"),
    )
