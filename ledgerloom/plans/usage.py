"""Run summaries, usage, quotas, request metrics and rate limiting over the driver's events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as m
from ..operators import changes, catalog
from ..operators import usage as us
from .base import datasets, query, run_events, t, usage
from .scalars import PRICES

COUNTS_SQL = """counts AS (SELECT run_id, count(*) FILTER (outcome = 'captured') AS captured, count(*) FILTER (outcome = 'skipped_unchanged') AS skipped_unchanged, count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (outcome = 'withdrawn') AS withdrawn, count(*) FILTER (outcome = 'out_of_scope') AS out_of_scope, CAST(0 AS BIGINT) AS updated FROM run_events GROUP BY 1)"""


@query(f", {COUNTS_SQL} SELECT * FROM counts", "run_events")
def e7_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return us.outcome_counts(run_events(spark, d))


@query(
    f""", {COUNTS_SQL}, x AS (SELECT *, captured + skipped_unchanged + failed + withdrawn + out_of_scope AS discovered FROM counts)
    SELECT run_id, discovered, CASE WHEN failed = 0 THEN 'success' WHEN captured + skipped_unchanged > 0 THEN 'partial' ELSE 'failed' END AS outcome, round(failed / greatest(discovered, 1), 6) AS failure_rate,
      CASE WHEN failed > 0 AND captured + skipped_unchanged = 0 THEN 'run_failed' WHEN failed / greatest(discovered, 1) > 0.2 THEN 'threshold_exceeded' END AS alert FROM x""",
    "run_events",
)
def e8_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = us.run_summary(us.outcome_counts(run_events(spark, d)), 0.2)
    return out.select("run_id", "discovered", "outcome", F.round("failure_rate", 6).alias("failure_rate"), "alert")


@query(
    """SELECT run_id, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS seconds, round(count(*) FILTER (outcome = 'failed') / count(*), 6) AS failure_rate
       FROM run_events GROUP BY 1 ORDER BY min(ts) DESC LIMIT 20""",
    "run_events",
)
def e9_history(spark: SparkSession, d: str) -> DataFrame:
    runs = run_events(spark, d).groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("discovered"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return us.run_history(runs).select("run_id", "seconds", F.round("failure_rate", 6).alias("failure_rate"))


@query(
    """SELECT count(*) FILTER (doc_id % 2 = 0) AS visited, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 6 > 0) AS complete, count(*) FILTER (doc_id % 6 = 0) AS failed,
         count(*) - count(*) FILTER (doc_id % 2 = 0 AND (doc_id % 6 > 0 OR doc_id % 4 >= 2)) AS remaining FROM documents"""
)
def e10_progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = t(spark, d, "documents")
    ledger = docs.where(k % 2 == 0).select(F.when(k % 6 == 0, "failed").otherwise("complete").alias("outcome"), (k % 4).alias("attempts"))
    return us.campaign_progress(ledger, docs.count(), 2)


def users(spark: SparkSession, d: str) -> DataFrame:
    """All event users and some without events."""
    u = t(spark, d, "events").select("user_id").distinct().unionByName(spark.createDataFrame([(-1,), (-2,)], "user_id long"))
    reset = F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return u.select("user_id", F.concat(F.lit("u"), "user_id", F.lit("@x")).alias("email"), reset.alias("usage_reset_at"), F.when(F.col("user_id") % 4 == 0, F.lit(50_000)).when(F.col("user_id") % 4 == 1, F.lit(0)).alias("token_limit"))


USERS_SQL = """u AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 50000 WHEN 1 THEN 0 END AS token_limit FROM (SELECT DISTINCT user_id FROM events UNION ALL SELECT -1 UNION ALL SELECT -2)),
    s AS (SELECT user_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cached) AS BIGINT) AS cached, count(*) AS turns FROM usage WHERE user_id % 3 <> 0 OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
    b AS (SELECT u.user_id, token_limit, coalesce(total, 0) AS total, coalesce(cached, 0) AS cached, coalesce(turns, 0) AS turns FROM u LEFT JOIN s USING (user_id))"""


@query(f", {USERS_SQL} SELECT user_id, 'u' || user_id || '@x' AS email, total, cached, turns FROM b", "usage")
def e11_tokens_by_user(spark: SparkSession, d: str) -> DataFrame:
    return us.tokens_by_user(users(spark, d), usage(spark, d)).select("user_id", "email", "total", "cached", "turns")


@query(
    f""", {USERS_SQL}, q AS (SELECT user_id, CAST(greatest(0, floor(total - 0.9 * least(cached, total) + 0.5)) AS BIGINT) AS used, coalesce(token_limit, 100000) AS lim FROM b)
    SELECT user_id, used, lim AS "limit", CASE WHEN lim > 0 THEN greatest(0, lim - used) END AS remaining, lim > 0 AND used >= lim AS exceeded FROM q""",
    "usage",
)
def e12_quotas(spark: SparkSession, d: str) -> DataFrame:
    by_user = us.tokens_by_user(users(spark, d), usage(spark, d))
    return us.quota_by_user(by_user, 100_000).select("user_id", "used", "limit", "remaining", "exceeded")


SINCE = "2024-01-20 00:00:00"
BY_SQL = f"count(*) FILTER (route_class = 'data') AS data, count(*) FILTER (route_class = 'chat') AS chat, count(*) AS total FROM usage WHERE ts >= TIMESTAMP '{SINCE}'"


@query(f" SELECT user_id, {BY_SQL} GROUP BY 1", "usage")
def e13_requests(spark: SparkSession, d: str) -> DataFrame:
    return us.requests_by(usage(spark, d), ["user_id"], F.lit(SINCE).cast("timestamp"))


@query(f" SELECT tenant_id, {BY_SQL} GROUP BY 1", "usage")
def e14_tenants(spark: SparkSession, d: str) -> DataFrame:
    return us.requests_by(usage(spark, d), ["tenant_id"], F.lit(SINCE).cast("timestamp"))


@query("SELECT n_nationkey AS tenant_id, n_name AS name, coalesce(k, 0) AS members FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey")
def e15_tenant_sizes(spark: SparkSession, d: str) -> DataFrame:
    tenants = t(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"))
    return us.tenant_sizes(tenants, t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("tenant_id")))


@query("SELECT c_nationkey AS tenant_id, c_custkey AS user_id, c_name AS email FROM customer WHERE c_nationkey = 3")
def d17_members(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    members = c.where("c_nationkey = 3").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("user_id"))
    return us.members_of(members, c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))).select("tenant_id", "user_id", "email")


@query(
    """SELECT event_type AS route, CAST(2 + event_id % 4 AS VARCHAR) || 'xx' AS status, count(*) AS requests, round(sum(value), 2) AS ms_sum, round(avg(value), 4) AS ms_avg, count(*) FILTER (event_id % 4 = 3) AS errors FROM events GROUP BY 1, 2"""
)
def e16_red(spark: SparkSession, d: str) -> DataFrame:
    log = t(spark, d, "events").select(F.col("event_type").alias("route"), (200 + 100 * (F.col("event_id") % 4)).alias("status"), F.col("value").alias("ms"))
    return us.red_metrics(log).withColumn("ms_sum", F.round("ms_sum", 2)).withColumn("ms_avg", F.round("ms_avg", 4))


@query(
    """SELECT CAST(sum(total) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS output, CAST(sum(least(cached, total)) AS BIGINT) AS cached,
         round(sum(CASE WHEN model = 'other' THEN 0 ELSE ((total - least(cached, total)) + least(cached, total) * 0.1) * pin / 1e6 + cached * pin * 5 / 1e6 END), 4) AS cost
       FROM (SELECT *, CASE WHEN model LIKE 'small%' THEN 1.0 ELSE 15.0 END AS pin FROM usage)""",
    "usage",
)
def e17_llm_totals(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "ord int, name string, price_in double, price_out double")
    turns = m.with_price(usage(spark, d), prices).select(F.col("total").alias("input"), F.col("cached").alias("output"), F.least("cached", "total").alias("cached"), "price_in", "price_out")
    return us.llm_totals(turns).withColumn("cost", F.round("cost", 4))


@query("SELECT coalesce(outcome, 'none') AS outcome, turns FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'no_data' WHEN 2 THEN NULL ELSE 'grounded' END AS outcome, count(*) AS turns FROM usage WHERE route_class = 'chat' GROUP BY 1) WHERE outcome IS NOT NULL", "usage")
def e17_chat_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    outcome = F.when(k == 0, "error").when(k == 1, "no_data").when(k > 2, "grounded")
    return us.chat_outcomes(usage(spark, d).where("route_class = 'chat'").select(outcome.alias("outcome")))


@query("SELECT route_class, count(*) AS rejections FROM usage WHERE total % 11 = 0 GROUP BY 1", "usage")
def e17_rejections(spark: SparkSession, d: str) -> DataFrame:
    return us.rejections(usage(spark, d).select("route_class", F.when(F.col("total") % 11 == 0, 429).otherwise(200).alias("status")))


@query("SELECT strftime(max(last_synced_at), '%Y-%m-%d %H') AS last, date_diff('second', max(last_synced_at), TIMESTAMP '2026-04-01') > 86400 AS stale FROM datasets", "datasets")
def e23_health(spark: SparkSession, d: str) -> DataFrame:
    return us.mirror_health(datasets(spark, d), F.lit("2026-04-01 00:00:00")).select(F.date_format("last_synced_at", "yyyy-MM-dd HH").alias("last"), "stale")


@query(
    """SELECT conv_id AS session_id, user_id, title, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, conv_id) AS place FROM (SELECT conv_id, conv_id % 10 AS user_id, max(turn) AS last,
         (SELECT left(text, 80) FROM conversations x WHERE x.conv_id = c.conv_id AND role = 'user' ORDER BY turn LIMIT 1) AS title FROM conversations c GROUP BY conv_id) QUALIFY place <= 100"""
)
def f5_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("user_id"), F.col("turn").alias("seq"), "role", "text", F.col("turn").alias("created_at"))
    return us.session_titles(rows).select("session_id", "user_id", "title", F.col("place").cast("long").alias("place"))


@query("SELECT c.c_custkey AS user_id, coalesce(k, -1) AS tenant_id FROM customer c LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def f6_primary_tenant(spark: SparkSession, d: str) -> DataFrame:
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    members = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("tenant_id"), F.col("o_orderdate").alias("created_at"))
    return us.primary_tenant(people, members, F.lit(-1))


#: One request a minute a user and class, request after request.
LIMIT_SQL = """, r AS (SELECT user_id || ':' || route_class AS key, event_id AS id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id, route_class ORDER BY ts, event_id) AS k FROM usage),
    s AS (SELECT key, id, sec, k, CAST(1 AS DOUBLE) AS tokens FROM r WHERE k = 1
      UNION ALL SELECT r.key, r.id, r.sec, r.k, least(1.0, CASE WHEN s.tokens >= 1 THEN s.tokens - 1 ELSE s.tokens END + (r.sec - s.sec) * 1.0 / 60) FROM s JOIN r ON r.key = s.key AND r.k = s.k + 1)
    SELECT key, id, tokens >= 1 AS ok, CASE WHEN tokens >= 1 THEN 0 ELSE greatest(1, CAST(ceil((1 - tokens) * 60 / 1.0) AS BIGINT)) END AS retry_after FROM s"""


def by_class(spark: SparkSession, d: str) -> DataFrame:
    """Requests (key, id, ts), a key for each user and class."""
    return usage(spark, d).select(F.concat_ws(":", "user_id", "route_class").alias("key"), F.col("event_id").alias("id"), "ts")


@query(LIMIT_SQL, "usage")
def l4_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """The replay is serial in a key; the tests also hold it against a plain loop."""
    return us.rate_limit(by_class(spark, d), 1.0)


@query(
    """SELECT run_id, count(*) AS datasets, CAST(sum(k) AS BIGINT) AS events FROM (SELECT run_id, dataset_id, count(*) AS k FROM run_events GROUP BY 1, 2) GROUP BY 1""",
    "run_events",
)
def a17_manifest(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import sinks

    entries = sinks.manifest(run_events(spark, d).withColumnRenamed("event_id", "resource_id"))
    return sinks.manifest_totals(entries).select("run_id", "datasets", F.col("resources").alias("events"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, event_id) AS r FROM usage) WHERE r <= 50""", "usage")
def f2_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = usage(spark, d).select("user_id", "event_id", F.col("total").alias("confidence"))
    return catalog.cap(rows, "user_id", "event_id", 50).select("user_id", "event_id")


@query(
    """WITH run AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS validator FROM documents) SELECT id FROM run WHERE CAST(id AS BIGINT) % 2 = 0"""
)
def i13_reusable(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("validator"), F.col("doc_id"))
    ledger = docs.select("id", F.when(F.col("doc_id") % 2 == 0, F.col("validator")).otherwise("older").alias("validator"), F.lit("success").alias("outcome"))
    return changes.reusable_captures(ledger, docs.select("id", "validator")).select("id")
