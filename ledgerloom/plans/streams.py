"""Streaming jobs over the driver's tables as they lie, each run until nothing is left to read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as us
from ..streaming import jobs
from .base import query, run_events, scratch, usage
from .changes import ACTIONS_SQL, _index_tables
from .curation import _line_files
from .usage import LIMIT_SQL, by_class


def _arriving(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as files that a stream reads."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


@query("SELECT 'cells' AS kind, 5 * count(*) AS n FROM lineitem UNION ALL SELECT 'boolean', count(*) FILTER (l_linenumber % 2 = 0) FROM lineitem")
def l1_curate_stream(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "curated-stream")
    jobs.curate_stream(_arriving(_line_files(spark, d), "files"), out, f"{out}-state").awaitTermination()
    cells = spark.read.parquet(f"{out}/cells")
    rows = cells.groupBy().agg(F.count("*").alias("cells"), F.count_if((F.col("type") == "boolean") & (F.col("typed") == "true")).alias("boolean"))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("cells", "boolean")])).alias("x")).select("x.*")


@query(f"{ACTIONS_SQL} SELECT id, keyword, vector FROM actions")
def l2_index_stream(spark: SparkSession, d: str) -> DataFrame:
    docs, ledger, kw, vec = _index_tables(spark, d)
    out = scratch(spark, "index-stream")
    jobs.index_stream(_arriving(docs.withColumn("version", F.lit(1)), "changed"), ledger, kw, vec, "m#32", out, f"{out}-state").awaitTermination()
    return spark.read.parquet(f"{out}/actions").select("id", "keyword", "vector")


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, tenant_id, route_class, count(*) AS n FROM usage
       WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM usage) - INTERVAL 1 HOUR GROUP BY 1, 2, 3""",
    "usage",
)
def l3_windowed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has passed."""
    rows = usage(spark, d).select("ts", "tenant_id", "route_class")
    out = scratch(spark, "requests-stream")
    jobs.append_to(jobs.windowed_requests(_arriving(rows, "requests")), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tenant_id", "route_class", "n")


@query(LIMIT_SQL, "usage")
def l4_rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The batch replay (l4_rate_limit) as a stream."""
    out = scratch(spark, "limit-stream")
    jobs.append_to(jobs.rate_limit_stream(_arriving(by_class(spark, d), "limited"), 1.0), out, f"{out}-state", state=True).awaitTermination()
    return spark.read.parquet(out)


TRAIL_SQL = """SELECT user_id || ':' || route_class AS key, event_id AS id, count(*) OVER (PARTITION BY user_id, route_class ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY user_id, route_class, ts ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS used FROM usage"""


@query(" " + TRAIL_SQL, "usage")
def l3_trailing_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the last day before each one, by user and class."""
    return us.trailing_requests(by_class(spark, d))


@query(" " + TRAIL_SQL, "usage")
def l3_trailing_requests_stream(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "trail-stream")
    jobs.append_to(jobs.trailing_requests_stream(_arriving(by_class(spark, d), "trailed")), out, f"{out}-state", state=True).awaitTermination()
    return spark.read.parquet(out)


@query(
    """SELECT run_id, 'threshold_exceeded' AS alert, round(count(*) FILTER (outcome = 'failed') / count(*), 6) AS failure_rate FROM run_events GROUP BY 1 HAVING count(*) FILTER (outcome = 'failed') / count(*) > 0.2""",
    "run_events",
)
def l5_run_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = run_events(spark, d).select("run_id", "outcome")
    out = scratch(spark, "alerts-stream")
    jobs.latest_to(jobs.run_alerts(_arriving(rows, "outcomes"), 0.2), out, f"{out}-state").awaitTermination()
    found = spark.read.parquet(out)
    last = found.agg(F.max("batch").alias("batch"))  # one row
    return found.join(F.broadcast(last), "batch", "left_semi").select("run_id", "alert", F.round("failure_rate", 6).alias("failure_rate"))
