"""Usage, quota, cost and request aggregates, run summaries, and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as m

OUTCOMES = ["captured", "skipped_unchanged", "failed", "withdrawn", "out_of_scope", "updated"]


def outcome_counts(events: DataFrame) -> DataFrame:
    """A column per outcome and a row per run, zeros filled. One event per (run, dataset, resource) is assumed; see latest_by."""
    return events.groupBy("run_id").pivot("outcome", OUTCOMES).count().fillna(0, OUTCOMES)


def run_summary(counts: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Outcome, failure rate and alert of each run."""
    discovered = sum((F.col(c) for c in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    rate = F.col("failed") / F.greatest(discovered, F.lit(1))
    outcome = F.when(F.col("failed") == 0, "success").when(F.col("captured") + F.col("skipped_unchanged") > 0, "partial").otherwise("failed")
    alert = F.when(outcome == "failed", "run_failed").when(rate > threshold, "threshold_exceeded")
    return counts.select("*", discovered.alias("discovered"), outcome.alias("outcome"), rate.alias("failure_rate"), alert.alias("alert"))


def run_history(runs: DataFrame, most: int = 20) -> DataFrame:
    """Newest runs first: seconds they took and their failure rate, null when they discovered nothing."""
    seconds = F.col("ended_at").cast("long") - F.col("started_at").cast("long")
    rate = F.when(F.col("discovered") > 0, F.col("failed") / F.col("discovered"))
    return runs.withColumn("seconds", seconds).withColumn("failure_rate", rate).orderBy(F.desc("started_at"), "run_id").limit(most)


def campaign_progress(ledger: DataFrame, total: int, max_attempts: int) -> DataFrame:
    spent = (F.col("outcome") == "complete") | ((F.col("outcome") == "failed") & (F.col("attempts") >= max_attempts))
    return ledger.agg(
        F.count_if(F.col("outcome").isin("complete", "failed")).alias("visited"),
        F.count_if(F.col("outcome") == "complete").alias("complete"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        (F.lit(total) - F.count_if(spent)).alias("remaining"),
    )


def tokens_by_user(users: DataFrame, usage: DataFrame) -> DataFrame:
    """Total and cached tokens of each user since that user's reset, users without any included.

    users: (user_id, usage_reset_at, ...). Usage is cut by the users' times before it is summed, so sums
    are combined before the shuffle.
    """
    resets = users.select("user_id", F.col("usage_reset_at").alias("reset"))
    since = usage.join(resets, "user_id").where(F.col("reset").isNull() | (F.col("ts") >= F.col("reset")))
    sums = since.groupBy("user_id").agg(F.sum(m.clamp(F.col("total"))).alias("total"), F.sum(m.clamp(F.col("cached"))).alias("cached"), F.count("*").alias("turns"))
    out = users.join(sums, "user_id", "left")
    for c in ("total", "cached", "turns"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out


def quota_by_user(by_user: DataFrame, default_limit: int | None) -> DataFrame:
    """Usage and quota of each user. by_user: tokens_by_user() of users with token_limit."""
    out = by_user.withColumn("used", m.billable_tokens(F.col("total"), F.col("cached")))
    out = out.withColumn("limit", m.effective_limit(F.col("token_limit"), F.lit(default_limit)))
    return out.withColumn("remaining", m.quota_remaining(F.col("used"), F.col("limit"))).withColumn("exceeded", m.quota_exceeded(F.col("used"), F.col("limit")))


def requests_by(usage: DataFrame, key: list[str], since: Column, until: Column | None = None, route: str | None = None) -> DataFrame:
    """Requests in a time window by key: data, chat and all."""
    at = usage.where(F.col("ts") >= since)
    if until is not None:
        at = at.where(F.col("ts") < until)
    if route is not None:
        at = at.where(F.col("route_class") == route)
    return at.groupBy(*key).agg(F.count_if(F.col("route_class") == "data").alias("data"), F.count_if(F.col("route_class") == "chat").alias("chat"), F.count("*").alias("total"))


def tenant_sizes(tenants: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("tenant_id").agg(F.count("*").alias("members"))
    return tenants.join(n, "tenant_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def members_of(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id")


def primary_tenant(users: DataFrame, members: DataFrame, default: Column) -> DataFrame:
    """(user_id, tenant_id): the oldest membership, else the default."""
    first = members.groupBy("user_id").agg(F.min(F.struct("created_at", "tenant_id")).alias("x"))
    return users.select("user_id").join(first, "user_id", "left").select("user_id", F.coalesce("x.tenant_id", default).alias("tenant_id"))


def session_titles(messages: DataFrame, longest: int = 80, per_user: int = 100) -> DataFrame:
    """Each session's title, the start of its first user message, and the newest ``per_user`` sessions of a user.

    messages: (session_id, user_id, seq, role, text, created_at)
    """
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("seq")))
    by = messages.groupBy("session_id", "user_id").agg(F.substring(first, 1, longest).alias("title"), F.max("created_at").alias("last_at"))
    order = Window.partitionBy("user_id").orderBy(F.desc("last_at"), "session_id")
    return by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_user)


def red_metrics(requests: DataFrame) -> DataFrame:
    """Rate, errors and duration by route and status class. requests: (route, status, ms)"""
    return requests.groupBy("route", m.status_class(F.col("status")).alias("status")).agg(
        F.count("*").alias("requests"), F.sum("ms").alias("ms_sum"), F.avg("ms").alias("ms_avg"), F.count_if(F.col("status") >= 500).alias("errors")
    )


def llm_totals(turns: DataFrame) -> DataFrame:
    """Tokens by kind and cost over turns with price_in and price_out."""
    cost = m.token_cost(F.col("input"), F.col("output"), F.col("cached"), F.col("price_in"), F.col("price_out"))
    return turns.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cached").alias("cached"), F.sum(cost).alias("cost"))


def chat_outcomes(turns: DataFrame) -> DataFrame:
    """(outcome, turns) of chat turns (outcome); turns without one aren't counted."""
    return turns.where("outcome is not null").groupBy("outcome").agg(F.count("*").alias("turns"))


def rejections(requests: DataFrame) -> DataFrame:
    """(route_class, rejections): requests refused by rate or quota, status 429. requests: (route_class, status)."""
    return requests.where("status = 429").groupBy("route_class").agg(F.count("*").alias("rejections"))


def mirror_health(datasets: DataFrame, now: Column) -> DataFrame:
    last = datasets.agg(F.max("last_synced_at").alias("last_synced_at"))
    return last.withColumn("stale", m.is_stale(F.col("last_synced_at"), now))


class Bucket:
    """A token bucket: ``rate`` a minute, which is also its capacity. The state is (tokens, seconds)."""

    def __init__(self, rate: float, tokens: float | None = None, at: float | None = None):
        self.rate, self.tokens, self.at = rate, rate if tokens is None else tokens, at

    def take(self, now: float) -> tuple[bool, int]:
        if self.rate <= 0:
            return True, 0
        if self.at is not None:
            now = max(now, self.at)  # a request that comes late finds the bucket as it is
            self.tokens = min(self.rate, self.tokens + (now - self.at) * self.rate / 60)
        self.at = now
        if self.tokens >= 1:
            self.tokens -= 1
            return True, 0
        return False, max(1, int(np.ceil((1 - self.tokens) * 60 / self.rate)))


def rate_limit(requests: DataFrame, rate: float) -> DataFrame:
    """requests (key, id, ts) with ok and retry_after, replayed in time order per key.

    The recurrence is serial in a key, so a key's rows stay in one task; they are streamed in sorted order
    and only one bucket is held, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for batch in batches:
            p = batch.to_pandas()
            ok, retry = [], []
            for k, sec in zip(p["key"], p["sec"], strict=True):
                if bucket is None or k != key:
                    key, bucket = k, Bucket(rate)
                a, b = bucket.take(sec)
                ok.append(a)
                retry.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), pa.array(retry, pa.int64())], ["key", "id", "ok", "retry_after"])

    at = requests.select(F.col("key").cast("string"), "id", (F.unix_micros("ts") / 1e6).alias("sec"))
    return at.repartition("key").sortWithinPartitions("key", "sec", "id").mapInArrow(run, "key string, id long, ok boolean, retry_after long")


def trailing_requests(requests: DataFrame, seconds: int = 86_400, stretch: int = 7) -> DataFrame:
    """requests (key, id, ts) with ``used``: the key's requests in the ``seconds`` before each one, that moment included.

    Of requests at the same time those with smaller ids come before. Time is cut into stretches of ``stretch`` windows,
    and a stretch also takes in the last window of the one before it, so a key with very many requests is many tasks' work.
    """
    window, length = seconds * 1_000_000, stretch * seconds * 1_000_000
    at = requests.select("key", "id", F.unix_micros("ts").alias("at")).withColumn("own", F.floor(F.col("at") / length))
    again = F.when(F.col("at") >= (F.col("own") + 1) * length - window, F.col("own") + 1)
    rows = at.withColumn("part", F.explode(F.array_compact(F.array("own", again))))
    by = Window.partitionBy("key", "part")
    before = F.count("*").over(by.orderBy("at").rangeBetween(-window, -1))
    peers = F.row_number().over(Window.partitionBy("key", "part", "at").orderBy("id")) - 1
    return rows.withColumn("used", before + peers).where("part = own").select("key", "id", "used")
