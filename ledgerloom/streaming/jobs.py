"""Jobs over logs and captures that keep arriving, as Structured Streaming.

The batch operators are reused per micro-batch. Late records: counts are kept per event-time window until
the watermark passes its end; a record later than that is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.tables import stored
from ..operators import changes, curate, keyed, usage
from ..sources import files

LATE = "1 hour"


def _each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there by now, then stop; a restart goes on where the checkpoint ends."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def curate_stream(captured: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New files (resource_id, parser, content) to typed cells under ``out``; files that fail go to a table of their own.

    A batch has its number in its path, so a batch that runs again after a failure replaces its own rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        files.cells_of(batch).write.mode("overwrite").parquet(f"{out}/raw/batch={number}")  # files are parsed once
        good, bad = files.quarantine(batch.sparkSession.read.parquet(f"{out}/raw/batch={number}"))
        bad.write.mode("overwrite").parquet(f"{out}/uncurated/batch={number}")
        cells = curate.long_cells(good)
        keys = ["resource_id", "sheet", "col_no"]
        curate.apply_types(cells, curate.infer_types(cells, keys), keys).write.mode("overwrite").parquet(f"{out}/cells/batch={number}")

    return _each_batch(captured, handle, checkpoint)


#: A row an id: what the ledger and the stores hold of it, the batch that wrote it, and what there was before that batch.
_HELD = "content_fp string, embed_fp string, model_id string, keyword boolean, vector boolean"


def index_stream(changed: DataFrame, ledger: DataFrame, keyword_store: DataFrame, vector_store: DataFrame, model_id: str, out: str, checkpoint: str) -> StreamingQuery:
    """Index actions of changed documents (id, version, content_fp, embed_fp, embed_text) under ``out``/actions.

    Of an id's versions in a batch the latest counts. What earlier batches left is a keyed table under ``out``/ledger:
    a batch reads and rewrites only the buckets of its ids. Each row also keeps what stood there before the batch that
    wrote it, so a batch that runs again, after it got through or broke off anywhere, finds what it found at first.
    """
    schema = T.StructType([T.StructField("id", T.StringType()), *T.StructType.fromDDL(f"held struct<{_HELD}>, batch bigint, before struct<{_HELD}>").fields])
    names = T.StructType.fromDDL(_HELD).names
    table = f"{out}/ledger"

    def seed() -> None:
        known = ledger.select(F.col("id").cast("string").alias("id"), *names[:3])
        for store, name in ((keyword_store, "keyword"), (vector_store, "vector")):
            ids = store.select(F.col("id").cast("string").alias("id"), F.lit(True).alias(name)).distinct()
            known = known.join(ids, "id", "full_outer").withColumn(name, F.coalesce(name, F.lit(False)))
        keyed.create(known.select("id", F.struct(*names).alias("held"), F.lit(-1).cast("long").alias("batch"), F.lit(None).cast(schema["before"].dataType).alias("before")), table, ["id"])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            seed()
        latest = stored(changes.latest_by(batch, ["id"], [F.desc("version"), F.desc("content_fp"), F.desc("embed_fp")]).drop("version").withColumn("id", F.col("id").cast("string")), "index-latest")
        found = keyed.read(spark, table, schema, keyed.touched(latest, ["id"]))
        now = found.select("id", F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("held")).alias("was"))
        flat = now.where("was is not null").select("id", "was.*")
        actions = changes.index_actions(latest, flat.where("content_fp is not null").select("id", *names[:3]), flat.where("keyword").select("id"), flat.where("vector").select("id"), model_id)
        actions.write.mode("overwrite").parquet(f"{out}/actions/batch={number}")
        # blank texts have no vector, so the ledger doesn't take them
        fresh = spark.read.schema(actions.schema).parquet(f"{out}/actions/batch={number}").where("vector <> 'empty_text'")
        fresh = fresh.select("id", F.struct("content_fp", "embed_fp", F.lit(model_id).alias("model_id"), F.lit(True).alias("keyword"), F.lit(True).alias("vector")).alias("held"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            at = old.join(new.select("id", F.col("held").alias("new")), "id", "full_outer")
            before = F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("held"))
            taken = F.col("new").isNotNull()
            return at.select("id", F.coalesce("new", "held").alias("held"), F.when(taken, F.lit(number)).otherwise(F.col("batch")).cast("long").alias("batch"), F.when(taken, before).otherwise(F.col("before")).alias("before"))

        keyed.update(table, fresh, ["id"], schema, merge)

    return _each_batch(changed, handle, checkpoint)


def windowed_requests(requests: DataFrame, length: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Requests per tenant and class in event-time windows; requests: (ts, tenant_id, route_class)."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return requests.withWatermark("ts", late).groupBy(window.alias("w"), "tenant_id", "route_class").agg(F.count("*").alias("n"))


def run_alerts(events: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Outcome and alert of each run from its events so far; a pivot isn't allowed on streams, so counts are named."""
    counts = events.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == c).alias(c) for c in usage.OUTCOMES])
    return usage.run_summary(counts, threshold).where("alert is not null")


class _Buckets(StatefulProcessor):
    """The token bucket of each key. It is full after a minute without a request, so a timer drops it then."""

    def __init__(self, rate: float):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows of one micro-batch may come in many frames, in any order; the source's rate bounds them
        got = pd.concat([p[["ts", "id"]] for p in rows], ignore_index=True).sort_values(["ts", "id"])
        bucket = usage.Bucket(self.rate, *(self.bucket.get() if self.bucket.exists() else (None, None)))
        took = [bucket.take(x) for x in got["ts"].astype("datetime64[us]").astype("int64") / 1e6]
        self.bucket.update((float(bucket.tokens), float(bucket.at or 0.0)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((bucket.at or 0.0) * 1000) + 60_000)
        yield pd.DataFrame({"key": [key[0]] * len(got), "id": got["id"].to_numpy(), "ok": [x[0] for x in took], "retry_after": [x[1] for x in took]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "ok": pd.Series(dtype=bool), "retry_after": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


class _Trail(StatefulProcessor):
    """The times of each key's requests in the last window. A timer drops those that the watermark has left behind."""

    def __init__(self, seconds: int):
        self.window = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "at array<bigint>, id array<bigint>")

    def _keep(self, at: np.ndarray, ids: np.ndarray, since: int) -> None:
        at, ids = at[at >= since], ids[at >= since]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(at):
            self.times.update((at.tolist(), ids.tolist()))
            self.handle.registerTimer(int(at[0] + self.window) // 1000 + 1)  # when the first of them is too old for any row that may come
        else:
            self.times.clear()

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.times.get() if self.times.exists() else ([], [])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([p[["ts", "id"]] for p in rows], ignore_index=True)
        new_at, new_id = new["ts"].astype("datetime64[us]").astype("int64").to_numpy(), new["id"].to_numpy()
        at, ids = self._held()
        at, ids = np.concatenate((at, new_at)), np.concatenate((ids, new_id))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        place = place[len(at) - len(new) :]
        used = place - np.searchsorted(at, new_at - self.window)
        self._keep(at, ids, timerValues.getCurrentWatermarkInMs() * 1000 - self.window)
        yield pd.DataFrame({"key": [key[0]] * len(new), "id": new_id, "used": used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(*self._held(), timerValues.getCurrentWatermarkInMs() * 1000 - self.window)
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "used": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def _by_key(requests: DataFrame, late: str):
    return requests.select(F.col("key").cast("string"), "id", "ts").withWatermark("ts", late).groupBy("key")


def rate_limit_stream(requests: DataFrame, rate: float, late: str = LATE) -> DataFrame:
    """requests (key, id, ts) with ok and retry_after; a key's rows of a micro-batch go by time.

    The bucket of a key is state until the watermark is a minute past its last request. A row later than the watermark
    is dropped; one that is late but not so late finds the bucket as it is. Start it by ``append_to`` with state=True.
    """
    return _by_key(requests, late).transformWithStateInPandas(_Buckets(rate), "key string, id long, ok boolean, retry_after long", "Append", "EventTime")


def trailing_requests_stream(requests: DataFrame, seconds: int = 86_400, late: str = LATE) -> DataFrame:
    """requests (key, id, ts) with ``used``, as ``usage.trailing_requests`` has it, from the requests that have come by then.

    A row counts those that came before it or with it; one that comes late is counted by later ones, and what was sent out
    isn't changed. Rows later than the watermark are dropped. State is the times of the last window, and
    keys without any leave it.
    """
    return _by_key(requests, late).transformWithStateInPandas(_Trail(seconds), "key string, id long, used long", "Append", "EventTime")


def append_to(stream: DataFrame, out: str, checkpoint: str, state: bool = False) -> StreamingQuery:
    """``state``: the stream keeps state of its own with timers, which needs the store that can list it."""
    if state:
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The whole result after each batch, for small aggregates such as alerts."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
