"""Change capture, keyed merges and ledgers, as joins of an old and a new table.

Parquet tables have no MERGE: every job returns the merged table, to be written to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACKED = ["title", "description", "publisher", "license", "tags", "groups", "source_url", "metadata_modified"]


def _pair(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer join: the key, struct o of the old row and n of the new one, null where missing."""
    o = old.select(*key, F.struct(*old.columns).alias("o"))
    n = new.select(*key, F.struct(*new.columns).alias("n"))
    return o.join(n, list(key), "full_outer")


def snapshot_upsert(old: DataFrame, new: DataFrame, now: Column, tracked: Sequence[str] = TRACKED) -> tuple[DataFrame, DataFrame]:
    """The merged datasets and one revision per changed field.

    old has the tracked fields, lifecycle, first_seen_at and lifecycle_changed_at; new the tracked fields.
    A dataset seen before keeps first_seen_at; one that comes back becomes active at ``now``.
    Revisions: (id, field, old_value, new_value, observed_at); a new dataset makes none.
    """
    at = _pair(old, new, ["id"])
    known = F.col("o").isNotNull()
    seen = F.col("n").isNotNull()
    fields = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in tracked]
    back = seen & (~known | (F.col("o.lifecycle") != "active"))
    merged = at.select(
        "id",
        *fields,
        F.when(seen, "active").otherwise(F.col("o.lifecycle")).alias("lifecycle"),
        F.coalesce("o.first_seen_at", now).alias("first_seen_at"),
        F.when(back, now).otherwise(F.col("o.lifecycle_changed_at")).alias("lifecycle_changed_at"),
    )
    text = lambda c: c.cast("string")
    changes = F.array(*[F.struct(F.lit(c).alias("field"), text(F.col(f"o.{c}")).alias("old_value"), text(F.col(f"n.{c}")).alias("new_value")) for c in tracked])
    rows = at.where(known & seen).select("id", F.explode(changes).alias("c")).select("id", "c.*")
    return merged, rows.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("observed_at", now)


def coalescing_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], replaced: Sequence[str] = (), kept: Sequence[str] = ()) -> DataFrame:
    """Keyed merge in which a null of the new row keeps the old value; ``replaced`` columns are taken even when null, ``kept`` ones stay as first written."""
    at = _pair(old, new, key)
    out = []
    for c in old.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            out.append(F.col(c))
        elif c in replaced:
            out.append(F.when(F.col("n").isNotNull(), n).otherwise(o).alias(c))
        else:
            out.append((F.coalesce(o, n) if c in kept else F.coalesce(n, o)).alias(c))
    return at.select(*out)


def translation_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, subject, translator, text): blank sources are skipped, an empty text never replaces one that isn't. new has source too."""
    at = _pair(old, new.where(F.trim("source") != "").drop("source"), ["kind", "subject", "translator"])
    keep = F.col("n").isNull() | ((F.coalesce("n.text", F.lit("")) == "") & (F.coalesce("o.text", F.lit("")) != ""))
    return at.select("kind", "subject", "translator", F.when(keep, F.col("o.text")).otherwise(F.col("n.text")).alias("text"))


def refresh_metadata(old: DataFrame, stamps: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Overwrites ``columns`` of known ids with the stamps' values; unknown ids are ignored, everything else stays."""
    fresh = stamps.select(F.col("id").alias("__id"), F.struct(*columns).alias("__s"))
    at = old.join(fresh, F.col("id") == F.col("__id"), "left")
    for c in columns:
        at = at.withColumn(c, F.when(F.col("__id").isNotNull(), F.col(f"__s.{c}")).otherwise(F.col(c)))
    return at.drop("__id", "__s")


def withdrawn(datasets: DataFrame, observed: DataFrame) -> DataFrame:
    """Active datasets that the source no longer lists, with the reason."""
    gone = datasets.where("lifecycle = 'active'").join(observed.select("id").distinct(), "id", "left_anti")
    return gone.select("id", F.lit("withdrawn").alias("lifecycle"), F.lit("absent_from_source").alias("reason"))


def withdraw_resources(resources: DataFrame, gone: DataFrame) -> DataFrame:
    """Resources follow their dataset."""
    return resources.join(gone.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")


def out_of_scope(datasets: DataFrame, scope: Column) -> DataFrame:
    return datasets.where("lifecycle = 'active'").where(~scope)


def reconcile_frozen(frozen: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(position, id) with additions behind the last position, and the ids that vanished.

    Additions get dense numbers without one task holding them: by ranges, then within them.
    """
    from .catalog import with_place

    added = live.select("id").distinct().join(frozen.select("id"), "id", "left_anti")
    last = frozen.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("last"))  # one row
    placed = with_place(added, [F.asc("id")]).join(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("position"), "id")
    return frozen.select("position", "id").unionByName(placed), frozen.select("id").join(live, "id", "left_anti")


def index_orphans(active: DataFrame, *stores: DataFrame) -> DataFrame:
    """Ids in any index store that aren't active."""
    every = stores[0].select("id")
    for s in stores[1:]:
        every = every.unionByName(s.select("id"))
    return every.distinct().join(active.select("id"), "id", "left_anti")


def new_content(captured: DataFrame, known: DataFrame) -> DataFrame:
    """Captured rows (dataset_id, resource_id, sha256, ...) whose content isn't stored yet, once each."""
    key = ["dataset_id", "resource_id", "sha256"]
    return captured.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def index_actions(documents: DataFrame, ledger: DataFrame, keyword_store: DataFrame, vector_store: DataFrame, model_id: str) -> DataFrame:
    """What an incremental index run does to each document.

    documents: (id, content_fp, embed_fp, embed_text); ledger: (id, content_fp, embed_fp, model_id); stores: (id).
    keyword: 'update' or 'skip'. vector: 'empty_text', 'embedded' (text new, changed, or vector missing),
    'model_change' (same text, other model) or 'skip'.
    """
    led = ledger.select("id", F.struct("content_fp", "embed_fp", "model_id").alias("l"))
    kw = keyword_store.select("id", F.lit(True).alias("in_kw")).distinct()
    vec = vector_store.select("id", F.lit(True).alias("in_vec")).distinct()
    at = documents.join(led, "id", "left").join(kw, "id", "left").join(vec, "id", "left")
    keyword = F.when(F.col("in_kw") & (F.col("l.content_fp") == F.col("content_fp")), "skip").otherwise("update")
    same_text = F.coalesce(F.col("in_vec") & (F.col("l.embed_fp") == F.col("embed_fp")), F.lit(False))
    vector = (
        F.when(F.trim("embed_text") == "", "empty_text")
        .when(~same_text, "embedded")
        .when(F.coalesce(F.col("l.model_id") != model_id, F.lit(True)), "model_change")
        .otherwise("skip")
    )
    return at.select("id", "content_fp", "embed_fp", "embed_text", keyword.alias("keyword"), vector.alias("vector"))


def index_counters(actions: DataFrame, purged: DataFrame) -> DataFrame:
    n = purged.agg(F.count("*").alias("purged"))
    sums = actions.agg(
        F.count_if(F.col("keyword") == "update").alias("keyword_updated"),
        F.count_if(F.col("vector").isin("embedded", "model_change")).alias("vectors"),
        F.count_if(F.col("vector") == "embedded").alias("embedded"),
        F.count_if(F.col("vector") == "model_change").alias("re_embedded"),
        F.count_if((F.col("keyword") == "skip") & (F.col("vector") == "skip")).alias("skipped"),
        F.count_if(F.col("vector") == "empty_text").alias("empty"),
    )
    return sums.join(F.broadcast(n))  # two single rows


def next_ledger(actions: DataFrame, ledger: DataFrame, failed: DataFrame, model_id: str) -> DataFrame:
    """The ledger after a run: processed documents with their new fingerprints, failed ones as they were."""
    done = actions.join(failed.select("id"), "id", "left_anti").where("vector <> 'empty_text'")
    new = done.select("id", "content_fp", "embed_fp", F.lit(model_id).alias("model_id"))
    return new.unionByName(ledger.join(new.select("id"), "id", "left_anti").join(actions.select("id"), "id", "left_semi"))


def failure_ledger(old: DataFrame, failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """(id, reason): this run's reason replaces an earlier one, success clears it."""
    kept = old.join(succeeded.select("id"), "id", "left_anti").join(failed.select("id"), "id", "left_anti")
    return kept.select("id", "reason").unionByName(failed.select("id", "reason"))


def plan_session(frozen: DataFrame, ledger: DataFrame, cursor: int | None, max_attempts: int, retry: bool, most: int | None = None) -> DataFrame:
    """Next ids of a campaign in frozen order: those behind the cursor that haven't failed and, on a retry, failures under the cap wherever they are."""
    at = frozen.join(ledger.select("id", "outcome", "attempts"), "id", "left")
    failure = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    again = F.lit(retry) & failure & (F.coalesce("attempts", F.lit(0)) < max_attempts)
    ahead = ~failure & (F.col("position") > (-1 if cursor is None else cursor))
    out = at.where(again | ahead).select("position", "id").orderBy("position")
    return out.limit(most) if most is not None else out


def unchanged(fresh: DataFrame, stored: DataFrame, resources: DataFrame) -> DataFrame:
    """Ids that a resumed run may skip: same validator, at least one resource, all of them a success under it.

    fresh, stored: (id, validator); resources: (id, outcome, validator).
    """
    same = fresh.join(stored.withColumnRenamed("validator", "was"), "id").where("validator = was").select("id", "validator")
    good = resources.join(same.withColumnRenamed("validator", "now"), "id").groupBy("id")
    return good.agg(F.bool_and((F.col("outcome") == "success") & F.col("validator").eqNullSafe(F.col("now"))).alias("ok")).where("ok").select("id")


def capture_ledger(old: DataFrame, run: DataFrame) -> DataFrame:
    """Per resource: outcome, validator and attempts after a run. (id, outcome, validator, attempts)

    A success starts anew at 0 attempts, a failure adds one to what it had under any validator.
    """
    at = _pair(old, run, ["id"])
    ran = F.col("n").isNotNull()
    ok = F.col("n.outcome") == "success"
    attempts = F.when(~ran, F.col("o.attempts")).when(ok, 0).otherwise(F.coalesce("o.attempts", F.lit(0)) + 1)
    return at.select(
        "id",
        F.when(ran, F.col("n.outcome")).otherwise(F.col("o.outcome")).alias("outcome"),
        F.when(ran, F.col("n.validator")).otherwise(F.col("o.validator")).alias("validator"),
        attempts.alias("attempts"),
    )


def reusable_captures(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resources whose last success was under the current validator."""
    return wanted.join(ledger.where("outcome = 'success'").select("id", "validator"), ["id", "validator"], "left_semi")


def abandon_stale(runs: DataFrame, now: Column, note: str = "abandoned") -> DataFrame:
    """Open runs become failed, with a note."""
    open_ = F.col("ended_at").isNull()
    return (
        runs.withColumn("outcome", F.when(open_, "failed").otherwise(F.col("outcome")))
        .withColumn("note", F.when(open_, note).otherwise(F.col("note")))
        .withColumn("ended_at", F.when(open_, now).otherwise(F.col("ended_at")))
    )


def latest_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last-written row of each key."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(window)).where("__r = 1").drop("__r")


def rebuild(documents: DataFrame, model_id: str) -> tuple[DataFrame, DataFrame]:
    """(actions, ledger) of a full rebuild: an index run that knows nothing of earlier ones.

    Its ledger equals that of any sequence of incremental runs that ends with the same documents, for all that
    have a text; a document whose text became blank keeps its last ledger row only in the increments.
    """
    none = documents.where("1 = 0")
    ledger = none.select("id", "content_fp", "embed_fp", F.lit(model_id).alias("model_id"))
    actions = index_actions(documents, ledger, none.select("id"), none.select("id"), model_id)
    return actions, next_ledger(actions, ledger, none.select("id"), model_id)
