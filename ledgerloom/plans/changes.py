"""Change capture over two snapshots of the documents: the old one lacks some, the new one has other sources."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators import changes as ch
from .base import NOW, datasets, query, t

def k() -> Column:
    return F.col("doc_id")


FIELDS = ["title", "publisher", "tags"]
OLD_SQL = """old AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, source AS publisher, lang AS tags,
    CASE WHEN doc_id % 19 = 0 THEN 'withdrawn' ELSE 'active' END AS lifecycle, '2025-01-01' AS first_seen_at, '2025-06-01' AS lifecycle_changed_at FROM documents WHERE doc_id % 17 <> 0)"""
NEW_SQL = """new AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 13 = 0 THEN 'moved' ELSE source END AS publisher,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS tags FROM documents WHERE doc_id % 23 <> 0)"""


def old(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where(k() % 17 != 0).select(
        k().cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("publisher"), F.col("lang").alias("tags"),
        F.when(k() % 19 == 0, "withdrawn").otherwise("active").alias("lifecycle"), F.lit("2025-01-01").alias("first_seen_at"), F.lit("2025-06-01").alias("lifecycle_changed_at"),
    )


def new(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where(k() % 23 != 0).select(
        k().cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.when(k() % 13 == 0, "moved").otherwise(F.col("source")).alias("publisher"), F.when(k() % 11 != 0, F.col("lang")).alias("tags"),
    )


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.publisher ELSE n.publisher END AS publisher,
        CASE WHEN n.id IS NULL THEN o.tags ELSE n.tags END AS tags, CASE WHEN n.id IS NULL THEN o.lifecycle ELSE 'active' END AS lifecycle,
        coalesce(first_seen_at, '2026-02-01') AS first_seen_at, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.lifecycle <> 'active') THEN '2026-02-01' ELSE lifecycle_changed_at END AS changed_at
        FROM old o FULL JOIN new n ON o.id = n.id"""
)
def i1_snapshot(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = ch.snapshot_upsert(old(spark, d), new(spark, d), F.lit("2026-02-01"), FIELDS)
    return merged.select("id", "publisher", "tags", "lifecycle", "first_seen_at", F.col("lifecycle_changed_at").alias("changed_at"))


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT o.id, 'publisher' AS field, o.publisher AS old_value, n.publisher AS new_value FROM old o JOIN new n ON o.id = n.id WHERE o.publisher IS DISTINCT FROM n.publisher
        UNION ALL SELECT o.id, 'tags', o.tags, n.tags FROM old o JOIN new n ON o.id = n.id WHERE o.tags IS DISTINCT FROM n.tags"""
)
def i1_revisions(spark: SparkSession, d: str) -> DataFrame:
    _, revisions = ch.snapshot_upsert(old(spark, d), new(spark, d), F.lit("2026-02-01"), FIELDS)
    return revisions.select("id", "field", "old_value", "new_value")


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS id, coalesce(n.tags, o.tags) AS tags, CASE WHEN n.id IS NULL THEN o.publisher ELSE n.publisher END AS publisher
        FROM old o FULL JOIN new n ON o.id = n.id"""
)
def i2_coalescing_upsert(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "tags", "publisher"]
    return ch.coalescing_upsert(old(spark, d).select(*cols), new(spark, d).select(*cols), ["id"], replaced=["publisher"])


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT o.id, coalesce(n.tags, o.tags) AS detected_format, o.publisher AS etag FROM old o LEFT JOIN new n ON o.id = n.id"""
)
def i3_record_capture(spark: SparkSession, d: str) -> DataFrame:
    """Captures carry a detected format and no entity tag, which then stays."""
    known = old(spark, d).select("id", F.col("tags").alias("detected_format"), F.col("publisher").alias("etag"))
    seen = new(spark, d).join(known.select("id"), "id", "left_semi").select("id", F.col("tags").alias("detected_format"), F.lit(None).cast("string").alias("etag"))
    return ch.coalescing_upsert(known, seen, ["id"])


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS subject, CASE WHEN n.id IS NULL OR (n.text = '' AND o.text <> '') THEN o.text ELSE n.text END AS text
        FROM (SELECT id, tags AS text FROM old) o FULL JOIN (SELECT id, CASE WHEN publisher = 'moved' THEN '' ELSE upper(publisher) END AS text FROM new WHERE tags IS NOT NULL) n ON o.id = n.id"""
)
def i4_translations(spark: SparkSession, d: str) -> DataFrame:
    key = [F.lit("title").alias("kind"), F.col("id").alias("subject"), F.lit("x").alias("translator")]
    was = old(spark, d).select(*key, F.col("tags").alias("text"))
    now = new(spark, d).select(*key, F.when(F.col("publisher") == "moved", "").otherwise(F.upper("publisher")).alias("text"), F.coalesce("tags", F.lit("  ")).alias("source"))
    return ch.translation_upsert(was, now).select("subject", "text")


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS resource_id, '1' AS curator_version, coalesce(o.first_seen_at, '2026-02-01') AS created_at, coalesce(n.publisher, o.publisher) AS path FROM old o FULL JOIN new n ON o.id = n.id"""
)
def i5_artifacts(spark: SparkSession, d: str) -> DataFrame:
    key = [F.col("id").alias("resource_id"), F.lit("1").alias("curator_version")]
    was = old(spark, d).select(*key, F.col("first_seen_at").alias("created_at"), F.col("publisher").alias("path"))
    now = new(spark, d).select(*key, F.lit("2026-02-01").alias("created_at"), F.col("publisher").alias("path"))
    return ch.coalescing_upsert(was, now, ["resource_id", "curator_version"], kept=["created_at"])


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT o.id, o.title, CASE WHEN n.id IS NOT NULL THEN n.publisher ELSE o.publisher END AS publisher FROM old o LEFT JOIN new n ON o.id = n.id""")
def i6_refresh(spark: SparkSession, d: str) -> DataFrame:
    return ch.refresh_metadata(old(spark, d), new(spark, d).select("id", "publisher"), ["publisher"]).select("id", "title", "publisher")


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT id, 'withdrawn' AS lifecycle, 'absent_from_source' AS reason FROM old WHERE lifecycle = 'active' AND id NOT IN (SELECT id FROM new)""")
def d5_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    return ch.withdrawn(old(spark, d), new(spark, d))


@query("SELECT id FROM datasets WHERE lifecycle = 'active' AND NOT (publisher_id = 'src4' OR list_contains(tags, 'fr'))", "datasets")
def d6_out_of_scope(spark: SparkSession, d: str) -> DataFrame:
    return ch.out_of_scope(datasets(spark, d), catalog.scope_predicate(publishers=["src4"], tags=["fr"])).select("id")


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT id, CAST(id AS BIGINT) AS position FROM old UNION ALL
        SELECT id, (SELECT max(CAST(id AS BIGINT)) FROM old) + row_number() OVER (ORDER BY id) FROM new WHERE id NOT IN (SELECT id FROM old)"""
)
def d7_frozen(spark: SparkSession, d: str) -> DataFrame:
    frozen = old(spark, d).select("id", F.col("id").cast("long").alias("position"))
    return ch.reconcile_frozen(frozen, new(spark, d).select("id"))[0].select("id", "position")


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT id FROM old WHERE id NOT IN (SELECT id FROM new)""")
def d7_vanished(spark: SparkSession, d: str) -> DataFrame:
    frozen = old(spark, d).select("id", F.col("id").cast("long").alias("position"))
    return ch.reconcile_frozen(frozen, new(spark, d).select("id"))[1]


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT DISTINCT id FROM (SELECT id FROM old UNION ALL SELECT id FROM new) WHERE id NOT IN (SELECT id FROM new WHERE tags IS NOT NULL)""")
def d8_orphans(spark: SparkSession, d: str) -> DataFrame:
    return ch.index_orphans(new(spark, d).where("tags is not null"), old(spark, d), new(spark, d))


@query("""SELECT source AS dataset_id, sha256(text) AS sha256 FROM documents GROUP BY 1, 2 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)""")
def h3_new_content(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select(F.col("source").alias("dataset_id"), F.lit("r").alias("resource_id"), F.sha2("text", 256).alias("sha256"), k())
    stored = rows.where(k() % 5 == 0).select("sha256").distinct()
    known = rows.join(stored, "sha256", "left_semi").select("dataset_id", "resource_id", "sha256").distinct()
    return ch.new_content(rows, known).select("dataset_id", "sha256")


@query(
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
)
def f7_last_write(spark: SparkSession, d: str) -> DataFrame:
    return ch.latest_by(t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


def _index_tables(spark: SparkSession, d: str):
    docs = new(spark, d).select("id", F.sha2(F.concat_ws("|", "title", "publisher", "tags"), 256).alias("content_fp"), F.sha2("title", 256).alias("embed_fp"), F.when(F.length("title") % 7 == 0, " ").otherwise(F.col("title")).alias("embed_text"))
    was = old(spark, d)
    ledger = was.select("id", F.sha2(F.concat_ws("|", "title", "publisher", "tags"), 256).alias("content_fp"), F.sha2(F.when(F.col("tags") == "de", "x").otherwise(F.col("title")), 256).alias("embed_fp"), F.when(F.col("tags") == "fr", "m#16").otherwise("m#32").alias("model_id"))
    return docs, ledger, was.select("id"), was.where("publisher <> 'src5'").select("id")


ACTIONS_SQL = f"""WITH {OLD_SQL}, {NEW_SQL}, actions AS (SELECT n.id,
    CASE WHEN o.id IS NOT NULL AND concat_ws('|', n.title, n.publisher, n.tags) = concat_ws('|', o.title, o.publisher, o.tags) THEN 'skip' ELSE 'update' END AS keyword,
    CASE WHEN length(n.title) % 7 = 0 THEN 'empty_text' WHEN o.id IS NULL OR o.publisher = 'src5' OR (o.tags = 'de' AND o.title <> 'x') THEN 'embedded'
         WHEN o.tags = 'fr' THEN 'model_change' ELSE 'skip' END AS vector FROM new n LEFT JOIN old o ON o.id = n.id)"""


@query(f"{ACTIONS_SQL} SELECT id, keyword, vector FROM actions")
def i8_index_actions(spark: SparkSession, d: str) -> DataFrame:
    return ch.index_actions(*_index_tables(spark, d), "m#32").select("id", "keyword", "vector")


@query(
    f"""{ACTIONS_SQL} SELECT count(*) FILTER (keyword = 'update') AS keyword_updated, count(*) FILTER (vector IN ('embedded', 'model_change')) AS vectors, count(*) FILTER (vector = 'embedded') AS embedded,
        count(*) FILTER (vector = 'model_change') AS re_embedded, count(*) FILTER (keyword = 'skip' AND vector = 'skip') AS skipped, count(*) FILTER (vector = 'empty_text') AS empty,
        (SELECT count(*) FROM old WHERE id NOT IN (SELECT id FROM new)) AS purged FROM actions"""
)
def e24_index_counters(spark: SparkSession, d: str) -> DataFrame:
    docs, ledger, kw, vec = _index_tables(spark, d)
    return ch.index_counters(ch.index_actions(docs, ledger, kw, vec, "m#32"), ch.index_orphans(docs, kw, vec))


@query(f"""{ACTIONS_SQL} SELECT id, 'm#32' AS model_id FROM actions WHERE vector <> 'empty_text' UNION ALL
    SELECT o.id, CASE WHEN tags = 'fr' THEN 'm#16' ELSE 'm#32' END FROM old o WHERE o.id IN (SELECT id FROM actions WHERE vector = 'empty_text')""")
def i9_next_ledger(spark: SparkSession, d: str) -> DataFrame:
    """After the run every processed document has the current model; running it again changes nothing (see the tests)."""
    docs, ledger, kw, vec = _index_tables(spark, d)
    actions = ch.index_actions(docs, ledger, kw, vec, "m#32")
    return ch.next_ledger(actions, ledger, actions.where("1 = 0"), "m#32").select("id", "model_id")


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT id, sha256(concat_ws('|', title, publisher, tags)) AS content_fp, sha256(title) AS embed_fp, 'm#32' AS model_id FROM new WHERE length(title) % 7 <> 0"""
)
def i9_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of a full rebuild; the tests hold it against a sequence of increments."""
    return ch.rebuild(_index_tables(spark, d)[0], "m#32")[1]


@query(f"""{ACTIONS_SQL} SELECT id, 'empty_text' AS reason FROM actions WHERE vector = 'empty_text' UNION ALL SELECT id, 'timeout' FROM old WHERE publisher = 'src6' AND id NOT IN (SELECT id FROM actions)""")
def i10_failures(spark: SparkSession, d: str) -> DataFrame:
    docs, ledger, kw, vec = _index_tables(spark, d)
    actions = ch.index_actions(docs, ledger, kw, vec, "m#32")
    was = old(spark, d).where("publisher = 'src6'").select("id", F.lit("timeout").alias("reason"))
    failed = actions.where("vector = 'empty_text'").select("id", F.col("vector").alias("reason"))
    return ch.failure_ledger(was, failed, actions.where("vector <> 'empty_text'"))


@query(
    """SELECT position, id FROM (SELECT doc_id AS position, CAST(doc_id AS VARCHAR) AS id, doc_id % 6 = 0 AS failed, doc_id % 4 AS attempts FROM documents)
       WHERE (failed AND attempts < 2) OR (NOT failed AND position > 300) ORDER BY position LIMIT 200"""
)
def i11_session(spark: SparkSession, d: str) -> DataFrame:
    frozen = t(spark, d, "documents").select(k().alias("position"), k().cast("string").alias("id"))
    ledger = t(spark, d, "documents").where(k() % 2 == 0).select(k().cast("string").alias("id"), F.when(k() % 6 == 0, "failed").otherwise("complete").alias("outcome"), (k() % 4).alias("attempts"))
    return ch.plan_session(frozen, ledger, 300, 2, True, 200)


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT n.id FROM new n JOIN old o ON o.id = n.id AND n.publisher = o.publisher WHERE CAST(n.id AS BIGINT) IN (SELECT l_orderkey FROM lineitem)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) = n.id AND l_returnflag = 'R')""")
def i12_unchanged(spark: SparkSession, d: str) -> DataFrame:
    fresh = new(spark, d).select("id", F.col("publisher").alias("validator"))
    was = old(spark, d).select("id", F.col("publisher").alias("validator"))
    res = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("outcome"))
    return ch.unchanged(fresh, was, res.join(was, "id"))


@query(
    f"""WITH {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'success' WHEN n.tags IS NULL THEN 'failed' ELSE 'success' END AS outcome,
        CAST(CASE WHEN n.id IS NULL THEN 3 WHEN n.tags IS NULL THEN CASE WHEN o.id IS NULL THEN 0 ELSE 3 END + 1 ELSE 0 END AS INTEGER) AS attempts FROM old o FULL JOIN new n ON o.id = n.id"""
)
def i13_capture_ledger(spark: SparkSession, d: str) -> DataFrame:
    was = old(spark, d).select("id", F.lit("success").alias("outcome"), F.col("publisher").alias("validator"), F.lit(3).alias("attempts"))
    run = new(spark, d).select("id", F.when(F.col("tags").isNull(), "failed").otherwise("success").alias("outcome"), F.col("publisher").alias("validator"))
    return ch.capture_ledger(was, run).select("id", "outcome", "attempts")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, CASE WHEN day(min(ts)) % 3 = 0 THEN 'failed' ELSE 'success' END AS outcome, CASE WHEN day(min(ts)) % 3 = 0 THEN 'abandoned' END AS note FROM events GROUP BY 1""")
def i14_abandoned(spark: SparkSession, d: str) -> DataFrame:
    runs = t(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("run_id")).agg(F.max("ts").cast("timestamp").alias("end"))
    is_open = F.dayofmonth(F.col("run_id").cast("date")) % 3 == 0
    runs = runs.select("run_id", F.when(~is_open, F.col("end")).alias("ended_at"), F.when(~is_open, "success").alias("outcome"), F.lit(None).cast("string").alias("note"))
    return ch.abandon_stale(runs, F.lit(NOW).cast("timestamp")).select("run_id", "outcome", "note")
