"""Tables in, tables out: small inputs with known results, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, changes, curate, entities, geo, guards, search, usage
from ledgerloom.plans import changes as changes_plan
from ledgerloom.plans import registry
from ledgerloom.sources import files, portal
from ledgerloom.streaming import jobs


def test_region_rollup(spark):
    units = spark.createDataFrame([("m1", "A", "municipality", "o1"), ("m2", "B", "municipality", "o1"), ("o1", "O1", "oblast", None), ("o2", "O2", "oblast", None), ("o3", "O3", "oblast", None)], "id string, label string, kind string, parent string")
    links = spark.createDataFrame([("d1", "o1", "x", 0.7), ("d1", "m1", "x", 0.95), ("d2", "m2", "x", 0.6), ("d2", "m2", "y", 0.5), ("d3", "o2", "x", 0.6), ("d4", "elsewhere", "x", 1.0)], "dataset_id string, entity_id string, extractor string, confidence double")
    got = {r["region"]: (r["n_datasets"], r["max_confidence"], r["has_data"]) for r in geo.region_rollup(links, units).collect()}
    assert got == {"o1": (2, 0.95, True), "o2": (1, 0.6, True), "o3": (0, 0.0, False)}
    assert sum(v[0] for v in got.values()) <= links.count()
    cited = spark.createDataFrame([("d1",), ("d3",)], "dataset_id string")
    assert {r[0] for r in geo.map_anchor(cited, links, units).collect()} == {"o1", "o2"}


@pytest.mark.parametrize("n,pairs", [(6, 15), (50, 1225), (51, 0)])
def test_links_of_a_group(spark, n, pairs):
    edges = spark.createDataFrame([(f"d{i:03}", "geo:x", "geographic_unit") for i in range(n)] * 2, "dataset_id string, entity_id string, kind string")
    links, hubs = entities.link_datasets(edges)
    assert links.count() == pairs and links.where("a >= b").count() == 0 and hubs.count() == (1 if n > 50 else 0)


def test_gazetteer_longest_pattern(spark):
    g = spark.createDataFrame([(0, "p", "Ямбол", "Ямбол", "canonical"), (1, "p", "Ямбол", "Община Ямбол", "alias"), (2, "q", "Русе", "Русе", "canonical")], "ord int, place_id string, label string, pattern string, match_type string")
    texts = spark.createDataFrame([("d1", "Бюджет на община ямбол и Русенско"), ("d2", "град ЯМБОЛ")], "dataset_id string, text string")
    got = {(r["dataset_id"], r["entity_id"]): r["confidence"] for r in entities.places_in_texts(texts, g).collect()}
    assert got == {("d1", "p"): 0.75, ("d1", "q"): 0.95, ("d2", "p"): 0.95}


def test_type_inference(spark):
    cols = {"int": ["1"] * 10, "dec": [f"{i}.5" for i in range(1000, 1010)], "date": ["2024-01-02"] * 10, "ts": ["2024-01-02T10:00"] * 10, "bool": ["да", "не", "true", "y", "no"], "mix": ["a", "1", "2024-01-02"], "none": ["", None], "most": ["1"] * 9 + ["x"]}
    rows = spark.createDataFrame([(k, v) for k, vs in cols.items() for v in vs], "k string, value string")
    got = {r["k"]: (r["type"], r["confidence"]) for r in curate.infer_types(rows, ["k"]).collect()}
    assert got == {"int": ("integer", 0.95), "dec": ("decimal", 0.95), "date": ("datetime", 0.95), "ts": ("datetime", 0.95), "bool": ("boolean", 0.95), "mix": ("string", 0.7), "none": ("string", 0.5), "most": ("integer", 0.8)}


def test_wide_table(spark):
    typed = spark.createDataFrame([(1, 0, "5"), (1, 1, "2.5"), (2, 0, "7"), (2, 1, None)], "row_no long, col_no int, typed string")
    out = curate.wide(typed, ["n", "x"], ["integer", "decimal"])
    assert out.dtypes[1:] == [("n", "bigint"), ("x", "double")] and sorted(map(tuple, out.collect())) == [(1, 5, 2.5), (2, 7, None)]


def test_delimited_cells(spark):
    data = ["id,име,стойност\n1,София,100\n2,\"a,b\",5\n".encode(), "а;б\nЯмбол;2\n".encode("cp1251"), b"PK\x03\x04broken", b"a\tb\n\n1\t2\n"]
    rows = spark.createDataFrame([(str(i), "xlsx" if b[:2] == b"PK" else "csv", bytearray(b)) for i, b in enumerate(data)], "resource_id string, parser string, content binary")
    good, bad = files.quarantine(files.cells_of(rows))
    got = {(r["resource_id"], r["row_no"]): r["cells"] for r in good.collect()}
    assert got[("0", 2)] == ["2", "a,b", "5"] and got[("1", 1)] == ["Ямбол", "2"] and got[("3", 1)] == [""] and got[("3", 2)] == ["1", "2"]
    assert [r["resource_id"] for r in bad.collect()] == ["2"]


@pytest.mark.parametrize(
    "rows,header,start",
    [
        ([["a", "b"], ["1", "2"]], ["a", "b"], 1),
        ([["G", "", "H"], ["x", "y", ""], ["1", "2", "3"]], ["G x", "G y", "H"], 2),
        ([["G", "", "H"], ["x", "y", "z"], ["p", "q", "r"]], ["G", "", "H"], 1),
        ([["a"], ["x", "y"], ["1", "2"]], ["a x", "a y"], 2),
        ([], [], 0),
    ],
)
def test_merged_header(spark, rows, header, start):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    got = df.select(portal.merged_header(F.col("rows")).alias("h")).select("h.*").first()
    assert (got["header"], got["data_start"]) == (header, start)


def test_snapshot_and_lifecycle(spark):
    cols = "id string, title string, lifecycle string, first_seen_at string, lifecycle_changed_at string"
    old = spark.createDataFrame([("a", "x", "active", "0", "0"), ("b", None, "withdrawn", "0", "0"), ("c", "z", "active", "0", "0")], cols)
    new = spark.createDataFrame([("a", "y"), ("b", None), ("d", "w")], "id string, title string")
    merged, revisions = changes.snapshot_upsert(old, new, F.lit("9"), ["title"])
    got = {r["id"]: tuple(r)[1:] for r in merged.collect()}
    assert got == {"a": ("y", "active", "0", "0"), "b": (None, "active", "0", "9"), "c": ("z", "active", "0", "0"), "d": ("w", "active", "9", "9")}
    assert [tuple(r) for r in revisions.select("id", "field", "old_value", "new_value").collect()] == [("a", "title", "x", "y")]
    assert [r["id"] for r in changes.withdrawn(old, new).collect()] == ["c"]
    again, none = changes.snapshot_upsert(merged, new, F.lit("99"), ["title"])
    assert none.count() == 0 and again.exceptAll(merged).count() == 0


def test_incremental_index_settles(spark):
    docs = spark.createDataFrame([("a", "1", "1", "t"), ("b", "2", "2", "u"), ("c", "3", "3", " ")], "id string, content_fp string, embed_fp string, embed_text string")
    ledger = spark.createDataFrame([("a", "1", "0", "m"), ("b", "2", "2", "old")], "id string, content_fp string, embed_fp string, model_id string")
    ids = docs.select("id")
    first = changes.index_actions(docs, ledger, ids, ids, "m")
    assert {r["id"]: (r["keyword"], r["vector"]) for r in first.collect()} == {"a": ("skip", "embedded"), "b": ("skip", "model_change"), "c": ("update", "empty_text")}
    then = changes.next_ledger(first, ledger, first.where("1 = 0"), "m")
    # a second run over the same documents does nothing more: incremental equals full
    second = changes.index_actions(docs, then, ids, ids, "m")
    assert {r["id"]: r["vector"] for r in second.collect()} == {"a": "skip", "b": "skip", "c": "empty_text"}


def test_session_plan(spark):
    frozen = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "position long, id string")
    ledger = spark.createDataFrame([("u0", "failed", 1), ("u1", "complete", 1), ("u4", "failed", 9)], "id string, outcome string, attempts int")
    plan = lambda **k: [r["id"] for r in changes.plan_session(frozen, ledger, 1, 3, **k).collect()]
    assert plan(retry=False) == ["u2", "u3", "u5"] and plan(retry=True) == ["u0", "u2", "u3", "u5"] and plan(retry=True, most=2) == ["u0", "u2"]


def test_tokens_by_user(spark):
    users = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, None), (3, None)], "user_id long, reset string").select("user_id", F.col("reset").cast("timestamp").alias("usage_reset_at"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5, 1), (1, "2024-01-02 00:00:00", 7, 1), (2, "2024-01-01 00:00:00", -3, 0)], "user_id long, ts string, total long, cached long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["user_id"]: (r["total"], r["turns"]) for r in usage.tokens_by_user(users, rows).collect()} == {1: (7, 1), 2: (0, 1), 3: (0, 0)}


def test_bm25_and_phrases(spark):
    docs = spark.createDataFrame([(1, "red fish", "a-b test"), (2, "fish", "a x b"), (3, "Red", "fish"), (4, "other", "words here")], "id long, title string, text string")
    q = spark.createDataFrame([(1, "red fish"), (2, "a-b"), (3, "missing fish"), (4, "FISH")], "query_id long, query string")
    hits = {(r["query_id"], r["id"]): r["rank"] for r in search.keyword_search(q, docs, ["title", "text"]).collect()}
    assert {k for k in hits} == {(1, 1), (1, 3), (2, 1), (4, 1), (4, 2), (4, 3)}
    assert sorted(v for k, v in hits.items() if k[0] == 4) == [1, 2, 3]


def test_fusion_and_recall(spark):
    k = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    v = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = [(r["id"], r["kind"]) for r in search.fuse(k, v).orderBy("rank").collect()]
    assert got == [(11, "hybrid"), (10, "keyword"), (12, "semantic")]
    asked = spark.createDataFrame([(1, "bg"), (2, "en")], "query_id long, lang string")
    expected = spark.createDataFrame([(1, 12), (2, 5)], "query_id long, id long")
    r = {x["lang"]: x["recall"] for x in search.recall(search.fuse(k, v), asked, expected).collect()}
    assert r == {"bg": 1.0, "en": 0.0} and search.misses(search.fuse(k, v), asked, expected).count() == 1


def test_guards(spark):
    u = "12345678-1234-1234-1234-1234567890ab"
    df = spark.createDataFrame([(f"{u} и {u[:-1]}c. над 2 набора", u), ("над 24 часа. Над 40 г. набор", ""), ("1+ datasets", u)], "a string, g string")
    got = df.select(guards.ghost_ids(F.col("a"), F.col("g")).alias("x"), F.size(guards.inflated_counts(F.col("a"), F.col("g"))).alias("n")).collect()
    assert [(len(r["x"]), r["n"]) for r in got] == [(1, 1), (0, 0), (0, 0)]


def test_budget_keeps_first_row(spark):
    rows = spark.createDataFrame([("r", 1, 500), ("r", 2, 1), ("s", 1, 5), ("s", 2, 5), ("s", 3, 5)], "k string, row_no int, n int")
    got = sorted((r["k"], r["row_no"]) for r in catalog.running_budget(rows, ["k"], "row_no", F.col("n"), 10).collect())
    assert got == [("r", 1), ("s", 1), ("s", 2)]


def test_rate_limit_batch_and_stream(spark, sf):
    batch = {r["id"]: (r["ok"], r["retry_after"]) for r in registry.QUERIES["l4_rate_limit"](spark, sf).collect()}
    stream = {r["id"]: (r["ok"], r["retry_after"]) for r in registry.QUERIES["l4_rate_limit_stream"](spark, sf).collect()}
    from ledgerloom.plans.base import usage as view

    want, state = {}, {}
    rows = sorted((f"{r['user_id']}:{r['route_class']}", r["ts"].timestamp(), r["event_id"]) for r in view(spark, sf).collect())
    for key, sec, i in rows:
        tokens, last = state.get(key, (1.0, sec))
        tokens = min(1.0, tokens + (sec - last) / 60)
        ok = tokens >= 1
        want[i] = (ok, 0 if ok else max(1, math.ceil((1 - tokens) * 60)))
        state[key] = (tokens - 1 if ok else tokens, sec)
    assert batch == want and stream == want


def test_rate_limit_stream_over_many_frames(spark, tmp_path):
    """A key with more rows than a frame holds, given in no order of time, and a second micro-batch: as the batch replay."""
    start = 1_000_000  # a stream with a watermark takes no rows of the epoch's first moment
    rows = [("a", i, start + (i * 7) % 40) for i in range(40)] + [("b", 100 + i, start + i) for i in range(9)]
    frame = lambda part: spark.createDataFrame(part, "key string, id long, sec int").select("key", "id", F.timestamp_seconds("sec").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        first, second = [r for r in rows if r[2] < start + 20], [r for r in rows if r[2] >= start + 20]
        for part in (first, second):
            frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("key string, id long, ts timestamp").parquet(f"{tmp_path}/in")
            jobs.append_to(jobs.rate_limit_stream(stream, 2.0), f"{tmp_path}/out", f"{tmp_path}/state", state=True).awaitTermination()
        got = {r["id"]: (r["ok"], r["retry_after"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r["id"]: (r["ok"], r["retry_after"]) for r in usage.rate_limit(frame(rows), 2.0).collect()} and len({x[0] for x in got.values()}) == 2
    late = usage.Bucket(1.0, 0.5, 100.0)
    assert late.take(40.0) == (False, 30) and late.at == 100.0


def _states(spark, path, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(path)
    return {r["key"]["key"] for r in rows.select("key").collect()}


def test_idle_buckets_and_old_requests_leave_the_state(spark, tmp_path):
    """Batches days apart: only keys that are still of use are state, and decisions are those of the batch twins."""
    day = 86_400
    parts = [[("a", 1, day), ("a", 2, day + 30), ("b", 3, day + 10)], [("a", 4, 4 * day), ("c", 5, 4 * day + 5), ("c", 6, 4 * day + 5)], [("c", 7, 4 * day + 7200), ("d", 8, 4 * day + 7300), ("c", 10, 4 * day + 7201), ("c", 9, 4 * day + 7201)]]
    frame = lambda part: spark.createDataFrame(part, "key string, id long, sec int").select("key", "id", F.timestamp_seconds("sec").alias("ts"))
    kept = []
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, id long, ts timestamp").parquet(f"{tmp_path}/in")
        jobs.append_to(jobs.rate_limit_stream(stream, 1.0), f"{tmp_path}/limit", f"{tmp_path}/limit-state", state=True).awaitTermination()
        jobs.append_to(jobs.trailing_requests_stream(stream, day), f"{tmp_path}/trail", f"{tmp_path}/trail-state", state=True).awaitTermination()
        kept.append((_states(spark, f"{tmp_path}/limit-state", "bucket"), _states(spark, f"{tmp_path}/trail-state", "times")))
    rows = frame([r for p in parts for r in p])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/limit").collect())) == sorted(map(tuple, usage.rate_limit(rows, 1.0).collect()))
    trail = sorted(map(tuple, usage.trailing_requests(rows, day, 2).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/trail").collect())) == trail
    assert {i: n for _, i, n in trail} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 2, 8: 0, 9: 3, 10: 4}
    assert kept[0] == ({"a", "b"}, {"a", "b"}) and kept[1] == ({"a", "c"}, {"a", "c"}) and kept[2][0] == {"c", "d"}


def test_trailing_requests_by_brute_force(spark):
    """Every stretch length gives the plain count, also for a hot key, repeated times and windows that end on a request."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, int(rng.integers(0, 4000))) for i in range(500)]
    frame = spark.createDataFrame(rows, "key string, id long, sec int").select("key", "id", F.timestamp_seconds("sec").alias("ts"))
    want = {i: sum(k2 == k and (s - 100 <= s2 < s or (s2 == s and i2 < i)) for k2, i2, s2 in rows) for k, i, s in rows}
    for stretch in (1, 3):
        assert {r["id"]: r["used"] for r in usage.trailing_requests(frame, 100, stretch).collect()} == want


def test_index_stream_over_batches(spark, tmp_path):
    """The latest version of an id counts, and a second batch is judged against what the first left."""
    schema = "id string, version int, content_fp string, embed_fp string, embed_text string"
    empty = spark.createDataFrame([], "id string, content_fp string, embed_fp string, model_id string")
    batches = [[("x", 1, "c1", "e1", "t"), ("x", 2, "c2", "e2", "t"), ("y", 1, "c", "e", "t"), ("z", 1, "c", "e", " ")], [("x", 3, "c3", "e2", "t"), ("y", 2, "c", "e", "t"), ("w", 1, "c", "e", "t")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.index_stream(stream, empty, empty.select("id"), empty.select("id"), "m", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["batch"], r["id"]): (r["content_fp"], r["keyword"], r["vector"]) for r in spark.read.parquet(f"{tmp_path}/out/actions").collect()}
    assert got == {
        (0, "x"): ("c2", "update", "embedded"), (0, "y"): ("c", "update", "embedded"), (0, "z"): ("c", "update", "empty_text"),
        (1, "x"): ("c3", "update", "skip"), (1, "y"): ("c", "skip", "skip"), (1, "w"): ("c", "update", "embedded"),
    }


def test_rebuild_equals_increments(spark, sf):
    """Two increments end with the ledger that a full rebuild gives, for all documents with a text; running again changes nothing."""
    docs, was, kw, vec = changes_plan._index_tables(spark, sf)
    ledger = was
    for _ in range(2):
        actions = changes.index_actions(docs, ledger, kw, vec, "m#32")
        ledger = changes.next_ledger(actions, ledger, actions.where("1 = 0"), "m#32")
        kw, vec = docs.select("id"), docs.where("trim(embed_text) <> ''").select("id")
    whole = docs.where("trim(embed_text) <> ''").select("id")
    key = lambda df: sorted(map(tuple, df.join(whole, "id", "left_semi").select("id", "content_fp", "embed_fp", "model_id").collect()))
    assert key(ledger) == key(changes.rebuild(docs, "m#32")[1]) != []
    again = changes.index_actions(docs, ledger, kw, vec, "m#32").join(whole, "id", "left_semi")
    assert again.where("keyword <> 'skip' or vector <> 'skip'").count() == 0


def test_model_is_called_once(spark):
    """A text is sent to the model once, and its row is in one of the two results."""
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if any("bad" in x for x in texts):
            raise ValueError("refused")
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(i, f"text {i}", "embedded") for i in range(50)], "id long, embed_text string, vector string")
    good, bad = search.embed_changed(rows, embed)
    assert (good.count(), bad.count(), calls.value) == (50, 0, 50)


def test_grounding_under_small_limits(spark):
    """Rows past the limit a resource, hits past the top and text past the budget stay out; a first row stays whatever its length."""
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 9, 1), (3, 5, 1)], "query_id long, id long, rank int")
    lines = [(7, 70, i, f"a{i}") for i in range(4)] + [(8, 80, 0, "bbbb"), (8, 81, 0, "c"), (9, 90, 0, "d" * 30)]
    rows = spark.createDataFrame(lines, "id long, resource_id long, row_no int, text string")
    got = dict(map(tuple, search.grounding_pack(hits, rows, top=2, per_resource=3, budget=14).collect()))
    assert got == {1: "a0\na1\na2\nbbbb", 2: "d" * 30}


def test_gazetteer_of_many_patterns(spark, monkeypatch):
    """Thousands of patterns in several blocks, overlapping ones, an empty and a null one: as plain search finds."""
    patterns = [(i, f"p{i % 900}", f"L{i % 900}", f"Kw{i}", "canonical" if i % 2 else "alias") for i in range(5000)] + [(9001, "all", "All", "", "alias"), (9002, "none", "None", None, "alias")]
    texts = [(1, "kw12 and KW4999x"), (2, "nothing"), (3, None), (4, "kw7kw77kw777"), (1, "kw3")]
    monkeypatch.setattr(entities, "PATTERN_BLOCK", 2000)
    gaz = spark.createDataFrame(patterns, "ord int, place_id string, label string, pattern string, match_type string")
    got = {(r["dataset_id"], r["place_id"]): (r["label"], r["match_type"]) for r in entities.place_matches(spark.createDataFrame(texts, "dataset_id long, text string"), gaz).collect()}
    want = {}
    for k, text in texts:
        for i, place, label, p, kind in patterns:
            if text is not None and p is not None and p.lower() in text.lower():
                best = want.get((k, place))
                if best is None or (-len(p), i) < best[0]:
                    want[(k, place)] = ((-len(p), i), (label, kind))
    assert got == {k: v[1] for k, v in want.items()}


def test_keyword_search_by_join(spark, monkeypatch):
    """Queried tokens beyond what is written into the plan give the same hits."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3}", "c d-e " * (i % 5)) for i in range(60)], "id long, title string, text string")
    asked = spark.createDataFrame([(1, "a1 b1"), (2, "d-e"), (3, "zz"), (4, "b2")], "query_id long, query string")
    key = lambda: sorted(map(tuple, search.keyword_search(asked, docs, ["title", "text"], 5).select("query_id", "id", "score", "rank").collect()))
    inline = key()
    monkeypatch.setattr(search, "MAX_INLINE_TERMS", 1)
    assert key() == inline and {r[0] for r in inline} == {1, 2, 4}


def test_sheet_slugs_and_writers(spark, tmp_path):
    taken = set()
    assert [files.sheet_slug(x, taken) for x in ("Лист 1", "ЛИСТ-1", "лист_1", "§", "")] == ["лист-1", "лист-1-1", "лист-1-2", "sheet", "sheet-1"]


def test_claims(spark):
    """A lead or a plus, the noun within reach in the same clause; a word before the digits, a new clause or a far noun make none."""
    cases = {"more  than 40 sets and datasets": [40], "повече от 30\u00a0набора": [30], "40+ datasets": [40], "40 + big datasets": [40], "x40+ datasets": [], "over 40. datasets": [], "over 40 " + "x" * 24 + "dataset": [40], "over 40 " + "x" * 25 + "dataset": [], "40 datasets": [], "над 24 часа": [], "over 5 and 6+ datasets": [5, 6]}
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string")
    got = {r["i"]: [int(x) for x in r["n"]] for r in df.select("i", guards.claimed_numbers(F.col("a")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_places_are_dense(spark):
    got = catalog.with_place(spark.range(1000).withColumn("k", F.col("id") % 10), [F.col("k").desc(), F.col("id")]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001)) and [r["id"] for r in got[:3]] == [9, 19, 29]


def test_bucketed_children_join_without_a_shuffle(spark, sf):
    from ledgerloom.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored_once = catalogue.bucketed_record(spark, sf)
        assert "Exchange" not in stored_once._jdf.queryExecution().executedPlan().toString()
        assert stored_once.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_whole_rows_are_typed_as_cells_are(spark):
    """Types meet whole rows: the same texts as cell by cell, without a row a cell; short and long rows, blanks, sheets and tables of other types."""
    rows = [
        ("a", 0, 3, ["n", "d", "x"]), ("a", 1, 3, [" 1 ", "5 май 2026", " да﻿"]), ("a", 2, 3, ["2", " 3/4/2024\n", "не", "beyond"]), ("a", 3, 3, ["3"]), ("a", 4, 3, [None, " ", ""]),
        ("b", 0, 2, ["p", "q"]), ("b", 1, 2, ["1 234,5", "1.234"]), ("b", 2, 2, ["-3", "x"]), (None, 0, 1, ["k"]), (None, 1, 1, ["2024-02-03T10:00"]),
    ]
    table = spark.createDataFrame([(r, None, n, w, c) for r, n, w, c in rows], "resource_id string, sheet string, row_no long, width int, cells array<string>")
    cells, keys = curate.long_cells(table), ["resource_id", "col_no"]
    types = curate.infer_types(cells, keys)
    want = {(r["resource_id"], r["row_no"], r["col_no"]): r["typed"] for r in curate.apply_types(cells, types, keys).collect()}
    out = curate.typed_rows(table.where("row_no > 0"), types, ["resource_id"])
    got = {(r["resource_id"], r["row_no"], i): x for r in out.collect() for i, x in enumerate(r["typed"])}
    assert got == want and len(got) == 15
    assert [got["a", 1, i] for i in range(3)] == ["1", "2026-05-05", "true"] and got["a", 2, 1] == "2024-04-03" and got["b", 1, 0] == "1234.5" and got[None, 1, 0] == "2024-02-03" and got["a", 4, 1] is None
