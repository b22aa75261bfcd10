"""The lasting vector index equals the full product after any run, for ids of any type, and opens few blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search as se
from ledgerloom.operators import vector_index as vi
from ledgerloom.plans import registry

SCHEMA = "id string, vector array<double>"


def brute(docs, queries, top):
    ids = sorted(docs)
    x = np.array([docs[i] for i in ids])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    out = []
    for k, v in queries.items():
        v = np.array(v) / (np.linalg.norm(v) or 1)
        s = np.round(x @ v, 9) + 0.0
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:top]
        out += [(k, ids[i], round(float(s[i]), 7), n + 1) for n, i in enumerate(order)]
    return sorted(out)


def found(hits):
    return sorted((r["query_id"], r["id"], round(r["score"] + 0.0, 7), r["rank"]) for r in hits.collect())


@pytest.fixture(scope="module")
def base():
    return np.random.default_rng(1).normal(size=(12, 6))


def test_runs_equal_the_full_product(spark, base, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "QUERIES", 4)
    rng, path, docs = np.random.default_rng(2), str(tmp_path / "index"), {}

    def some(ids):
        rows = [(f"v{i}", (base[i % 12] + rng.normal(size=6) * 0.05).tolist()) for i in ids]
        docs.update(rows)
        return rows

    odd = [("n1", None), ("n2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("n3", [float("nan")] * 6), ("n4", [1.0]), (None, [1.0] * 6)]
    same = [(f"c{i}", base[0].tolist()) for i in range(40)]  # a hot cell of copies
    docs.update([*same, ("z", [0.0] * 6)])
    vi.build(spark.createDataFrame(some(range(600)) + same + [("z", [0.0] * 6)] + odd, SCHEMA), path, buckets=3)
    queries = {i: (base[i % 12] + rng.normal(size=6) * 0.05).tolist() for i in range(10)} | {50: [0.0] * 6, 51: base[0].tolist(), 52: (-base[3]).tolist()}
    asked = spark.createDataFrame([*queries.items(), (90, None), (91, [1.0])], "query_id long, vector array<double>")
    hits, opened = vi.search(spark, path, asked, 7)
    assert found(hits) == brute(docs, queries, 7)
    n_blocks = vi._blocks(spark, path, vi.state(spark, path)).count()
    few = {r["query_id"]: r["opened"] for r in opened.collect()}
    assert all(few[i] < n_blocks / 3 for i in range(10)) and few[50] == n_blocks
    changed, gone = some(range(560, 640)), [f"v{i}" for i in range(30)] + ["c3", "unknown", None]
    for x in gone:
        docs.pop(x, None)
    docs.pop("v100")
    for _ in range(2):  # a run that is done again changes nothing
        vi.update(path, 1, spark.createDataFrame(changed + [("v100", [float("inf")] * 6)], SCHEMA), spark.createDataFrame([(x,) for x in gone], "id string"))
    assert found(vi.search(spark, path, asked, 7)[0]) == brute(docs, queries, 7)
    table = spark.createDataFrame(list(docs.items()), SCHEMA)
    assert [(*r[:2], r[3]) for r in found(se.vector_search(spark.createDataFrame(list(queries.items()), "query_id long, vector array<double>"), table, 7))] == [(*r[:2], r[3]) for r in brute(docs, queries, 7)]


def test_no_vectors_and_one(spark, tmp_path):
    none = spark.createDataFrame([], "id int, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<float>")
    vi.build(none, path := str(tmp_path / "none"))
    assert vi.search(spark, path, asked)[0].count() == 0
    vi.build(spark.createDataFrame([(5, [2.0, 2.0])], "id int, vector array<float>"), path := str(tmp_path / "one"))
    assert [tuple(r) for r in vi.search(spark, path, asked)[0].collect()] == [("q", 5, 1.0, 1)]


def test_all_close_pairs(spark, tmp_path, monkeypatch):
    """A query with more than 50 close vectors keeps them all; odd vectors are close to nothing."""
    monkeypatch.setattr(se, "QUERY_BLOCK", 2)
    monkeypatch.setattr(se, "CLOSE_ROWS", 37)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[:150] = x[0] + rng.normal(size=(150, 6)) * 0.1  # near copies
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::100] @ unit.T
    want = sorted((100 * int(q), int(i)) for q, i in zip(*np.nonzero(s > 0.2), strict=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["b20_close_pairs"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(len(want), 4)] and sum(q == 0 for q, _ in want) > 150 > 50
    odd = [(500, None), (600, [0.0] * 6), (700, [1.0]), (800, [None] * 6), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (None, x[0].tolist())]
    more = spark.createDataFrame(rows + odd, "id long, vector array<double>")
    pairs = se.close_vectors(more.where("id % 100 = 0").select(more.id.alias("query_id"), "vector"), more, 0.2).collect()
    assert sorted((r["query_id"], r["id"]) for r in pairs) == sorted([*want, (700, 700)])
    assert all(abs(r["score"] - (s[r["query_id"] // 100, r["id"]] if r["id"] < 400 else 1)) < 1e-9 for r in pairs)
    twice = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where("id % 100 = 0")  # ids and rows that repeat
    twice = twice.unionByName(twice)
    assert se.close_vectors(twice.select(twice.id.alias("query_id"), "vector"), twice, 0.2).count() == 4 * sum(i % 100 == 0 for _, i in want)
    assert se.close_vectors(more.limit(0).select(more.id.alias("query_id"), "vector"), more, 0.2).count() == 0
