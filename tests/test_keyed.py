"""Keyed tables: a batch rewrites the buckets of its keys alone, and doing it again changes nothing."""

from pathlib import Path

from pyspark.sql import types as T

from ledgerloom.operators import changes, keyed
from ledgerloom.streaming import jobs

SCHEMA = T.StructType().add("id", T.StringType()).add("v", T.StringType()).add("w", T.IntegerType())


def files_of(path):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(path).glob("bucket=*/*.parquet")}


def test_only_touched_buckets_change(spark, tmp_path):
    path, rows = str(tmp_path / "t"), {f"k{i}": (f"k{i}", f"a{i}", i) for i in range(200)}
    keyed.create(spark.createDataFrame(list(rows.values()), SCHEMA), path, ["id"], 16)
    merge = lambda old, new: changes.coalescing_upsert(old, new, ["id"])
    was = files_of(path)
    new = [("k3", "b", None), ("new", "c", 7)]
    for _ in range(2):
        numbers = keyed.update(path, spark.createDataFrame(new, SCHEMA), ["id"], SCHEMA, merge, 16)
    now = files_of(path)
    assert len(numbers) <= 2 and {k for k in now if now[k] != was.get(k)} == {f"bucket={n}" for n in numbers}
    rows |= {"k3": ("k3", "b", 3), "new": ("new", "c", 7)}
    assert sorted(map(tuple, keyed.read(spark, path, SCHEMA).collect())) == sorted(rows.values())
    some = keyed.read(spark, path, SCHEMA, numbers)
    assert {r["id"] for r in some.collect()} >= {"k3", "new"} and some.count() < 60
    assert keyed.update(path, spark.createDataFrame([], SCHEMA), ["id"], SCHEMA, merge, 16) == [] and files_of(path) == now


def test_index_batches_run_again(spark, tmp_path, monkeypatch):
    """Batches that run twice, the second time after their own writes, give the actions of batches that run once."""
    schema = "id string, version int, content_fp string, embed_fp string, embed_text string"
    ledger = spark.createDataFrame([("a", "c", "e", "m"), ("b", "c", "e", "old")], "id string, content_fp string, embed_fp string, model_id string")
    stores = [spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["a", "b", "x"], ["a", "b"])]
    batches = [[("a", 1, "c", "e", "t"), ("b", 1, "c", "e", "t"), ("n", 1, "c", "e", "t"), ("x", 1, "c", "e", " ")], [("a", 2, "c2", "e", "t"), ("n", 2, "c", "e", "t"), ("x", 2, "c", "e", "t")]]
    results = []
    for times in (1, 2):
        def each(stream, handle, checkpoint, times=times):
            for number, rows in enumerate(batches):
                for _ in range(times):
                    handle(spark.createDataFrame(rows, schema), number)

        monkeypatch.setattr(jobs, "_each_batch", each)
        out = f"{tmp_path}/out{times}"
        jobs.index_stream(None, ledger, *stores, "m", out, "unused")
        results.append(sorted((r["batch"], r["id"], r["keyword"], r["vector"]) for r in spark.read.parquet(f"{out}/actions").collect()))
    assert results[0] == results[1] == [
        (0, "a", "skip", "skip"), (0, "b", "skip", "model_change"), (0, "n", "update", "embedded"), (0, "x", "update", "empty_text"),
        (1, "a", "update", "skip"), (1, "n", "skip", "skip"), (1, "x", "update", "embedded"),
    ]
