"""Every registered query runs at the smallest scale; those with SQL agree with DuckDB there."""

import hashlib
import math

import duckdb
import pytest

from ledgerloom.plans import registry, search

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or repr(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_embeds_whole_texts_of_all(spark, sf):
    """Every document has its own vector or reason, made of its whole text, unless the run before it already had it."""
    docs = {str(r["doc_id"]): r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["id"]: r for r in registry.QUERIES["k8_embed_vectors"](spark, sf).collect()}
    assert set(got) == {k for k, r in docs.items() if r["lang"] in ("de", "fr") or r["source"] == "src5" or not r["text"].strip(" ")}
    seen = set()
    for k, row in got.items():
        text = docs[k]["text"]
        title = text.split("\n")[0]
        whole = "\n".join(x for x in (title, f"alpha: {title[:20]}" if int(k) % 3 == 0 else "", text) if x.strip(" "))
        digest = hashlib.md5(whole.encode()).hexdigest()
        vector = hashlib.md5(f"{len(whole)},{int(digest[:5], 16)},{int(digest[5:10], 16)}".encode()).hexdigest()
        bad = "(19" in whole or "%%%" in whole
        assert (row["reason"], row["vector"]) == (("ValueError: refused", None) if bad else ("ok", vector) if whole.strip(" ") else ("empty_text", None))
        seen.add(row["reason"])
    assert {int(k) % 3 for k in got} == {0, 1, 2} and "ok" in seen


def test_grounding_packs_are_whole(spark, sf):
    """Packs hold all lines of their hits up to 1000 a resource and 90,000 characters in all, far beyond 20 lines and 3000 characters."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hits = search.hybrid(spark, sf, 5).where("rank <= 3").collect()
    got = {r["query_id"]: r["pack"] for r in registry.QUERIES["k7_grounding_pack"](spark, sf).collect()}
    longest = most = 0
    for q in {r["query_id"] for r in hits}:
        pack, used = [], 0
        for r in sorted((r for r in hits if r["query_id"] == q and r["id"] in texts), key=lambda r: r["rank"]):
            lines = texts[r["id"]].split("\n")[:1000]
            most = max(most, len(lines))
            for line in lines:
                used += len(line) + 1
                if used <= 90_000 or not pack:
                    pack.append(line)
        longest = max(longest, used)
        assert got.pop(q, None) == (hashlib.md5("\n".join(pack).encode()).hexdigest() if pack else None)
    assert not got and longest > 3000 and most > 20


def test_every_fiftieth_vector_is_searched(spark, sf):
    """K2 asks with each vector whose id is divisible by 50 and gives its first 50 hits."""
    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r["query_id"]: r["count"] for r in registry.QUERIES["k2_vector"](spark, sf).groupBy("query_id").count().collect()}
    assert got == {i: min(50, len(ids)) for i in ids if i % 50 == 0}


def test_every_fiftieth_vector_counts_for_recall(spark, sf):
    """E20 scores each vector whose id is divisible by 50."""
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert sum(r["queries"] for r in registry.QUERIES["e20_recall"](spark, sf).collect()) == n
