"""Encoding by marked words, alignment of two tokenizers and spelling variants, each against a plain version."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, pieces, queries, spelling

SF = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["a", "b", " ", " ", "▁", "\n", "\t", "'", "é", "日", "𝒳", " ", "　", "①", "<s>", "</s>", "<|endoftext|>", "0", "12", ".", "\x00", "\x1c", "‍", "👩🏽", "  ", " the", "naïve", "'s"]
FIXED = [None, "", " ", "  ", "▁", "a", " a", "a ", "\x00", "\n", "x" * 3000, "the cat " * 2000]


def odd_texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return FIXED + made + [x.replace("▁", "") for x in made]


def rows_of(spark, texts):
    """Texts with null and repeated ids and columns whose names clash with what operators add."""
    rows = [(None if i % 5 == 0 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, text string, ids int, `n_a.doc` string").repartition(3)


# ---- encoding and decoding


@pytest.fixture(scope="module")
def model():
    return pieces.WordPieces(B).model


def expected_ids(model, text):
    return np.array(model.encode(text or "", add_bos=True, add_eos=True), "<u4").tobytes()


def test_encoding_equals_the_library(spark, model):
    texts = odd_texts(1500, 1)
    got = pieces.encode(rows_of(spark, texts), B).select("doc.*", F.col("ids").alias("out"), "decoded").collect()
    assert len(got) == len(texts)
    for r in got:
        want = expected_ids(model, r["text"])
        assert texts[r["ids"]] == r["text"] and bytes(r["out"]) == want
        assert r["decoded"] == model.decode(np.frombuffer(want, "<u4").tolist())


def test_encoding_of_a_full_table(model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 3)
    own = pieces.WordPieces(B)
    texts = odd_texts(200, 2)
    for i in range(0, len(texts), 20):
        assert own.encode(pa.array(texts[i : i + 20], pa.string())) == [expected_ids(model, t) for t in texts[i : i + 20]]
    assert own.encode(pa.array([], pa.string())) == [] and own.decode([]) == []


def test_encoding_of_the_documents(spark, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = expected_ids(model, texts[r["doc_id"]])
        text = model.decode(np.frombuffer(ids, "<u4").tolist())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# ---- alignment


class Brute:
    def __init__(self):
        self.t = alignment.Aligner(A, B)

    def links(self, text):
        """(a ids, b ids, groups as text, links) by comparing all ranges."""
        a, b = (self.t.a.encode(" " + text, add_special_tokens=False).ids, self.t.b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(self.t.a_bytes[i] for i in a) != whole or b"".join(self.t.b_bytes[i] for i in b) != whole:
            return [], [], "", []
        ranges = []
        for ids, tokens in ((a, self.t.a_bytes), (b, self.t.b_bytes)):
            ends = np.cumsum([len(tokens[i]) for i in ids]).tolist()
            ranges.append([(i, p, q) for i, p, q in zip(ids, [0, *ends], ends)])
        ra, rb = ranges
        groups, at = [], 0
        for cut in sorted({q for _, _, q in ra} & {q for _, _, q in rb}):
            groups.append("|".join(",".join(str(i) for i, p, q in r if at <= p and q <= cut) for r in ranges))
            at = cut
        return a, b, ";".join(groups), [(i, j) for i, p, q in ra for j, u, v in rb if p < v and u < q]

    def table(self, texts):
        found = [self.links(t) for t in texts]
        count = collections.Counter(x for f in found for x in set(f[3]))
        most = collections.defaultdict(int)
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        return [(len(a), len(b), g.count(";") + 1 if g else 0, len(x), sum(count[y] == most[y[0]] for y in x), sum(count[y] for y in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, g, x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 10, 0])
def test_alignment_by_brute_force(spark, hot):
    texts = [t for t in odd_texts(300, 3) if t is None or len(t) < 4000]
    got = alignment.align(rows_of(spark, texts), A, B, hot).select("doc.ids", *COLUMNS).collect()
    assert [tuple(r[1:]) for r in sorted(got)] == Brute().table(texts)


def test_alignment_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    few = {k: v for k, v in texts.items() if len(v or "") < 3000}
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert len(got) == len(texts)
    brute = Brute()
    for k, v in few.items():
        a, b, groups, links = brute.links(v)
        want = (len(a), len(b), len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_links", "groups_sha256")) == want


def test_alignment_in_small_parts(monkeypatch):
    whole = alignment.Aligner(A, B)
    texts = pa.array(odd_texts(200, 4), pa.string())
    want = whole.documents(texts)
    for name, value in (("TABLE", 5), ("JOINED", 3), ("GATHERED", 4)):
        monkeypatch.setattr(alignment, name, value)
    own = alignment.Aligner(A, B)
    for i in range(0, len(texts), 37):
        got = own.documents(texts[i : i + 37])
        assert got[0] == want[0][i : i + 37] and (got[1] == want[1][i : i + 37]).all()
        assert got[2].to_pylist() == want[2][i : i + 37].to_pylist() and got[3].to_pylist() == want[3][i : i + 37].to_pylist()


def test_written_groups(spark):
    rows = spark.createDataFrame([(1, "naïve 日本 x"), (2, "a▁b")], "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in alignment.token_groups(rows, A, B, text=True).collect()}
    assert got[1]["groups"] == Brute().links("naïve 日本 x")[2] and got[2]["groups"] == "" and got[2]["n_a"] == 0


def test_tokenizers_of_empty_tables(spark):
    none = rows_of(spark, FIXED).where("ids < 0")
    assert pieces.encode(none, B).count() == 0 and alignment.align(none, A, B).count() == 0


def test_ids_of_the_first_tokenizer():
    """The faster encoder gives the ids of ``tokenizers``, also next to any kind of sign; very long runs are left to that library."""
    own = alignment.Aligner(A, B)
    signs = [chr(c) for c in [*range(1, 0x3100), 0xFEFF, 0x10400, 0x1D7CE, 0x1F600, 0x323B0, 0xE0001, 0x10FFFF]]
    texts = [" " + " ".join(f"a{c}1{c}!{c}'s {c}  {c}\n\n{c}" for c in signs[i : i + 500]) for i in range(0, len(signs), 500)]
    texts += [" <|endoftext|> x<|endoftext|>", *(" " + x * n for x in ("a", " ", "\n", " \n", "7", "!?", "\x1c!", "\u3000", "日本語", "ab ") for n in (250, 257, 200_000))]
    for text in texts:
        assert own._ids_a(text).tolist() == own.a.encode(text, add_special_tokens=False).ids


def test_full_table_keeps_what_came_again(monkeypatch):
    """Segments that come again are aligned once, though rare ones fill the table time and again."""
    monkeypatch.setattr(alignment, "TABLE", 40)
    own, aligned = alignment.Aligner(A, B), []
    plain = own._aligned
    monkeypatch.setattr(own, "_aligned", lambda segs: (aligned.extend(segs), plain(segs))[1])
    texts = [" ".join([*(f"usual{i}" for i in range(10)), *(f"rare{k}x{i}" for i in range(15))]) for k in range(12)]
    got = [own.documents(pa.array([x]))[0][0] for x in texts]
    assert len(own.groups) == len(own.rows) == len(own.again) < 80 and got == [alignment.Aligner(A, B).documents(pa.array([x]))[0][0] for x in texts]
    assert aligned.count("usual3") == 1 and aligned.count("rare2x3") == 1


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        alignment.Aligner(queries.tokenizer_path("word_bpe_49k.json"), B)


# ---- spelling variants


def brute_variants(words):
    """{word: (form, root, n, n_near, form_n)} by comparing all words."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in words:
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, n_near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def slipped(doc_id, run):
    run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


@pytest.mark.parametrize("group", [32, 3, 1, 0])
def test_variants_by_brute_force(spark, group):
    rng = random.Random(5)
    words = {}
    for base in ("banana", "ciónmente", "straße", "aaaaaaa", "tionther", "Éclairàÿ", "zzzzaaaa"):
        base += "xy" if len(base) < 7 else ""
        words[base] = 20_000
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.pop(at), lambda: w.insert(at, rng.choice("anté")), lambda: w.__setitem__(at, rng.choice("anté"))])()
            if len(w) >= 7:
                words.setdefault("".join(w), rng.choice([2, 3, 30, 200, 2000]))
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table, group=group).collect()}
    want = brute_variants(words)
    assert got == want
    assert any(f and r != f for f, r, *_ in want.values())  # a chain


def test_variants_of_texts(spark):
    texts = ["Banänas bananas BANANAS short", None, "", "bananas\nbananas" * 60 + " bananes bananes", "x" * 5000 + " " + "x" * 5000, "Éclairs éclairs Éclairs", "12 !! ?"]
    rows = [(None if i % 3 == 2 else i // 2, t, i, 1, "a") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, word int, n int, `h.x` string")
    counts = collections.Counter(slipped(i, run) for i, t, *_ in rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(docs).collect()}
    assert got == brute_variants(words) and len(got) > 3
    assert spelling.group_variants(docs.where("word < 0")).count() == 0


def test_partitions_differ_by_two_at_most(spark):
    rows = [("bananas", "banana"), ("bananas", "bananes"), ("abcdefg", "abcdefgh"), ("éclairs", "eclairs"), ("aaaaaaa", "aaaaaaaa")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(spelling.partition_hashes(df.a).alias("x"), spelling.partition_hashes(df.b).alias("y")).collect():
        assert 1 <= sum(p != q for p, q in zip(r["x"], r["y"], strict=True)) <= 2


def test_spelling_sends_no_table_that_grows(spark):
    """Spark takes exploded signatures and stored words for small tables; their joins go by shuffle all the same."""
    words = spark.createDataFrame([("wordless", 3), ("wordles", 40), ("another", 5)], "word string, n long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spelling.signatures(words.select("word", spelling.partition_hashes(F.col("word")).alias("h")))
    assert "SortMergeJoin" in plan(spelling._pairs(rows)) and "Broadcast" not in plan(spelling._pairs(rows))
    out = spelling.variants(words)
    assert "Broadcast" not in plan(out)
    assert {(r["word"], r["form"]) for r in out.collect()} == {("wordless", "wordles"), ("wordles", None), ("another", None)}
