"""Spelling variants: words one letter apart, grouped under their far more frequent forms.

PartEnum signatures: a word's letters, each with the number of its occurrence, are a binary vector, and words that
differ by one inserted, deleted or replaced letter have vectors at a Hamming distance of at most two. The dimensions are
dealt to PARTS partitions; two such vectors differ in two partitions at most, so for some choice of PARTS - 2 partitions
they agree. Every choice gives a signature, words are joined on equal signatures, and the edit distance verifies pairs.

A signature that more than GROUP words share isn't expanded into pairs: its words are dealt out anew by the signature
with the first or the last three letters, one of which near words have in common, and what is crowded still by the
signature with the word less one letter (or the whole word), which near words share and few others do.

Forms lead to ever more frequent words, by FACTOR at least, so chains are short: pointer jumping ends them in a few rounds.

Defined results: null or empty texts have no words; a null doc_id reads as an empty one; repeated rows count again;
texts are read whole, however long; ties of frequency go to the smaller word by code points; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, discard, let, stored

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, FACTOR = 7, 2, 10
#: Letters by about how common they are, so that each partition gets its share of the common ones.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: One occurrence in so many, by its hash, loses a letter.
SLIP = 31
#: Partitions of the dimensions, words up to which a signature is expanded into pairs, and signatures up to which a broadcast is tried.
PARTS, GROUP, FEW = 5, 64, 200_000
#: Doublings that end any chain: each step multiplies the frequency by FACTOR, and counts are below 10 ** 19.
MAX_ROUNDS = 6


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): every run of letters of ``docs`` (doc_id, text), lower-cased in A-Z, where the rule of SLIP may take a letter out."""
    runs = F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{SHORTEST},}})"), F.lit(1))  # a shorter run can't become a word
    at = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    at = at.select("id", ascii_lower(F.col("run")).alias("run"))
    at = at.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("len"))
    slot = (F.col("h") % F.col("len")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), slot), F.col("run").substr(slot + 2, F.col("len")))
    return at.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= SHORTEST)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur at least LEAST times."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def partition_hashes(word: Column, parts: int = PARTS) -> Column:
    """Hash of what a word's vector holds in each partition; the occurrences of a letter go to different ones."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda x: x != ""))
    dims = let(letters, lambda xs: F.transform(xs, lambda x, i: F.struct(F.pmod(F.ascii(x) * (F.call_function("instr", F.lit(COMMON), x) == 0).cast("int") + F.call_function("instr", F.lit(COMMON), x) + 3 * (i - F.array_position(xs, x)), F.lit(parts)).alias("p"), x.alias("x"))))
    return let(dims, lambda ds: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.xxhash64(F.filter(ds, lambda d: d["p"] == p))))


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, word): one row for every choice of all partitions but two, of words (word, h) with their partition hashes."""
    sigs = [F.xxhash64(F.lit(a * parts + b), *[F.col("h")[i] for i in range(parts) if i not in (a, b)]) for a, b in combinations(range(parts), 2)]
    return words.select(F.explode(F.array(*sigs)).alias("key"), "word")


def ends_of(word: Column) -> Column:
    """The first and the last three letters: one letter changes at most one of them."""
    return F.array(F.concat(F.lit("<"), F.left(word, F.lit(3))), F.concat(F.lit(">"), F.right(word, F.lit(3))))


def less_one(word: Column) -> Column:
    """The word, and what it is without one of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.char_length(word))))
    return F.array_union(F.array(word), cut)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins by shuffle, unless the other side has a hint to be sent.

    Spark takes what is exploded for no more rows than before and a stored table for as small as its compressed file, and
    would collect and send tables that grow with the corpus.
    """
    return df.hint("merge")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different words with equal keys whose edit distance is one, the smaller word first."""
    a, b = (shuffled(rows.select("key", F.col("word").alias(f"word_{x}"))) for x in "ab")
    return a.join(b, "key").where("word_a < word_b").where(F.levenshtein("word_a", "word_b", 1) == 1).drop("key")


def near_words(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(word_a, n_a, word_b, n_b), each pair of near words of ``words`` (word of six letters or more, n) once."""
    rows = signatures(stored(words.select("word", partition_hashes(F.col("word"), parts).alias("h")), "spell-hashes"), parts)
    found = []
    for finer in (ends_of, less_one):
        full = stored(rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > group).select("key"), "spell-full")
        hint = broadcast_if_small(full, FEW)
        found.append(_pairs(shuffled(rows).join(hint, "key", "left_anti")))
        rows = shuffled(rows).join(hint, "key", "left_semi").select(F.explode(finer(F.col("word"))).alias("x"), "key", "word").select(F.xxhash64("key", "x").alias("key"), "word")
    pairs = reduce(DataFrame.unionByName, [*found, _pairs(rows)]).distinct()
    for x in "ab":
        pairs = pairs.join(shuffled(words.select(F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))), f"word_{x}")
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that the forms lead to."""
    cur = stored(forms.select("word", F.col("form").alias("root")), "spell-roots")
    for _ in range(MAX_ROUNDS):
        further = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(cur.join(shuffled(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        discard(cur)
        cur = new.drop("moved")
        if new.where("moved").isEmpty():
            return cur
    raise RuntimeError("forms go round in a circle")


def variants(words: DataFrame, factor: int = FACTOR, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    pairs = near_words(words, parts, group)
    both = pairs.unionByName(pairs.select(F.col("word_b").alias("word_a"), F.col("n_b").alias("n_a"), F.col("word_a").alias("word_b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("word_a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("word_b").alias("word"))).alias("best"))
    at = words.join(shuffled(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    is_form = -F.col("best.n") >= factor * F.col("n")
    at = stored(at.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spell-forms")
    ends = roots(at.where("form is not null"))
    return at.join(shuffled(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text)."""
    return variants(stored(vocabulary(docs), "spell-words"))
