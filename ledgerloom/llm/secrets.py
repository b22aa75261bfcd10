"""Secret scans over a trigram inverted index. DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: alternatives (OR) of trigrams that a
match must hold (AND). The index lists, for each trigram that some query names, the documents holding
it (A-Z folded). Intersecting postings gives each rule's candidate documents; only those are opened and
the expression verified there. A rule with an alternative that has no mandatory trigram scans every text.

Spans are code points, end exclusive, leftmost and non-overlapping per rule; of those a rule may ask a
least length of a group, else the match is dropped, though its text stays consumed.

Defined results: a null text is empty and has no spans; repeated rows have the same spans; an empty
table gives an empty result; doc_id may be null or repeated, since rows are told apart by their text too.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, packed, starts, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # runs of these classes can't start anew inside a failing run, so the least length is in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES
#: Classes up to this size and products up to MAX_ALTERNATIVES are spelled out; beyond, the part counts as unknown.
MAX_CLASS, MAX_ALTERNATIVES = 6, 64
#: Documents up to which candidates are broadcast.
MAX_BROADCAST = 500_000
#: Trigrams in one long.
BITS = 63
MASK = "[SECRET]"


def mandatory_runs(regex: str) -> list[tuple[str, ...]]:
    """Alternatives, each a tuple of literal runs (A-Z folded) that every match of that alternative holds."""
    parser = re._parser  # noqa: SLF001  the standard library's own regex parser

    def options(node) -> list[tuple[str | None, ...]]:
        """Spellings of one node; None stands for unknown text."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return [(chr(arg).lower(),)]
        if op == "IN":
            chars = [chr(v) for o, v in arg if str(o) == "LITERAL"]
            plain = len(chars) == len(arg) and len(chars) <= MAX_CLASS
            return [(c.lower(),) for c in chars] if plain else [(None,)]
        if op == "BRANCH":
            return [x for alternative in arg[1] for x in sequence(alternative)]
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "MAX_REPEAT":
            low, high, body = arg
            if (low, high) == (0, 1):
                return [(), *sequence(body)]
            once = sequence(body)
            if low == 0:
                return [(None,)]
            fixed = [sum(x, ()) for x in itertools.islice(itertools.product(once, repeat=min(low, 3)), MAX_ALTERNATIVES + 1)]
            if len(fixed) > MAX_ALTERNATIVES:
                return [(None,)]
            return fixed if low == high <= 3 else [(*x, None) for x in fixed]
        return [(None,)] if op in ("ANY", "NOT_LITERAL", "CATEGORY") else [()]

    def sequence(nodes) -> list[tuple[str | None, ...]]:
        out: list[tuple[str | None, ...]] = [()]
        for node in nodes:
            opts = options(node)
            if len(out) * len(opts) > MAX_ALTERNATIVES:
                opts = [(None,)]
            out = [a + b for a in out for b in opts]
        return out

    found = []
    for spelling in sequence(parser.parse(regex)):
        runs, run = [], ""
        for c in (*spelling, None):
            if c is None:
                runs += [run] if run else []
                run = ""
            else:
                run += c
        found.append(tuple(runs))
    return found


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR of ANDs of trigrams; empty when some alternative has no mandatory trigram."""
    out = [frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in mandatory_runs(regex)]
    return [] if any(not x for x in out) else sorted({x for x in out if not any(y < x for y in out)}, key=sorted)


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of ``trigrams``; one scan, no shuffle."""
    folded = F.lower(F.coalesce("text", F.lit("")))
    hits = let(folded, lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))
    return docs.select(F.explode(hits).alias("trigram"), "doc_id", F.xxhash64("text").alias("text_hash"))


def trigrams_of(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for alt in trigram_query(r.regex) for g in alt})


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, text_hash, kinds): the rules whose query the postings satisfy.

    A trigram is a bit, so a document's postings are joined by OR before the one shuffle, and repeats change nothing.
    """
    place = {g: divmod(i, BITS) for i, g in enumerate(trigrams_of(rules))}
    words = range(-(-len(place) // BITS))

    def mask(grams: Sequence[str], word: int) -> int:
        return sum(1 << place[g][1] for g in grams if place[g][0] == word)

    number = F.array_position(F.array(*map(F.lit, place)), F.col("trigram")).cast("int")
    bits = [F.element_at(F.array(*[F.lit(mask([g], w)).cast("long") for g in place]), number) for w in words]
    met = index.groupBy("doc_id", "text_hash").agg(*[F.bit_or(bits[w]).alias(f"m{w}") for w in words])

    def satisfied(alt: frozenset[str]) -> Column:
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(mask(alt, w)).cast("long")) == mask(alt, w) for w in words])

    found = [F.when(reduce(Column.__or__, map(satisfied, trigram_query(r.regex))), F.lit(r.kind)) for r in rules]
    return met.select("doc_id", "text_hash", F.array_compact(F.array(*found)).alias("kinds")).where("size(kinds) > 0")


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of one rule's matches in ``text``."""
    pattern = F.lit(rule.regex)
    gaps = F.split(text, rule.regex, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found

    def located(g: Column, m: Column, c: Column) -> Column:
        # gap, match, gap, match, ...: a match starts after its gap and all pairs before
        before = starts(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
        return let(
            before,
            lambda at: F.filter(
                F.transform(
                    m,
                    lambda x, i: F.struct(
                        (F.get(at, i) + F.length(F.get(g, i))).alias("start"),
                        F.lit(order).alias("rank"),
                        (F.get(at, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"),
                        F.lit(rule.kind).alias("kind"),
                        (F.length(F.get(c, i)) >= rule.least).alias("ok"),
                    ),
                ),
                lambda s: s["ok"],
            ),
        )

    every = let(gaps, lambda g: let(found, lambda m: let(checked, lambda c: located(g, m, c))))
    plain = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.rlike(text, pattern), plain).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, Column]:
    """``docs`` (doc_id, text, ...) beside its rows' candidate rules, and the spans of a row, sorted by start, then by rule.

    Texts are read twice and not shuffled while the candidates are few enough to broadcast: once for the
    postings, once for the rules that must scan and to open the candidates.
    """
    indexed = [r for r in rules if trigram_query(r.regex)]
    text, at = F.coalesce("text", F.lit("")), docs
    if indexed:
        hits = stored(candidates(build_index(docs.select("doc_id", "text"), trigrams_of(indexed)), indexed), "secret-candidates")
        hits = broadcast_if_small(hits.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("kinds").alias("__kinds")), MAX_BROADCAST)
        at = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left")

    def found(r: Rule, rank: int) -> Column:
        every = spans(text, r, rank)
        return F.when(F.array_contains("__kinds", r.kind), every).otherwise(F.array().cast(SPANS)) if r in indexed else every

    return at, F.sort_array(F.concat(F.array().cast(SPANS), *[found(r, i) for i, r in enumerate(rules)]))


def find(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, text_hash, spans) of every row of ``docs``."""
    at, found = with_spans(docs.select("doc_id", "text"), rules)
    return at.select("doc_id", F.xxhash64("text").alias("text_hash"), found.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every found secret replaced by MASK, n_chars renewed where that column exists; no row is dropped.

    A row is masked where its spans are found, so they meet no text in a join of their own.
    """
    at, found = with_spans(packed(docs, "doc_id", "text"), rules)

    def joined(every: Column) -> Column:
        """Overlapping spans of several rules become one."""
        return F.aggregate(
            every,
            F.array().cast("array<struct<s:int,e:int>>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["e"]),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["end"]).alias("e"))),
                ),
            ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
        )

    text = F.col("text")

    def masked(m: Column) -> Column:
        parts = F.transform(
            m,
            lambda x, i: F.concat(
                F.substring(text, F.coalesce(F.get(m, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(m, i - 1)["e"], F.lit(0))), F.lit(MASK)
            ),
        )
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["e"] + 1, F.length(text)))

    new = let(found, lambda x: F.when(F.size(x) > 0, let(joined(x), masked)))  # null without a secret
    at = at.select("doc", text.alias("old"), new.alias("new"))
    at = at.select("doc", F.col("new").isNull().alias("clean"), F.coalesce("new", "old").alias("text"))
    own = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("clean"), own["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return at.select(*[own[c].alias(c) for c in docs.columns])


