"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over host + path together with the literal tokens that any match must
hold. Each rule is filed under the one of its tokens that the fewest URLs hold; a URL's tokens fetch
candidate rules, and only those run. Rules without a literal token are tried on every URL.

Defined results: null URLs and those without ``://`` have empty host and path and match no rule; they
get the default verdict. Repeated URLs are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Up to so many rules the index is a literal in the plan; beyond, it is a table and joins by shuffle.
MAX_INLINE_RULES = 2000
TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on host + path. Of several fitting rules the highest ``rank`` wins, then the longest name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int = 0


def _tokens(literal: str) -> tuple[str, ...]:
    out, word = [], ""
    for c in literal.lower() + "/":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return tuple(dict.fromkeys(out))


def site_rule(name: str, verdict: str) -> Rule:
    """A rule like ``example.net/en/``: its host and all subdomains, where the path starts with the rule's."""
    host, _, path = name.partition("/")
    quoted = "".join(c if c.isascii() and (c.isalnum() or c in "-_/") else f"\\{c}" for c in path)
    host_re = "".join(c if c.isalnum() or c == "-" else f"\\{c}" for c in host)
    # path tokens count only where the rule ends them, since a URL may go on inside the last one
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    return Rule(name, verdict, f"^(?:[^/]*\\.)?{host_re}/{quoted}", _tokens(f"{host}/{whole}"), rank=1)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """The hyphenated or single word as whole tokens anywhere in host or path."""
    parts = word.split("-")
    return Rule(f"word:{word}", verdict, f"(?:^|[^a-z0-9])(?i:{'[^a-z0-9]+'.join(parts)})(?:[^a-z0-9]|$)", tuple(parts))


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """A rule in the usual filter notation, A-Z and a-z alike, anywhere in host + path.

    ``*`` is any run of characters, ``^`` a separator (no letter or digit) or the end, ``||`` in front the
    start of the host or of one of its labels, ``|`` behind the end. A run of letters and digits is a token
    of every URL that fits only if the pattern itself ends it on both sides; a pattern may have none.
    """
    at_host, at_end = pattern.startswith("||"), pattern.endswith("|")
    body = pattern.strip("|")
    signs = {"*": ".*", "^": "(?:[^a-z0-9]|\\z)"}
    regex = "".join(signs.get(c) or (c if c.isascii() and c.isalnum() else f"\\{c}") for c in body)
    # what may stand beside a run: '/' for a fixed end, '*' for an open one
    framed = ("/" if at_host else "*") + body.lower() + ("/" if at_end else "*")
    tokens, start = [], None
    for i, c in enumerate(framed):
        if c.isascii() and c.isalnum():
            start = i if start is None else start
        elif start is not None:
            if "*" not in (framed[start - 1], c):
                tokens.append(framed[start:i])
            start = None
    anchor = "^(?:[^/]*\\.)?" if at_host else ""
    return Rule(pattern, verdict, f"(?is){anchor}{regex}" + ("\\z" if at_end else ""), tuple(dict.fromkeys(tokens)))


SITE_RULES = (
    site_rule("net/", "block"),
    site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"),
    site_rule("org/fr/", "allow"),
)
WORD_RULES = tuple(
    word_rule(w) for w in ("spam-farm", "cheap-pills", "casino", "free-casino", "poker", "viagra", "porn", "xxx", "payday-loans", "click-bait", "torrent", "warez")
)
#: Hosts of advertisements and tracking, downloads, redirects and log-in forms; the last three hold no whole token.
PATTERN_RULES = tuple(
    pattern_rule(p)
    for p in (
        "||ads.", "||ads-*.", "||adult-*.", "||adserver*.", "||click.", "||counter.", "||tracker.", "||tracking-*.", "||pixel.", "/wp-login.", "/wp-admin^", "/cgi-bin/*redirect", "^affiliate^",
        "^sponsored^", "/out/*/go^", "/download/*.exe|", "/download/*.apk|", "^sale^*^cheap^", "^lottery^winner^", "/popunder*.js|", "/banner*.gif|", "00000000", "lorem*ipsum",
    )
)
RULES = SITE_RULES + WORD_RULES + PATTERN_RULES


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty without ``://``."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return pages.drop("host", "path").withColumn("host", ascii_lower(host)).withColumn("path", path)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(F.concat_ws("/", host, path)), TOKEN)), "")


def rarest_tokens(located: DataFrame, rules: Sequence[Rule]) -> dict[str, str]:
    """Rule name to the literal token that the fewest URLs hold ('' without any): counts over all URLs, a row per rule token."""
    every = sorted({t for r in rules for t in r.tokens})
    if not every:
        return {r.name: "" for r in rules}
    toks = located.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("t"))
    seen = {x["t"]: x["count"] for x in toks.where(F.col("t").isin(every)).groupBy("t").count().collect()}
    return {r.name: min(r.tokens, key=lambda t: (seen.get(t, 0), t), default="") for r in rules}


def _as_struct(r: Rule) -> Column:
    return F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.rank).alias("rank"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (name or null) and verdict.

    With up to MAX_INLINE_RULES rules the token index is a literal and the job has no shuffle but the
    token counts. With more it is a table joined on the token; URLs then carry a row number, and the best
    rule per URL comes from a max that is combined before the shuffle.
    """
    spark = pages.sparkSession
    located = with_host_path(pages)
    filed: dict[str, list[Rule]] = {}
    rare = rarest_tokens(located, rules)
    for r in rules:
        filed.setdefault(rare[r.name], []).append(r)
    at = located.drop("rule", "verdict")
    target = F.concat("host", "path")
    if len(rules) <= MAX_INLINE_RULES and rules:
        index = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(_as_struct, rs)))])
        keys = F.concat(F.filter(url_tokens(F.col("host"), F.col("path")), lambda t: t.isin(sorted(filed))), F.array(F.lit("")))
        fetched = F.flatten(F.filter(F.transform(keys, lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
        best = F.array_max(
            F.transform(
                F.filter(fetched, lambda r: F.regexp(target, r["regex"])),
                lambda r: F.struct(r["rank"].alias("rank"), F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict")),
            )
        )
        return at.select(*at.columns, best.alias("__best")).select(
            *at.columns, F.col("__best.name").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict")
        )
    return _judge_by_join(spark, at, filed, default)


def _judge_by_join(spark: SparkSession, at: DataFrame, filed: dict[str, list[Rule]], default: str) -> DataFrame:
    index = spark.createDataFrame(
        [(t, r.name, r.verdict, r.regex, r.rank) for t, rs in filed.items() for r in rs], "token string, name string, v string, regex string, rank int"
    )
    located = stored(at.withColumn("__row", F.monotonically_increasing_id()), "urls")
    toks = located.select("__row", F.concat("host", "path").alias("target"), F.explode(F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    fits = toks.join(index, "token").where("target rlike regex")
    best = fits.groupBy("__row").agg(F.max(F.struct("rank", F.length("name").alias("n"), "name", "v")).alias("b"))
    out = located.join(best, "__row", "left")
    return out.select(*at.columns, F.col("b.name").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
