"""Chat formatting with a grammar round trip. DataFrame functions only.

    conversation := turn*          turn := "<s>" role "[INST]" text "[/INST]" "</s>"

The control strings may not stand bare inside a role or text. A conversation is first rendered as it
is, reparsed by splitting at the marks, and compared with its source. If they differ, the turns that
hold a control string or a backslash are escaped and the conversation is rendered and reparsed again;
if they still differ, every turn is escaped at every mark character. Escapes are a backslash before a
character and are undone by dropping it.

Loss spans (code points, end exclusive) cover the assistant texts and nothing else.

Defined results: null role and text are empty; turns go by turn, then role, then text, so ties and
repeated rows have one order; a null conv_id is a conversation of its own; no rows, no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, starts

OPEN, MID, END, STOP = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL_RE = r"<s>|</s>|\[INST\]|\[/INST\]"
#: Spans up to which pieces are cut from the string; with more, from its characters, in linear time.
FEW = 64
LEARN_ROLE = "assistant"
#: The turn pair that tests escaping in every run.
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    """Doubles backslashes and breaks control strings by a backslash after their first character."""
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), r"(<)(?=/?s>)|(\[)(?=/?INST\])", r"$1$2\\")


def escape_all(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\<>\[\]/])", r"\\$1")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(END + STOP))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>; null if the string isn't in the grammar."""
    pieces = F.split(formatted, STOP, -1)
    # what follows the last mark must be empty; every piece before it is one turn
    turn = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"

    def turns(ps: Column) -> Column:
        body = F.slice(ps, 1, F.size(ps) - 1)
        parsed = F.transform(body, lambda x: F.struct(F.regexp_extract(x, turn, 1).alias("role"), F.regexp_extract(x, turn, 2).alias("text")))
        sound = (F.element_at(ps, -1) == "") & F.forall(body, lambda x: F.rlike(x, F.lit(turn)))
        sound = sound & F.forall(parsed, lambda t: ~F.rlike(F.concat_ws("\n", t["role"], t["text"]), F.lit(CONTROL_RE)))
        plain = F.transform(parsed, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
        return F.when(sound, plain)

    return let(pieces, turns)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return by.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _escaped(turns: Column, level: int) -> Column:
    if level == 0:
        return turns
    how = lambda x: escape_all(x) if level == 2 else F.when(F.rlike(x, F.lit(CONTROL_RE + r"|\\")), escape(x)).otherwise(x)
    return F.transform(turns, lambda t: F.struct(how(t["role"]).alias("role"), how(t["text"]).alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, level, identical): rendered conversations, checked by reparsing them."""

    def finished(e: Column, level: int) -> Column:
        sizes = F.transform(e, lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN + MID + END + STOP))
        spans = let(
            starts(sizes),
            lambda at: F.filter(
                F.transform(
                    e,
                    lambda t, i: F.struct(
                        (F.get(at, i) + F.length(t["role"]) + len(OPEN + MID)).alias("start"),
                        (F.get(at, i) + F.length(t["role"]) + F.length(t["text"]) + len(OPEN + MID)).alias("end"),
                        (unescape(t["role"]) == LEARN_ROLE).alias("learn"),
                    ),
                ),
                lambda s: s["learn"] & (s["end"] > s["start"]),
            ),
        )
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(_render(e).alias("formatted"), spans.alias("loss_spans"), F.lit(level).alias("level"))

    def tried(turns: Column, level: int) -> Column:
        def checked(e: Column) -> Column:
            same = F.coalesce(parse(_render(e)) == turns, F.lit(False))
            done = F.when(same, F.struct(finished(e, level).alias("f"), F.lit(True).alias("identical")))
            last = F.struct(finished(e, level).alias("f"), F.lit(False).alias("identical"))
            return done.otherwise(tried(turns, level + 1) if level < 2 else last)

        return let(_escaped(turns, level), checked)

    at = conversations(rows)
    out = at.select("conv_id", F.inline(F.array(tried(F.col("turns"), 0))))
    return out.select("conv_id", "f.formatted", "f.loss_spans", "f.level", "identical")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the rendered strings hold: turns by parsing them, learned text by the loss spans."""
    text, spans = F.col("formatted"), F.col("loss_spans")
    cut = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    by_char = let(F.split(text, ""), lambda cs: F.transform(spans, lambda s: F.array_join(F.slice(cs, s["start"] + 1, s["end"] - s["start"]), "")))
    learned = F.when(F.size(spans) <= FEW, F.transform(spans, cut)).otherwise(by_char)
    learned = F.array_join(F.transform(learned, unescape), "")
    said = let(
        parse(text),
        lambda ts: F.struct(
            F.size(ts).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        ),
    )
    loss = let(learned, lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    out = formatted.select("conv_id", F.inline(F.array(F.struct(said.alias("a"), loss.alias("b")))), F.length(text).cast("long").alias("formatted_chars"), "level", "identical")
    return out.select("conv_id", "a.n_turns", "a.turns_sha256", "b.loss_chars", "b.loss_sha256", "formatted_chars", "level", "identical")


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -1, whose two texts are control strings."""
    probe = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
