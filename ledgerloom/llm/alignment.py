"""Alignment of two tokenizers: which tokens of the one cover bytes of which tokens of the other, and how usual that is.

Tokenizer A is a byte-level BPE file of ``tokenizers`` and reads a space and the text; tokenizer B is a SentencePiece
model, which adds that space itself. A token ends where the bytes decoded so far end, so tokens that share a character
(parts of a multibyte one, or byte fallback) need no care, and a byte where tokens of both end is a cut. A is encoded by
the same file's encoder in ``packing``, which gives the ids of ``tokenizers`` in a quarter of the time, and texts with
very long runs by ``tokenizers``.

A single space between two characters that aren't blank starts a token in both tokenizers. Texts are split there, each
different segment of a task's texts is aligned once, many at a time, and documents are put together from segments by
position. Texts come in slices bounded by bytes and rows; a full table of segments keeps those that came again.

How many documents hold a pair of ids linked is counted over the whole corpus, combined in each task first. The most
frequent pairs, HOT_PAIRS at most, are sent to all tasks; rarer ones are joined by pair, and since the frequent ones
are out, no pair is hot in that join.

Defined results: texts that are null or empty, or whose joined token bytes of A or B aren't the space and the text (a
text with U+2581 is one), have no tokens: zeros and empty strings. Repeated rows count as documents of their own;
ids may be null or repeated; the table's own columns come back in ``doc``, so that no name clashes; texts are aligned
whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import packing
from .common import packed, stored, text_slices

MARK = "▁"
#: Segments a task's table holds, besides those of one slice, before those that didn't come again go.
TABLE = 1 << 17
#: Bytes and rows of text of a slice, segments encoded as one text, and segments put together at once.
SLICE, SLICE_ROWS, JOINED, GATHERED = 2 << 20, 4096, 512, 1 << 17
#: Characters between spaces, or of white space, beyond which a text is encoded by ``tokenizers`` itself.
LONG_RUN = 256
LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")
#: Pairs of ids sent to all tasks: 25 MB. And pairs a task counts before it hands them on.
HOT_PAIRS = 1 << 20
COUNTED_PAIRS = 1 << 20


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def _blank_edges(parts: pa.Array) -> np.ndarray:
    """Which parts are empty or have white space at their start or end."""
    out = np.zeros(len(parts), bool)
    for a, b in ((0, 1), (-1, None)):
        edge = (pc.utf8_slice_codeunits(parts, a, b) if b else pc.utf8_slice_codeunits(parts, a)).dictionary_encode()
        out |= np.array([not x or x.isspace() for x in edge.dictionary.to_pylist()], bool)[edge.indices.to_numpy()]
    return out


def segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments (without the space before them), the number of each one in order, and how many a text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    cut = pc.split_pattern(texts, " ")
    at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = cut.flatten().dictionary_encode()
    code, body = coded.indices.to_numpy(), coded.dictionary
    loose = _blank_edges(body)[code]  # such parts stay with their neighbours
    starts = np.concatenate(([True], ~(loose[1:] | loose[:-1])))
    starts[at[:-1]] = True
    first = np.flatnonzero(starts)
    size = np.diff(np.concatenate((first, [len(code)])))
    out, names = code[first].astype(np.int64), body.to_pylist()
    known: dict[str, int] = {}
    for i in np.flatnonzero(size > 1).tolist():
        whole = " ".join(names[c] for c in code[first[i] : first[i] + size[i]].tolist())
        out[i] = len(names) + known.setdefault(whole, len(known))
    names += known
    owner = np.searchsorted(at[1:], first, side="right")
    some = (pc.binary_length(texts).to_numpy() > 0)[owner]
    return names, out[some], np.bincount(owner[some], minlength=len(texts))


class Cuts:
    """Segments aligned, one after the other: their groups as text, (n_a, n_b, n_groups, n_links) of each and the id pairs of its links."""

    def __init__(self, text: bytes, sizes: np.ndarray, counts: np.ndarray, links: np.ndarray, good: bool = True):
        self.text, self.sizes, self.counts, self.links, self.good = text, sizes, counts, links, np.full(len(sizes), good)

    @staticmethod
    def joined(parts: list[Cuts]) -> Cuts:
        out = Cuts(b"".join(p.text for p in parts), *[np.concatenate([getattr(p, x) for p in parts]) for x in ("sizes", "counts", "links")])
        out.good = np.concatenate([p.good for p in parts])
        return out

    def taken(self, rows: np.ndarray) -> Cuts:
        """The segments ``rows`` in that order, without their text."""
        n = self.counts[:, 3]
        m = n[rows]
        links = self.links[np.repeat((np.cumsum(n) - n)[rows] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        out = Cuts(b"", self.sizes[rows], self.counts[rows], links)
        out.good = self.good[rows]
        return out


NO_CUTS = Cuts(b"", np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
LOST = Cuts(b"", np.zeros(1, np.int64), np.zeros((1, 4), np.int64), np.zeros(0, np.int64), good=False)


class Aligner:
    """Two tokenizers over the same texts, with a bounded table of the segments that they have cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        if file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or not file["pre_tokenizer"].get("use_regex", True) or file["normalizer"]:
            raise ValueError("the first tokenizer must be plain byte-level BPE")
        of, vocab = byte_of_char(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_width, self.b_width = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.n_b = len(pieces)
        self.encoder = packing.Tokenizer(a_path)
        # ids of A (0, 1) and B (2, 3) as they are written, with the sign behind them inside a group and at its end
        self.signed = [b"%d%c" % (x >> 2, b",|,;"[x & 3]) for x in range(4 * max(len(self.a_bytes), self.n_b))]
        self.signed_width = np.array([len(x) for x in self.signed])
        self.rows: dict[str, int] = {}  # segments that are aligned, by their row in ``cuts``, ``groups`` and ``again``
        self.cuts, self.groups, self.again = NO_CUTS, [], np.zeros(0, bool)

    def _ids_a(self, text: str) -> np.ndarray:
        # the faster encoder fails on runs of hundreds of thousands of characters
        if LONG_BLANK.search(text) or max(map(len, text.split(" "))) > LONG_RUN:
            return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        return self.encoder.encode_plain(text).astype(np.int64)

    def _ids_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text[1:]), np.int64)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and the bytes where they end, and the same of B, of texts that begin with a space, laid end to end; None if bytes differ."""
        whole = "".join(texts).encode()
        out: list[np.ndarray] = []
        for ids_of, tokens, width in ((self._ids_a, self.a_bytes, self.a_width), (self._ids_b, self.b_bytes, self.b_width)):
            ids = np.concatenate([ids_of(x) for x in texts])  # arrays, since the libraries' objects of all texts are large
            if b"".join(map(tokens.__getitem__, ids.tolist())) != whole:
                return None
            out += [ids, np.cumsum(width[ids])]
        return out[0], out[1], out[2], out[3]

    def _align(self, texts: list[str], sizes: list[int]) -> Cuts | None:
        """Segments of the joined ``texts``, ``sizes`` bytes each; None if the texts can't be cut there."""
        cut = self._cut(texts)
        if cut is None:
            return None
        a, a_end, b, b_end = cut
        stop = np.cumsum(sizes)
        # for every byte: whether a token of A, of B, of both or of any ends there, and how many have ended up to there
        of_a, of_b = np.zeros(int(stop[-1]) + 1, bool), np.zeros(int(stop[-1]) + 1, bool)
        of_a[a_end], of_b[b_end] = True, True
        of_both = of_a & of_b
        if not of_both[stop].all():
            return None
        both, every = np.flatnonzero(of_both), np.flatnonzero(of_a | of_b)
        n_a, n_b, n_both = (np.cumsum(x, dtype=np.int32) for x in (of_a, of_b, of_both))
        links = (a[n_a[every] - of_a[every]] * self.n_b + b[n_b[every] - of_b[every]]).astype("<i8")
        # the groups' text: A's ids and then B's of each group, every id with the sign behind it
        a_no, b_no = n_both[a_end] - of_both[a_end], n_both[b_end] - of_both[b_end]
        a_stop, b_stop = n_a[both], n_b[both]
        word = np.empty(len(a) + len(b), np.int64)
        word[np.arange(len(a)) + np.concatenate(([0], b_stop[:-1]))[a_no]] = 4 * a + of_both[a_end]
        word[np.arange(len(b)) + a_stop[b_no]] = 4 * b + 2 + of_both[b_end]
        text = b"".join(map(self.signed.__getitem__, word.tolist()))
        written = np.concatenate(([0], np.cumsum(self.signed_width[word])))
        ended = [n_a[stop], n_b[stop], n_both[stop], np.searchsorted(every, stop, side="right")]
        at = np.array([np.concatenate(([0], x)) for x in ended], np.int64)
        return Cuts(text, np.diff(written[at[0] + at[1]]), np.diff(at).T, links)

    def _aligned(self, segs: list[str]) -> tuple[Cuts, list[int]]:
        """The segments aligned, those that others can stand beside first, and which ones they are."""
        plain = [i for i, x in enumerate(segs) if x and MARK not in x and not x[0].isspace() and not x[-1].isspace()]
        parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        sizes = [1 + len(segs[i].encode()) for i in plain]
        found = self._align(["".join([" " + segs[i] for i in p]) for p in parts], sizes) if plain else NO_CUTS
        if found is None:
            plain, found = [], NO_CUTS
        others = np.ones(len(segs), bool)
        others[plain] = False
        odd = np.flatnonzero(others).tolist()
        alone = (None if MARK in segs[i] else self._align([" " + segs[i]], [1 + len(segs[i].encode())]) for i in odd)
        return Cuts.joined([found, *[x or LOST for x in alone]]), plain + odd

    def rows_of(self, segs: list[str]) -> np.ndarray:
        """Row of each segment in the table, which takes in those that it lacks."""
        if len(self.rows) > TABLE:
            # those that came again stay, if they leave half of the room; they must come again to stay once more
            kept = np.flatnonzero(self.again) if self.again.sum() <= TABLE // 2 else np.zeros(0, np.int64)
            to = np.full(len(self.again), -1)
            to[kept] = np.arange(len(kept))
            self.rows = {x: i for x, i in zip(self.rows, to[list(self.rows.values())].tolist(), strict=True) if i >= 0}
            self.cuts, self.groups, self.again = self.cuts.taken(kept), [self.groups[i] for i in kept.tolist()], np.zeros(len(kept), bool)
        n_old = len(self.groups)
        new = [x for x in segs if x not in self.rows]
        if new:
            cuts, order = self._aligned(new)
            ends = np.cumsum(cuts.sizes).tolist()
            self.rows.update((new[i], len(self.groups) + k) for k, i in enumerate(order))
            self.groups += [cuts.text[i:j] for i, j in zip([0, *ends], ends)]
            cuts.text = b""
            self.cuts = Cuts.joined([self.cuts, cuts])
        out = np.array([self.rows[x] for x in segs], np.int64)
        self.again = np.concatenate((self.again, np.zeros(len(self.groups) - n_old, bool)))
        self.again[out[out < n_old]] = True
        return out

    def documents(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, pa.Array, pa.Array]:
        """Of each text: groups, (n_a, n_b, n_groups, n_links), its distinct linked pairs and how often it has each."""
        segs, codes, n = segments(texts)
        codes = self.rows_of(segs)[codes] if segs else codes
        cuts, pieces = self.cuts, self.groups
        first = np.cumsum(cuts.counts[:, 3]) - cuts.counts[:, 3]
        end, to = np.concatenate(([0], np.cumsum(n))), 0
        groups: list[bytes] = []
        out: list[tuple] = []
        while to < len(n):
            at, to = to, max(to + 1, int(np.searchsorted(end, end[to] + GATHERED)) - 1)
            some = n[at:to]
            got, owner = codes[end[at] : end[to]], np.repeat(np.arange(len(some)), some)
            lost = np.bincount(owner, ~cuts.good[got], len(some)) > 0
            got, owner = got[~lost[owner]], owner[~lost[owner]]
            ends = np.searchsorted(owner, np.arange(len(some) + 1))
            total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(cuts.counts[got], axis=0)))
            order = got.tolist()
            groups += [b"".join([pieces[c] for c in order[i:j]])[:-1] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            m = cuts.counts[got, 3]
            pairs = cuts.links[np.repeat(first[got] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            span = len(self.a_bytes) * self.n_b
            keys, times = np.unique(np.repeat(owner, m) * span + pairs, return_counts=True)
            out.append((np.diff(total[ends], axis=0), np.diff(np.searchsorted(keys, np.arange(len(some) + 1) * span)), keys % span, times))
        sums, sizes, keys, times = (np.concatenate(x) for x in zip(*out, strict=True))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return groups, sums, pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def token_groups(docs: DataFrame, a_path: str, b_path: str, text: bool = False) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; with ``text`` also ``groups`` as written out.

    pairs: the distinct id pairs a * (size of B) + b that are linked in the document; times: how often each one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in text_slices(batches, 1, SLICE, SLICE_ROWS):
            groups, sums, pairs, times = aligner.documents(batch.column(1))
            sha = [hashlib.sha256(x).hexdigest() if x else "" for x in groups]
            cols = [batch.column(0), *[pa.array(sums[:, i]) for i in range(4)], pa.array(sha, pa.string()), pairs, times]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(groups, pa.binary()).cast(pa.string())] * text, ["doc", *COUNTS, "groups_sha256", "pairs", "times", *["groups"] * text])

    rows = packed(docs, "text")
    kind = StructType([rows.schema["doc"], *[StructField(c, LongType()) for c in COUNTS], StructField("groups_sha256", StringType())])
    kind.add("pairs", ArrayType(LongType())).add("times", ArrayType(IntegerType()))
    return rows.mapInArrow(run, kind.add("groups", StringType()) if text else kind)


def pair_counts(grouped: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no other pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(n))
            return key, total

        keys, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            key, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            keys, n = (list(x) for x in zip(merged([*keys, key], [*n, times]), strict=True))
            if len(keys[0]) > COUNTED_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(n[0])], ["pair", "n"])
                keys, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(n[0])], ["pair", "n"])

    counts = grouped.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {b_size}")))  # of one A id, B's vocabulary at most
    return counts.withColumn("best", F.col("n") == most)


def link_scores(grouped: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``grouped`` without its pairs, with n_best and count_sum: links that are their A id's most usual ones, and the sum of all links' counts."""
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toPandas().sort_values("pair")  # HOT_PAIRS rows at most
    all_hot = len(hot) < hot_pairs
    shared = grouped.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in grouped.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("pairs")
            lists, times = batch.column(at), batch.column(at + 1).flatten().to_numpy()
            flat = lists.flatten().to_numpy()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            where = np.minimum(np.searchsorted(pair, flat), len(pair) - 1) if len(pair) else np.zeros(len(flat), np.int64)
            hit = pair[where] == flat if len(pair) else np.zeros(len(flat), bool)
            sums = []
            for value in (best, n):
                run_up = np.concatenate(([0], np.cumsum(np.where(hit, value[where] if len(pair) else 0, 0) * times.astype(np.int64))))
                sums.append(pa.array(run_up[ends[1:]] - run_up[ends[:-1]]))
            left = np.concatenate(([0], np.cumsum(~hit)))[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *sums, *rest], [*batch.schema.names[:at], "n_best", "count_sum", "rest", "rest_times"])

    kind = StructType([*[grouped.schema[c] for c in kept], StructField("n_best", LongType()), StructField("count_sum", LongType())])
    kind.add("rest", ArrayType(LongType())).add("rest_times", ArrayType(IntegerType()))
    scored = grouped.select(*kept, "pairs", "times").mapInArrow(run, kind)
    if all_hot:
        return scored.drop("rest", "rest_times")
    scored = stored(scored, "align-scored")
    each = scored.select("row_id", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row_id", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("m"))
    more = each.join(counts, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("m")).alias("c"))
    out = scored.drop("rest", "rest_times").join(more, "row_id", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0))).drop("b", "c")


def align(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of ``docs``."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    grouped = token_groups(docs, a_path, b_path).withColumn("row_id", F.monotonically_increasing_id())
    grouped = stored(grouped.select("row_id", "doc", *COUNTS, "groups_sha256", "pairs", "times"), "align-groups", SLICE_ROWS)
    counts = stored(pair_counts(grouped, size), "align-pairs")
    return link_scores(grouped, counts, hot_pairs).drop("row_id")
