"""Packing along a space-filling curve.

Every document's token ids are hashed into a bag of BINS, projected to DIMS coordinates and given a
Hilbert key; documents are range-sorted by that key and laid end to end, and the line is cut every
``length`` tokens. Neighbours on the curve share sequences, and only the last sequence has padding.

Ranges are fixed by quantiles of (key, tie hash), so a third of all documents with one key still spread
over many ranges. Only one row per range (its number of tokens) is summed up to find where it starts.

Defined results: a null or empty text is its end token alone; repeated rows are packed as often as they
occur; an empty table gives no pieces; texts are tokenized whole, however long; other columns are ignored,
whatever their names. A string that spells one of the tokenizer file's added tokens has that token's id, as
``tokenizers`` gives it by default.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices

LENGTH, END_ID = 1024, 0
BINS, DIMS, BITS = 256, 3, 10
#: Documents a range holds on average, and most ranges (beyond, they hold more).
RANGE_DOCS, MAX_RANGES = 4096, 100_000
#: Rows and bytes of text that are tokenized at once: the more, the more chunks are alike.
TEXTS, SLICE = 512, 2 << 20
#: The split of byte-level BPE, with possessive repeats; and what it comes to in texts without two blanks in a row.
GPT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PLAIN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Tokenizer:
    """Ids of a byte-level BPE file as little-endian unsigned 16- or 32-bit numbers.

    A single space between two other characters always starts a token piece, so texts are cut there and each
    different chunk of a batch is encoded once, all of them as one text. A text with a run of white space that
    the cuts would split is encoded whole, and so is what stands between added tokens.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        found = file.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or not a["content"] for a in found):
            raise ValueError("added tokens that strip or need whole words aren't supported")
        self.added = {a["content"]: a["id"] for a in found}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.added and all(c in byte_of for c in t)}
        self.kind = "<u2" if max([*ranks.values(), *self.added.values()]) < 65536 else "<u4"
        self.kind_code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.encoder, self.plain = (tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (GPT_PATTERN, PLAIN_PATTERN))
        self.two_blanks = re.compile(r"\s\s")
        self.width = np.zeros(self.size, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(t) for t in ranks]

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of one whole text whose added tokens are plain text."""
        encoder = self.encoder if self.two_blanks.search(text) else self.plain
        return np.frombuffer(array(self.kind_code, encoder.encode_ordinary(text)), self.kind)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        if not any(x in text for x in self.added):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.added[m[0]]], self.kind)]
            at = m.end()
        return np.concatenate([*out, self.encode_plain(text[at:])])

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of ``texts`` (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        whole = np.zeros(len(texts), bool)  # texts that the cuts don't suit
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        chunks = cut.flatten().dictionary_encode()
        begin = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        body, code = chunks.dictionary, chunks.indices.to_numpy().copy()
        bad = _blank(pc.utf8_slice_codeunits(body, 0, 1)) | _blank(pc.utf8_slice_codeunits(body, -1))
        first = body.take(pa.array(code[begin])).to_pylist()  # a text's first chunk has no space before it
        alone = np.diff(np.concatenate((begin, [len(code)]))) == 1
        first_bad = bad[code[begin]] & ~(alone & np.array([not x for x in first]))
        ids, n = self._pieces(body.filter(pa.array(~bad)))
        firsts = [self.encode_plain("" if b else x) for x, b in zip(first, first_bad.tolist(), strict=True)]
        sizes = np.zeros(len(body) + len(texts), np.int64)
        sizes[: len(body)][~bad] = n
        sizes[len(body) :] = [len(x) for x in firsts]
        code[begin] = len(body) + np.arange(len(texts))
        whole |= np.logical_or.reduceat(np.concatenate((bad, first_bad))[code], begin)
        flat, n = np.concatenate([ids, *firsts]), sizes[code]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n) + np.arange(ends[-1])]
        out = np.split(out, ends[begin[1:] - 1])
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out

    def _pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``chunks``, each behind a space, and how many each has."""
        if not len(chunks):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), pa.scalar(" ", pa.large_string()))[0].as_py()
        ids = self.encode_plain(" " + joined)
        ends = np.cumsum(pc.binary_length(chunks).to_numpy() + 1)
        is_end = np.zeros(ends[-1] + 1, bool)
        is_end[ends] = True
        last = np.flatnonzero(is_end[np.cumsum(self.width[ids])])
        if len(last) != len(chunks):
            raise ValueError("a token spans two chunks")
        return ids, np.diff(np.concatenate(([-1], last)))


def _blank(chars: pa.Array) -> np.ndarray:
    """Which of the one-character strings are empty or white space."""
    chars = chars.dictionary_encode()
    return np.array([x == "" or x.isspace() for x in chars.dictionary.to_pylist()], bool)[chars.indices.to_numpy()]


def points(ids: list[np.ndarray], bins: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """DIMS coordinates in [0, 2**BITS) of each document: its hashed bag of ids, normalised and projected."""
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    bag = np.sqrt(np.bincount(owner * BINS + bins[np.concatenate(ids)], minlength=len(ids) * BINS).reshape(-1, BINS))
    at = (bag / np.sqrt((bag**2).sum(axis=1, keepdims=True))) @ plane
    return np.clip((np.tanh(at) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(row_id, doc_id, n, curve, ids, kind) of every row, written once: ids of the whole text and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, rng = Tokenizer(tokenizer_path), np.random.default_rng(20240229)
        bins, plane = rng.integers(0, BINS, tok.size), rng.normal(size=(BINS, DIMS))
        plane -= plane.mean(axis=0)  # else all texts share their common part's coordinate
        end = np.array([END_ID], tok.kind)
        for batch in text_slices(batches, 1, SLICE, TEXTS):
            ids = [np.concatenate((x, end)) for x in tok.encode_all(batch.column(1))]
            keys = hilbert_keys(points(ids, bins, plane)) if ids else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([tok.kind] * len(ids))],
                ["doc_id", "n", "key", "ids", "kind"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, key long, ids binary, kind string")
    # the key, then a hash: documents with one key are still told apart
    curve = F.shiftleft(F.col("key"), 32) + F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 32)
    return stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "n", curve.alias("curve"), "ids", "kind"), "pack-ids", TEXTS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every document's pieces in their sequences."""
    rows = encode(docs, tokenizer_path)
    total = rows.count()
    n_ranges = min(MAX_RANGES, max(1, total // RANGE_DOCS))
    cuts = rows.select(F.percentile_approx("curve", [i / n_ranges for i in range(1, n_ranges)], max(20_000, 2 * n_ranges))).first()[0] if n_ranges > 1 else []
    edges = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("long")
    def range_of(curve: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, curve.to_numpy(), side="right"))

    placed = rows.withColumn("range", range_of("curve"))
    # a row per range
    sums = placed.groupBy("range").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select(F.col("range").alias("r"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "pack-base")
    line = placed.join(F.broadcast(base), F.col("range") == F.col("r")).select("range", "curve", "row_id", "doc_id", "n", "base", "ids", "kind")
    # a range a task; hashed, several would meet in one
    line = line.repartitionById(len(edges) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "curve", "row_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7)]
            for which, doc_id, n, start_of_range, raw, kind in zip(*cols, strict=True):
                if which != here:
                    here, at = which, start_of_range
                ids, start = np.frombuffer(raw, kind).astype("<u4").tobytes(), 0
                while start < n:
                    take = min(n - start, length - at % length)
                    out.append((doc_id, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), n, at // length, at % length))
                    start, at = start + take, at + take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            done = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(3).type), *[pa.array(x, pa.int64()) for x in done[1:]]], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return line.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
