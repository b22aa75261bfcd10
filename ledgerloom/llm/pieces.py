"""SentencePiece encoding and decoding over tables of distinct marked words.

No piece of the model reaches over the start of a marked word, which is a run of space marks and what follows it up
to the next mark. So every marked word has the same pieces wherever it stands: each different one of a task's texts is
segmented once by the library, and its ids are put in all its places by position. The table of a task holds
TABLE words at most (then it starts anew), so memory is bounded however many words the corpus has, and nothing is
shuffled: one table for the whole corpus would move most words of every block of texts there and back again, since
most distinct words are rare ones.

Defined results: a null or empty text has the begin and end ids alone and decodes to the empty text; texts are encoded
whole, however long; repeated rows and repeated or null ids are kept as they are; an empty table gives no rows; the
table's own columns come back in the struct ``doc``, so that no name clashes. U+2581 in a text is the mark itself and
comes back as a space, as the library has it.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructType

from .common import packed, text_slices

MARK = "▁"
#: Marked words a task's table holds at most, and code points of the longest one it keeps.
TABLE, LONGEST = 1 << 18, 64


def marked_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words without their first mark, the number of each word in order, and the words each text has."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    if not len(texts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    cut = pc.split_pattern(texts, " ")
    at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    parts, begin, end = cut.flatten(), at[:-1], at[1:]
    last = np.zeros(len(parts), bool)
    last[end - 1] = True
    # an empty part is one more mark before the next part; a text's last part counts even if it is empty
    kept = np.flatnonzero((pc.binary_length(parts).to_numpy() > 0) | last)
    owner = np.searchsorted(end, kept, side="right")
    marks = kept - np.maximum(np.concatenate(([-1], kept[:-1])), begin[owner] - 1) - 1
    words = parts.take(pa.array(kept))
    if marks.any():
        more = [" " * n + w for n, w in zip(marks[marks > 0].tolist(), words.filter(pa.array(marks > 0)).to_pylist(), strict=True)]
        words = pc.replace_with_mask(words, pa.array(marks > 0), pa.array(more, pa.large_string()))
    some = (pc.binary_length(texts).to_numpy() > 0)[owner]
    coded = words.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.bincount(owner[some], minlength=len(texts))


class WordPieces:
    """A SentencePiece model with a bounded table of the marked words it has segmented."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        odd = " ①  　a\t"
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in names) or self.model.decode(self.model.encode(odd)) != odd:
            raise ValueError("pieces that reach over a mark, or a model that rewrites texts, need whole texts")
        self.alone = self._bytes(self.model.encode("a ")[len(self.model.encode("a")) :])
        self.begin, self.end = self._bytes([self.model.bos_id()]), self._bytes([self.model.eos_id()])
        self.table: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def segmented(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct marked word, as little-endian unsigned 32-bit numbers."""
        out = list(map(self.table.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.table) + len(new) > TABLE:
            self.table = {}
        for i, ids in zip(new, self.model.encode([words[i] for i in new], num_threads=1), strict=True):
            out[i] = self._bytes(ids) if words[i] else self.alone
            if len(words[i]) <= LONGEST:
                self.table[words[i]] = out[i]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each whole text between the begin and end ids."""
        words, codes, n = marked_words(texts)
        ids, codes, ends = self.segmented(words), codes.tolist(), np.cumsum(n).tolist()
        return [self.begin + b"".join([ids[c] for c in codes[a:b]]) + self.end for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) if ids else []


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc, ids, decoded) of every row of ``docs`` (text and any other columns).

    ids: the text's ids as little-endian unsigned 32-bit numbers; decoded: the text that they decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(model_path)
        for batch in text_slices(batches, 1):
            ids = pieces.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(pieces.decode(ids), pa.string())], ["doc", "ids", "decoded"])

    rows = packed(docs, "text")
    return rows.mapInArrow(run, StructType([rows.schema["doc"]]).add("ids", BinaryType()).add("decoded", StringType()))
