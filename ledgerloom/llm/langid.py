"""Language identification by rank-order profiles of character n-grams.

A profile is a language's PROFILE most frequent n-grams (1 to 3 letters, word ends count as a space) in
order. A text's own most frequent n-grams are compared with each profile by out-of-place distance: the
sum of rank differences, PROFILE for an n-gram that the profile lacks. The nearest profile wins.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything when
nothing was learned. Ties in rank go by the n-gram's code, ties in distance by the language's name.
Repeated rows are predicted alike, and texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BATCH, arrow_batches, stored

PROFILE = 300
UNKNOWN = "und"
#: Codes that a task gathers, over all languages, before they are counted and sent on.
FLUSH = 2_000_000
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: letters are lower-cased, everything else is a word end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 0).astype(np.int64)
    points = np.concatenate(([0], points, [0]))
    # one 0 between words
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    a, b = points[:-1], points[1:]
    three = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.concatenate((points[points != 0], (1 << 62) | (a << 21) | b, three[points[1:-1] != 0]))


def ranked(codes: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` most frequent codes in order."""
    got, n = np.unique(codes, return_counts=True)
    return got[np.lexsort((got, -n))[:top]]


def learn(docs: DataFrame, top: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from all rows of ``docs`` (lang, text): counts are summed by Spark, ``top`` rows a language come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush(lang: str) -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = ngrams(text)
                held.setdefault(lang, []).append(codes)
                size += len(codes)
                if size >= FLUSH:
                    yield from map(flush, list(held))
                    size = 0
        yield from map(flush, list(held))

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    sums = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    with arrow_batches(docs.sparkSession, TEXT_BATCH):
        for r in best.orderBy("lang", "rank").collect():  # top rows a language, whatever the input's size
            out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) from doc_id and text alone; score is 1 - distance / largest distance."""
    names = sorted(profiles)
    by_code = []
    for name in names:
        order = np.argsort(profiles[name])
        by_code.append((profiles[name][order], order))

    def guess(text: str | None) -> tuple[str, float]:
        codes = ngrams(text) if text and names else ()
        if not len(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, top)
        place, far = np.arange(len(own)), []
        for known, rank in by_code:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            far.append(int(np.where(known[at] == own, np.minimum(np.abs(rank[at] - place), top), top).sum()))
        best = int(np.argmin(far))
        return names[best], 1.0 - far[best] / (top * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return stored(out, "languages", TEXT_BATCH)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned on the rows that aren't held out, predicted for all."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
