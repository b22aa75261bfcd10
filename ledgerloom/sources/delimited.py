"""Large delimited files over many tasks: every split of a file is parsed on its own, in the state in which it begins.

Spark's text source cuts files into splits at line ends. A line end either ends a row or stands in a quoted cell, so a
split begins in one of two states. It is parsed under both, which gives for each the state it ends in and the rows
that begin in it; these few numbers are composed along each file, and then each split is parsed once more in its true state
and with the numbers of its rows. Only rows that reach over a split's end are put together from their parts by a shuffle.

A line must fit in memory, a file needn't. Encoding and delimiter are those of ``files`` (the whole file decides).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..functions.tables import stored
from .files import BATCH_ROWS, HEAD, by_high_bytes, sniff_delimiter

#: Splits up to which their states are sent to all tasks.
MAX_SPLITS = 500_000
#: Ends the text of a split; what is in no file.
_END = "\x00end of split\x00"


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, split, line): the lines of all files under ``root`` as bytes, in order within a split."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))


def _pieces(lines: Iterable[str]) -> Iterator[str]:
    """Lines for a reader; a lone \\r ends one too."""
    for line in lines:
        yield from re.split("(?<=\r)(?!\n)", line + "\n") if "\r" in line else (line + "\n",)
    yield _END


def parse_split(lines: Iterable[str], delimiter: str, quoted: bool) -> Iterator[tuple[list[str], bool]]:
    """(cells, whole) of the rows of a split that begins inside a quoted cell or not; the last one isn't whole if the split ends inside one.

    Where ``quoted``, the first row is the rest of one that began before.
    """
    csv.field_size_limit(2**31 - 1)
    pieces = _pieces(lines)
    if quoted:
        first = next(pieces)
        pieces = _before('"' + first, pieces)
    for row in csv.reader(pieces, delimiter=delimiter, doublequote=True, strict=False):
        if row and row[-1].endswith(_END):
            if row != [_END]:
                yield [*row[:-1], row[-1][: -len(_END)]], False
            return
        yield row or [""], True


def _before(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Each split of a task's rows with its lines, which are read on while they are used."""

    def each() -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in keys]
            yield from zip(zip(*cols, strict=True), (x or b"" for x in batch.column("line").to_pylist()), strict=True)

    rows = each()
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                line = ahead[1]
                ahead = next(rows, None)
                yield line

        lines = own()
        yield key, lines
        for _ in lines:  # what wasn't read
            pass


def _decoded(lines: Iterator[bytes], encoding: str, first: bool) -> Iterator[str]:
    for i, line in enumerate(lines):
        yield line.decode("utf-8-sig" if first and i == 0 and encoding == "utf-8" else encoding, "replace")


def file_formats(lines: DataFrame) -> DataFrame:
    """(path, encoding, delimiter, ended) of each file of read_lines(); ended: whether its last line has its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, size, split), own in _runs(batches, ["path", "size", "split"]):
            valid, head, line, n = True, b"", None, 0
            for x in own:
                n += len(x) + 1
                if valid:
                    try:
                        x.decode()
                    except UnicodeDecodeError:
                        valid = False
                if len(head) < HEAD:
                    head += x + b"\n"
                if line is None and x.strip():
                    line = x
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (path, size, split, valid, head[:HEAD])] + [pa.array([line], pa.binary()), pa.array([n])], ["path", "size", "split", "valid", "head", "line", "n"])

    splits = lines.mapInArrow(run, "path string, size long, split long, valid boolean, head binary, line binary, n long")
    by = splits.groupBy("path").agg(
        F.bool_and("valid").alias("valid"),
        F.array_sort(F.collect_list(F.when(F.col("split") < HEAD, F.struct("split", "head")))).alias("heads"),
        F.min_by("line", F.when(F.col("line").isNotNull(), F.col("split"))).alias("line"),
        (F.sum("n") == F.first("size")).alias("ended"),
    )

    @F.pandas_udf("encoding string, delimiter string")
    def decided(valid: pd.Series, head: pd.Series, line: pd.Series) -> pd.DataFrame:
        def one(ok: bool, data: bytes, first: bytes | None) -> tuple[str, str]:
            encoding = "utf-8" if ok or data.startswith(b"\xef\xbb\xbf") else by_high_bytes(data)[0]
            return encoding, sniff_delimiter((first or b"").decode("utf-8-sig" if encoding == "utf-8" else encoding, "replace"))

        return pd.DataFrame([one(*x) for x in zip(valid, head, line, strict=True)], columns=["encoding", "delimiter"])

    head = F.aggregate("heads", F.lit(b""), lambda a, x: F.concat(a, x["head"]))  # HEAD bytes, in one split or several
    return by.select("path", decided("valid", head, "line").alias("f"), "ended").select("path", "f.*", "ended")


def split_states(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """(path, split, encoding, delimiter, quoted, row_no, last, ended): the state in which each split begins and the number of the first row that begins in it."""
    told = lines.drop("size").join(broadcast_if_small(formats, MAX_SPLITS), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _runs(batches, ["path", "split", "encoding", "delimiter"]):
            path, split, encoding, delimiter = key
            # both readers take a line at a time, so no split is held
            plain, inside = _Feed(delimiter, False), _Feed(delimiter, True)
            for line in _decoded(own, encoding, split == 0):
                plain.take(line)
                inside.take(line)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (path, split, plain.begun, plain.open, inside.begun, inside.open)], ["path", "split", "n0", "end0", "n1", "end1"])

    ends = stored(told.select("path", "split", "line", "encoding", "delimiter").mapInArrow(run, "path string, split long, n0 long, end0 boolean, n1 long, end1 boolean"), "split-ends")

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        """A row a split, of one file."""
        rows, state, at = rows.sort_values("split"), False, 0
        out = []
        for i, r in enumerate(rows.itertuples(index=False)):
            out.append((r.path, r.split, state, at, i == len(rows) - 1))
            at += r.n1 if state else r.n0
            state = r.end1 if state else r.end0
        return pd.DataFrame(out, columns=["path", "split", "quoted", "row_no", "last"])

    found = ends.groupBy("path").applyInPandas(along, "path string, split long, quoted boolean, row_no long, last boolean")
    return found.join(broadcast_if_small(formats, MAX_SPLITS), "path")


class _Feed:
    """Counts the rows that begin in a split under one state, a line at a time."""

    def __init__(self, delimiter: str, quoted: bool):
        self.begun, self.open, self.delimiter = 0, quoted, delimiter

    def take(self, line: str) -> None:
        # a line without a quote changes nothing: inside a quoted cell it goes on, outside each of its ends ends a row
        if '"' not in line:
            if not self.open:
                self.begun += 1 if "\r" not in line else sum(1 for _ in parse_split([line], self.delimiter, False))
            return
        self.begun -= self.open  # the row that goes on didn't begin here
        for _, whole in parse_split([line], self.delimiter, self.open):
            self.begun, self.open = self.begun + 1, not whole


def delimited_cells(lines: DataFrame) -> DataFrame:
    """(path, row_no, cells) of delimited files, from read_lines(): the rows that ``files.parse_delimited`` gives of each whole text."""
    states = stored(split_states(lines, stored(file_formats(lines), "delimited-formats")), "split-states")
    told = lines.drop("size").join(broadcast_if_small(states, MAX_SPLITS), ["path", "split"])
    keys = ["path", "split", "encoding", "delimiter", "quoted", "row_no", "last", "ended"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["path", "row_no", "split", "part", "cells"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        held: list[tuple] = []
        for (path, split, encoding, delimiter, quoted, at, last, ended), own in _runs(batches, keys):
            number = at - 1 if quoted else at
            for i, (cells, whole) in enumerate(parse_split(_decoded(own, encoding, split == 0), delimiter, quoted)):
                if last and not whole and not ended:
                    cells[-1] = cells[-1][:-1]  # the file's last line has no end
                held.append((path, number + i, split, (quoted and i == 0) or not (whole or last), cells))
                if len(held) >= BATCH_ROWS:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    rows = told.select(*keys, "line").mapInArrow(run, "path string, row_no long, split long, part boolean, cells array<string>")
    rows = stored(rows, "delimited-rows")
    parts = rows.where("part").groupBy("path", "row_no").agg(F.array_sort(F.collect_list(F.struct("split", "cells"))).alias("ps"))
    # the last cell of what is there goes on with the first one of the next part
    glued = F.aggregate(
        F.slice("ps", 2, F.size("ps")),
        F.col("ps")[0]["cells"],
        lambda a, p: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), p["cells"][0])), F.slice(p["cells"], 2, F.size(p["cells"]))),
    )
    return rows.where("not part").select("path", "row_no", "cells").unionByName(parts.select("path", "row_no", glued.alias("cells")))
