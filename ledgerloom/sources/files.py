"""Captured files: which to read, what kind they are, how they are encoded, and their cells.

Files come as rows with a binary column, as Spark's binaryFile source gives them.
"""

from __future__ import annotations

import csv
import functools
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats by kind, and the types that make a JSON object GeoJSON.
KIND_OF_FORMAT = {"csv": "tabular", "tsv": "tabular", "xlsx": "tabular", "xls": "tabular", "geojson": "geojson", "json": "json", "jsonl": "json", "ndjson": "json", "xml": "xml", "txt": "text", "text": "text", "md": "text"}
GEOJSON_TYPES = "Feature(?:Collection)?|Point|Polygon|LineString|MultiPolygon|MultiLineString|MultiPoint|GeometryCollection"
#: Rows of one output batch: a large file leaves a worker in pieces.
BATCH_ROWS = 5000
#: Bytes that decide an encoding where not all are valid UTF-8.
HEAD = 8192


def captured(datasets: DataFrame, resources: DataFrame, ids: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """Resources to curate: of active datasets, with a stored file, last captured with success. Filters come before the join."""
    live = datasets.where("lifecycle = 'active'").select(F.col("id").alias("dataset_id"))
    if ids is not None:
        live = live.where(F.col("dataset_id").isin(ids))
    res = resources.where("raw_path is not null and last_outcome = 'success'")
    if since is not None:
        res = res.where(F.col("last_synced_at") >= since)
    return res.join(live, "dataset_id", "left_semi")


def read_captured(work: DataFrame, root: str) -> DataFrame:
    """``work`` with the files' content; resources whose file is missing fall out."""
    folder = re.escape(root.rstrip("/").split("/")[-1])
    files = work.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(F.regexp_replace("path", f"^.*?/{folder}/", "").alias("raw_path"), "content", F.col("length").alias("bytes"))
    return work.join(named, "raw_path")


def kind_of_format(fmt: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_OF_FORMAT.items() for x in kv]), F.lower(fmt))


def sniff(content: Column, file_name: Column, declared_format: Column, content_type: Column) -> Column:
    """struct<kind, reason>: by first bytes, extension, declared format, content type, else text."""
    head = F.substring(content, 1, 1027)
    is_zip = F.hex(F.substring(content, 1, 2)) == "504B"
    text = F.try_validate_utf8(head.cast("string"))
    # cut in a character, a head isn't valid text; the ASCII before it is all that counts
    text = F.coalesce(text, F.decode(head, "iso-8859-1"))
    text = F.regexp_replace(text, "^(?:﻿|ï»¿)?[ \\t\\n\\r]+|^(?:﻿|ï»¿)", "")
    first = F.substring(text, 1, 1)
    geo = F.rlike(text, F.lit(f'"type"\\s*:\\s*"(?:{GEOJSON_TYPES})"'))
    magic = F.when(is_zip, "tabular").when(first == "<", "xml").when((first == "{") & geo, "geojson").when(first.isin("{", "["), "json")
    extension = kind_of_format(F.regexp_extract(file_name, r"\.([^./]+)$", 1))
    low = F.lower(content_type)
    by_type = (
        F.when(F.rlike(low, F.lit("csv|tab-separated|spreadsheet")), "tabular")
        .when(F.contains(low, F.lit("geo+json")), "geojson")
        .when(F.contains(low, F.lit("json")), "json")
        .when(F.contains(low, F.lit("xml")), "xml")
        .when(F.startswith(low, F.lit("text/")), "text")
    )
    tries = [(magic, "magic"), (extension, "extension"), (kind_of_format(declared_format), "declared-format"), (by_type, "declared-content-type"), (F.lit("text"), "fallback")]
    return F.coalesce(*[F.when(k.isNotNull(), F.struct(k.alias("kind"), F.lit(why).alias("reason"))) for k, why in tries])


def parser_for(kind: Column, content: Column, declared_format: Column) -> Column:
    """csv, xlsx, geojson, json, xml or text: the kind's first parser that takes the bytes. Delimited text refuses zip bytes."""
    is_zip = F.hex(F.substring(content, 1, 2)) == "504B"
    tabular = F.when(is_zip, "xlsx").otherwise("csv")
    return F.when(kind == "tabular", tabular).when(kind.isin("geojson", "json", "xml"), kind).otherwise("text")


def accepting_parser(kind: Column, content: Column, declared_format: Column, file_name: Column) -> Column:
    """The kind's first parser if it takes the file by its declared format or name, else the first in order that does; text takes all.

    Delimited text refuses zip bytes, and a workbook is also known by them.
    """
    declared, name = F.lower(F.coalesce(declared_format, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    is_zip = F.hex(F.substring(content, 1, 2)) == "504B"
    ends = lambda pattern: F.rlike(name, F.lit(rf"\.(?:{pattern})$"))
    takes = {
        "csv": (declared.isin("csv", "tsv") | ends("csv")) & ~F.coalesce(is_zip, F.lit(False)),
        "xlsx": (declared == "xlsx") | ends("xlsx") | F.coalesce(is_zip, F.lit(False)),
        "geojson": (declared == "geojson") | ends("geojson"),
        "json": declared.isin("json", "jsonl", "ndjson") | ends("json|jsonl|jsonnd"),
        "xml": (declared == "xml") | ends("xml"),
    }
    own = F.when(kind == "tabular", "csv").otherwise(kind)
    first = [F.when((own == name) & ok, name) for name, ok in takes.items()]
    return F.coalesce(*first, F.when(kind == "text", "text"), *[F.when(ok, name) for name, ok in takes.items()], F.lit("text"))


def sniff_encoding(data: bytes) -> tuple[str, float]:
    """(encoding, confidence) from a byte-order mark, valid UTF-8, or the share of Cyrillic-looking high bytes."""
    if data[:3] == b"\xef\xbb\xbf":
        return "utf-8", 1.0
    if data.isascii():
        return "utf-8", 1.0
    try:
        data.decode("utf-8")
        return "utf-8", 0.85
    except UnicodeDecodeError:
        return by_high_bytes(data)


def by_high_bytes(data: bytes) -> tuple[str, float]:
    """(encoding, confidence) of bytes that aren't UTF-8, from the first HEAD of them."""
    high = np.frombuffer(data[:HEAD], np.uint8)
    high = high[high >= 0x80]
    return ("cp1251", 0.8) if len(high) and (high >= 0xC0).mean() >= 0.8 else ("utf-8", 0.5)


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType())])


@F.pandas_udf(DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    """struct<text, encoding, confidence>. The whole code page 1251 is decoded, also its signs and non-breaking spaces."""

    def one(data: bytes | None):
        if data is None:
            return None, None, None
        encoding, sure = sniff_encoding(data)
        return data.decode("utf-8-sig" if encoding == "utf-8" else encoding, "replace"), encoding, sure

    return pd.DataFrame([one(x) for x in content], columns=["text", "encoding", "confidence"])


def sniff_delimiter(text: str) -> str:
    line = next((x for x in text.split("\n") if x.strip()), "")
    commas = line.count(",")
    return ";" if line.count(";") > commas else "\t" if line.count("\t") > commas else ","


def parse_delimited(text: str) -> Iterator[list[str]]:
    """Rows of cells; quotes may hold separators and line ends, blank lines inside stay as rows of one empty cell."""
    csv.field_size_limit(2**31 - 1)
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text), doublequote=True, strict=False):
        yield row or [""]


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_slug(name: str, taken: set[str]) -> str:
    """A sheet's name in lower-case letters, digits and dashes; where ``taken`` has it, with the first free number behind. Adds itself to ``taken``."""
    base = re.sub(r"[\W_]+", "-", name.lower()).strip("-") or "sheet"
    free = next(s for s in itertools.chain([base], (f"{base}-{n}" for n in itertools.count(1))) if s not in taken)
    taken.add(free)
    return free


#: Bytes of a part that is read at once (a larger sheet is read as a stream), and of one whose content is remembered.
SMALL_PART, SHORT_PART = 1 << 20, 1 << 14


def _content(z: zipfile.ZipFile, data: bytes, name: str) -> bytes:
    """A part of the workbook ``data``, checked; plain and deflated parts are cut out without a file object."""
    info = z.getinfo(name)
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.file_size > SMALL_PART or data[info.header_offset : info.header_offset + 4] != b"PK\x03\x04":
        return z.read(name)
    at = info.header_offset + 30 + sum(struct.unpack_from("<HH", data, info.header_offset + 26))
    out = data[at : at + info.compress_size]
    if info.compress_type == zipfile.ZIP_DEFLATED:
        out = zlib.decompressobj(-15).decompress(out)
    if zlib.crc32(out) != info.CRC:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {name!r}")
    return out


def _strings(part: bytes) -> list[str]:
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(part).iter(f"{_MAIN}si")]


def _targets(part: bytes) -> dict[str | None, str | None]:
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(part)}


def _sheets(part: bytes) -> list[tuple[str | None, str | None]]:
    return [(x.get("name"), x.get(f"{_REL}id")) for x in ElementTree.fromstring(part).iter(f"{_MAIN}sheet")]


@functools.lru_cache(256)
def _remembered(read, part: bytes):
    return read(part)


def _read(read, part: bytes):
    """What ``read`` makes of a part; many workbooks share their short ones, which are read once."""
    return _remembered(read, part) if len(part) <= SHORT_PART else read(part)


@functools.lru_cache(4096)
def _column(reference: str) -> int:
    """Number of the column of a cell such as C7, from 1; 0 without one."""
    at = 0
    for ch in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(ch) - 64
    return at


def _row_cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for c in row.iter(f"{_MAIN}c"):
        at = _column(c.get("r") or "")
        if at - 1 > len(cells):
            cells += [""] * (at - 1 - len(cells))
        kind = c.get("t")
        if kind == "inlineStr":
            cells.append("".join([t.text or "" for t in c.iter(f"{_MAIN}t")]))
            continue
        value = next((v.text or "" for v in c if v.tag == f"{_MAIN}v"), "")
        cells.append(shared[int(value)] if kind == "s" else ("true" if value == "1" else "false") if kind == "b" else value)
    return cells


def parse_workbook(data: bytes) -> Iterator[tuple[int, str, list[str]]]:
    """(number of the sheet, its name, cells) of every row in the workbook's order of sheets; empty sheets give nothing."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _read(_strings, _content(z, data, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in z.NameToInfo else []
        rels = _read(_targets, _content(z, data, "xl/_rels/workbook.xml.rels"))
        for number, (name, rel) in enumerate(_read(_sheets, _content(z, data, "xl/workbook.xml"))):
            target = rels[rel].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if z.getinfo(part).file_size <= SMALL_PART:
                try:
                    root = ElementTree.fromstring(_content(z, data, part))
                except (ElementTree.ParseError, zlib.error, zipfile.BadZipFile):
                    root = None  # as a stream it gives the rows before the fault
                if root is not None:
                    for row in root.iter(f"{_MAIN}row"):
                        yield number, name, _row_cells(row, shared)
                    continue
            with z.open(part) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag == f"{_MAIN}row":
                        yield number, name, _row_cells(row, shared)
                        row.clear()


CELLS = "resource_id string, sheet string, slug string, row_no long, width int, cells array<string>, error string"


def cells_of(files: DataFrame) -> DataFrame:
    """(resource_id, sheet, slug, row_no, width, cells, error) of delimited files and workbooks. files: (resource_id, parser, content).

    width: cells of the table's first row; slug: the sheet's name as a path, unique in its workbook. A file's rows leave in batches of BATCH_ROWS; one that can't be parsed gives a row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["resource_id", "sheet", "slug", "row_no", "width", "cells", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

        def rows_of(rid: str, parser: str, data: bytes) -> Iterator[tuple]:
            if parser == "xlsx":
                here, slug, taken, row_no, width = None, None, set(), 0, 0
                for number, sheet, cells in parse_workbook(data):
                    if number != here:
                        here, slug, row_no, width = number, sheet_slug(sheet, taken), 0, len(cells)
                    yield rid, sheet, slug, row_no, width, cells, None
                    row_no += 1
                if here is None:
                    raise ValueError("no sheet with rows")
            else:
                encoding, _ = sniff_encoding(data)
                text = data.decode("utf-8-sig" if encoding == "utf-8" else encoding, "replace")
                width = 0
                for i, cells in enumerate(parse_delimited(text)):
                    width = width if i else len(cells)
                    yield rid, None, None, i, width, cells, None

        for batch in batches:
            held: list[tuple] = []
            for rid, parser, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                try:
                    for row in rows_of(rid, parser, data):
                        held.append(row)
                        if len(held) >= BATCH_ROWS:
                            yield batch_of(held)
                            held = []
                except Exception as e:  # noqa: BLE001  a bad file never stops a run
                    held.append((rid, *[None] * 5, f"{type(e).__name__}: {e}"))
            if held:
                yield batch_of(held)

    return files.where(F.col("parser").isin("csv", "xlsx")).select("resource_id", "parser", "content").mapInArrow(run, CELLS)


def json_documents(texts: DataFrame) -> DataFrame:
    """(resource_id, document variant, root, error): JSON of any shape. Text that isn't one JSON value has an error."""
    # the parser stops behind the first value; in brackets, anything that follows shows
    alone = F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))
    single = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    doc = texts.withColumn("document", F.when(single, F.try_parse_json("text")))
    kind = F.schema_of_variant("document")
    root = F.when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object").otherwise("scalar")
    bad = F.col("document").isNull()
    return doc.select("resource_id", "document", F.when(~bad, root).alias("root"), F.when(bad, "not JSON").alias("error"))


GEO = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, geometry struct<type:string,coordinates:string>, properties map<string,string>"


def geojson_features(texts: DataFrame) -> DataFrame:
    """(resource_id, geometry_type, coordinates, properties, error): a row per feature; other roots have an error."""
    doc = texts.select("resource_id", F.from_json("text", GEO).alias("g"))
    one = F.array(F.struct(F.col("g.type"), F.col("g.geometry"), F.col("g.properties")))
    features = F.when(F.col("g.type") == "FeatureCollection", F.col("g.features")).when(F.col("g.type") == "Feature", one)
    at = doc.select("resource_id", F.explode_outer(features).alias("f"), F.when(features.isNull(), "neither Feature nor FeatureCollection").alias("error"))
    return at.select("resource_id", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"), "error")


def root_element(text: Column) -> Column:
    """Name of the first element after declarations and comments."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<\?.*?\?>", ""), r"(?s)<!--.*?-->", "")
    return F.nullif(F.regexp_extract(plain, r"<([A-Za-z_][\w:.-]*)", 1), F.lit(""))


def _plain_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_records(text: str) -> list[list[str]]:
    """The repeated element of an XML text as a table: a row of column names, then a row a record.

    The records are the elements of the path that occurs most often, of equally frequent ones the shortest and then the
    first; a document without any repeated path is one record. A record's columns are its attributes (``@name``), its own text
    (``#text``) and its descendants by path (``a/b``, ``a/@c``), in the order in which they are first seen; what repeats within a
    record is joined by line ends. Names lose their namespaces. Broken XML is an error.
    """
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    counts: dict[tuple[str, ...], int] = {}

    def count(node: ElementTree.Element, path: tuple[str, ...]) -> None:
        for child in node:
            at = (*path, _plain_name(child.tag)) if isinstance(child.tag, str) else None
            if at:
                counts[at] = counts.get(at, 0) + 1
                count(child, at)

    count(root, ())
    # leaves without attributes are cells, unless the document has nothing else that repeats
    nodes = {at: any(other[: len(at)] == at and len(other) > len(at) for other in counts) for at in counts}
    repeated = [at for at, n in counts.items() if n > 1]
    best = min([at for at in repeated if nodes[at]] or repeated, key=lambda at: (-counts[at], len(at)), default=None)
    found = [root]
    for name in best or ():
        found = [c for x in found for c in x if isinstance(c.tag, str) and _plain_name(c.tag) == name]
    columns: dict[str, int] = {}
    records: list[dict[str, str]] = []

    def fill(node: ElementTree.Element, prefix: str, into: dict[str, str]) -> None:
        cells = [(f"{prefix}@{_plain_name(k)}", v) for k, v in node.attrib.items()]
        own = (node.text or "").strip()
        if own:
            cells.append((prefix.rstrip("/") or "#text", own))
        for k, v in cells:
            columns.setdefault(k, len(columns))
            into[k] = f"{into[k]}\n{v}" if k in into else v
        for child in node:
            if isinstance(child.tag, str):
                fill(child, f"{prefix}{_plain_name(child.tag)}/", into)

    for x in found:
        records.append(row := {})
        fill(x, "", row)
    return [list(columns), *[[r.get(c, "") for c in columns] for r in records]]


def xml_cells(texts: DataFrame) -> DataFrame:
    """(resource_id, row_no, width, cells, error) of XML texts (resource_id, text); row 0 has the columns' names, as in a delimited file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for rid, text in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                try:
                    table = xml_records(text or "")
                    rows = [(rid, i, len(table[0]), cells, None) for i, cells in enumerate(table)]
                except ElementTree.ParseError as e:
                    rows = [(rid, None, None, None, f"ParseError: {e}")]
                for at in range(0, len(rows), BATCH_ROWS):
                    part = rows[at : at + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], ["resource_id", "row_no", "width", "cells", "error"])

    return texts.select(F.col("resource_id").cast("string"), "text").mapInArrow(run, "resource_id string, row_no long, width int, cells array<string>, error string")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the uncurated resources with their reason."""
    bad = parsed.where("error is not null").select("resource_id", F.lit("uncurated").alias("kind"), F.col("error").alias("reason")).distinct()
    return parsed.where("error is null").drop("error"), bad


def payload_kind(payload: Column) -> Column:
    """How a datastore payload is stored: a string as txt, arrays of arrays as csv, the rest as json; nothing is an empty payload."""
    doc = F.try_parse_json(payload)
    shape = F.schema_of_variant(doc)
    first = F.schema_of_variant(F.try_variant_get(doc, "$[0]", "variant"))
    empty = payload.isNull() | shape.isin("VOID", "ARRAY<VOID>")
    return F.when(empty, "empty").when(shape == "STRING", "txt").when(F.startswith(shape, F.lit("ARRAY")) & F.startswith(first, F.lit("ARRAY")), "csv").otherwise("json")
