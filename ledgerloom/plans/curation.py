"""Curation over files that are rendered from the driver's tables, so the source columns are the expected cells."""

import functools
import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate
from ..sources import delimited, files, portal, sinks
from .base import datasets, query, scratch, stored, t


@query("SELECT id AS dataset_id, 'r' || id AS resource_id FROM datasets WHERE lifecycle = 'active' AND CAST(id AS BIGINT) % 3 > 0 AND CAST(id AS BIGINT) % 7 > 0 AND last_synced_at >= TIMESTAMP '2026-01-05'", "datasets")
def a1_captured(spark: SparkSession, d: str) -> DataFrame:
    ds = datasets(spark, d)
    k = F.col("id").cast("long")
    res = ds.select(F.col("id").alias("dataset_id"), F.concat(F.lit("r"), "id").alias("resource_id"), F.when(k % 3 > 0, "p").alias("raw_path"), F.when(k % 7 > 0, "success").otherwise("failed").alias("last_outcome"), "last_synced_at")
    return files.captured(ds, res, since=F.lit("2026-01-05").cast("timestamp")).select("dataset_id", "resource_id")


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of several kinds; the name, format and type only count where the bytes say nothing."""
    k = F.col("page_id") % 8
    geo = F.lit('{"type": "FeatureCollection", "features": []}')
    text = F.when(k == 0, F.col("html")).when(k == 1, F.lit('\n {"a": 1}')).when(k == 2, geo).when(k == 3, "[1]").when(k == 4, F.lit("PK\x03\x04")).otherwise("a;b")
    name = F.when(k == 5, "x.CSV").otherwise("noext")
    return t(spark, d, "pages").select("page_id", text.cast("binary").alias("content"), name.alias("name"), F.when(k == 6, "XML").alias("format"), F.when(k == 7, "text/csv; charset=x").alias("type"))


@query(
    """SELECT page_id, (['xml', 'json', 'geojson', 'json', 'tabular', 'tabular', 'xml', 'tabular'])[page_id % 8 + 1] AS kind, CASE WHEN page_id % 8 < 5 THEN 'magic' ELSE (['extension', 'declared-format', 'declared-content-type'])[page_id % 8 - 4] END AS reason,
         (['xml', 'json', 'geojson', 'json', 'xlsx', 'csv', 'xml', 'csv'])[page_id % 8 + 1] AS parser FROM pages"""
)
def a2_a3_sniff(spark: SparkSession, d: str) -> DataFrame:
    f = _page_files(spark, d).withColumn("s", files.sniff(F.col("content"), F.col("name"), F.col("format"), F.col("type")))
    return f.select("page_id", "s.kind", "s.reason", files.parser_for(F.col("s.kind"), F.col("content"), F.col("format")).alias("parser"))


def cp1251(text: Column) -> Column:
    """Bytes of Cyrillic letters and ASCII in the old code page, by way of the Latin letters at the same places."""
    upper, lower = "".join(chr(0x410 + i) for i in range(64)), "".join(chr(0xC0 + i) for i in range(64))
    return F.encode(F.translate(text, upper, lower), "iso-8859-1")


@query(
    """SELECT page_id, (['text', 'text', 'text', 'text', 'xlsx', 'csv', 'xml', 'text'])[page_id % 8 + 1] AS parser FROM pages"""
)
def a3_accepting_parser(spark: SparkSession, d: str) -> DataFrame:
    """The parser that takes the file: by declared format, name or zip bytes, else text."""
    f = _page_files(spark, d).withColumn("s", files.sniff(F.col("content"), F.col("name"), F.col("format"), F.col("type")))
    return f.select("page_id", files.accepting_parser(F.col("s.kind"), F.col("content"), F.col("format"), F.col("name")).alias("parser"))


@query("""SELECT c_custkey, 'Община ' || c_custkey || ' Ямбол' AS text, (['cp1251', 'utf-8', 'utf-8'])[c_custkey % 3 + 1] AS encoding, CAST(([0.8, 0.85, 1.0])[c_custkey % 3 + 1] AS DOUBLE) AS confidence FROM customer""")
def a4_a10_decode(spark: SparkSession, d: str) -> DataFrame:
    text, k = F.concat(F.lit("Община "), F.col("c_custkey").cast("string"), F.lit(" Ямбол")), F.col("c_custkey") % 3
    data = F.when(k == 0, cp1251(text)).when(k == 1, text.cast("binary")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary")))
    return t(spark, d, "customer").select("c_custkey", files.decoded(data).alias("x")).select("c_custkey", "x.*")


def _line_files(spark: SparkSession, d: str) -> DataFrame:
    """A semicolon-delimited file an order: dates day first, decimal commas, a quoted cell with a line end and a quote."""
    row = F.concat_ws(";", F.col("l_linenumber").cast("string"), F.date_format("l_shipdate", "dd.MM.yyyy"), F.translate(F.format_string("%.2f", "l_extendedprice"), ".", ","), F.concat(F.lit('"a;""'), "l_returnflag", F.lit('""\n"')), F.when(F.col("l_linenumber") % 2 == 0, "да").otherwise("не"))
    by = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))).alias("rows"))
    body = F.concat(F.lit("№;Дата;Цена;Бележка;Да\r\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\r\n"), F.lit("\r\n"))
    return by.select(F.col("l_orderkey").cast("string").alias("resource_id"), F.lit("csv").alias("parser"), body.cast("binary").alias("content"))


LINES_SQL = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, strftime(l_shipdate, '%d.%m.%Y'), printf('%.2f', l_extendedprice)) AS row_no FROM lineitem)"""


@query(
    f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, row_no, l_linenumber || '|' || strftime(l_shipdate, '%d.%m.%Y') || '|' || replace(printf('%.2f', l_extendedprice), '.', ',') || '|a;"' || l_returnflag || '"' || chr(10)
        || '|' || CASE WHEN l_linenumber % 2 = 0 THEN 'да' ELSE 'не' END AS cells FROM ln"""
)
def a5_delimited(spark: SparkSession, d: str) -> DataFrame:
    cells = files.cells_of(_line_files(spark, d))
    return cells.where("row_no > 0").select("resource_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS fp FROM documents")
def a5_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as quoted cells of a few large files, each parsed by as many tasks as it has splits."""
    path = scratch(spark, "large-files")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs.coalesce(2).write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = delimited.delimited_cells(delimited.read_lines(spark, path))
    return cells.where("row_no > 0").select(F.col("cells")[0].alias("id"), F.md5(F.col("cells")[1]).alias("fp"))


_SPREADSHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zipped(at: int, name: bytes, data: bytes) -> tuple[bytes, bytes]:
    """An uncompressed part that begins at byte ``at`` of a zip file, and its entry in the directory."""
    head = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(name), 0)
    return b"PK\x03\x04" + head + name + data, b"PK\x01\x02\x14\0" + head + struct.pack("<HHHII", 0, 0, 0, 0, at) + name


@functools.lru_cache(64)
def _workbook_frame(names: tuple[str, ...]) -> tuple[bytes, bytes]:
    """The parts that workbooks with sheets of these names share, and their entries."""
    sheets = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
    rels = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i + 1}.xml"/>' for i in range(len(names)))
    parts = entries = b""
    for name, text in (
        (b"xl/workbook.xml", f"<workbook {_SPREADSHEET}><sheets>{sheets}</sheets></workbook>"),
        (b"xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'),
        (b"xl/sharedStrings.xml", f"<sst {_SPREADSHEET}><si><t>name</t></si></sst>"),
    ):
        part, entry = _zipped(len(parts), name, text.encode())
        parts, entries = parts + part, entries + entry
    return parts, entries


def _workbook(rows: list[tuple[str, list[list[str]]]]) -> bytes:
    """A minimal workbook: shared strings, inline strings, numbers and booleans."""
    parts, entries = _workbook_frame(tuple(n for n, _ in rows))
    for i, (_, cells) in enumerate(rows):
        body = "".join(["<row>" + "".join([f'<c r="{chr(65 + j)}{r + 1}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(row) if c]) + "</row>" for r, row in enumerate(cells)])
        head = '<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c><c r="D1" t="b"><v>1</v></c></row>'
        part, entry = _zipped(len(parts), f"xl/worksheets/s{i + 1}.xml".encode(), f"<worksheet {_SPREADSHEET}><sheetData>{head}{body}</sheetData></worksheet>".encode())
        parts, entries = parts + part, entries + entry
    n = len(rows) + 3
    return parts + entries + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, len(entries), len(parts), 0)


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS resource_id, 'orders' AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, o_orderstatus || '||' || o_orderkey AS cells FROM orders
       UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'orders', 0, 'name||7|true' FROM orders"""
)
def a6_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """A workbook of each customer's orders, written and read back."""

    def write(parts):
        for p in parts:
            data = [_workbook([("orders", [[r["o_orderstatus"], "", str(r["o_orderkey"])] for r in rows])]) for rows in p["rows"]]
            yield pd.DataFrame({"resource_id": p["resource_id"], "parser": "xlsx", "content": data})

    by = t(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("resource_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    cells = files.cells_of(by.mapInPandas(write, "resource_id string, parser string, content binary"))
    return cells.select("resource_id", "sheet", "row_no", F.array_join("cells", "|").alias("cells"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, sheet, slug, count(*) + 1 AS n_rows, 'name||7|true;' || string_agg(l_linenumber || '|' || l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) AS cells
       FROM lineitem, (VALUES ('Lines', 'lines'), ('LINES!', 'lines-1'), ('§', 'sheet')) x(sheet, slug) WHERE l_orderkey % 10 = 0 OR slug = 'lines' GROUP BY 1, 2, 3"""
)
def a6_order_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """A workbook an order; every tenth has three sheets of which two would have one path."""

    def write(batches):
        for batch in batches:
            ids, data = batch.column(0).to_pylist(), []
            for rid, numbers, flags in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells = list(zip(numbers, flags, strict=True))
                data.append(_workbook([(name, cells) for name in (["Lines", "LINES!", "§"] if int(rid) % 10 == 0 else ["Lines"])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["xlsx"] * len(ids)), pa.array(data, pa.binary())], ["resource_id", "parser", "content"])

    by = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("resource_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("rows"))
    by = by.select("resource_id", F.col("rows.l_linenumber").cast("array<string>").alias("numbers"), F.col("rows.l_returnflag").alias("flags"))
    cells = files.cells_of(by.mapInArrow(write, "resource_id string, parser string, content binary"))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", "|").alias("c"))))
    return cells.groupBy("resource_id", "sheet", "slug").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(ordered, lambda x: x["c"]), ";").alias("cells"))


@query("SELECT event_id AS resource_id, CASE WHEN event_id % 3 < 2 THEN (['object', 'array'])[event_id % 3 + 1] END AS root, CASE WHEN event_id % 3 = 2 THEN 'not JSON' END AS error FROM events")
def a7_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat("props", F.lit("\n"), "props"))
    rows = t(spark, d, "events").select(F.col("event_id").alias("resource_id"), text.alias("text"))
    return files.json_documents(rows).select("resource_id", "root", "error")


@query("""SELECT c_custkey AS resource_id, CASE WHEN c_custkey % 3 < 2 THEN 'Point' END AS geometry_type, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 2 THEN 'neither Feature nor FeatureCollection' END AS error FROM customer""")
def a8_geojson(spark: SparkSession, d: str) -> DataFrame:
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(23.3), F.col("c_acctbal")).alias("coordinates")).alias("geometry"), F.struct(F.col("c_name").alias("name")).alias("properties")))
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, feature).when(k == 1, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))).otherwise('{"type":"Point"}')
    rows = files.geojson_features(t(spark, d, "customer").select(F.col("c_custkey").alias("resource_id"), text.alias("text")))
    return rows.select("resource_id", "geometry_type", F.try_element_at("properties", F.lit("name")).alias("name"), "error")


@query("SELECT page_id, 'html' AS root FROM pages")
def a9_xml_roots(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('<?xml version="1.0"?><!-- <no/> -->'), "html")
    return t(spark, d, "pages").select("page_id", files.root_element(text).alias("root"))


@query(
    f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'order|' ELSE '' END || l_linenumber || '|R&' || l_returnflag || '|' || l_partkey AS record FROM ln"""
)
def a9_xml_rows(spark: SparkSession, d: str) -> DataFrame:
    """An XML file an order: its lines are the records, with an attribute, an entity and a nested element; an order with one line is one record itself."""
    line = F.format_string('<o:line n="%s"><flag>R&amp;%s</flag><part><key>%s</key></part></o:line>', F.col("l_linenumber").cast("string"), "l_returnflag", F.col("l_partkey").cast("string"))
    by = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit('<?xml version="1.0"?><!-- lines --><o:order xmlns:o="urn:o"><kind>order</kind>'), "body", F.lit("</o:order>"))
    rows = files.xml_cells(by.select(F.col("l_orderkey").alias("resource_id"), text.alias("text")))
    return rows.where("row_no > 0").select("resource_id", F.array_join("cells", "|").alias("record"))


@query("SELECT CAST(event_id AS VARCHAR) AS resource_id, 'uncurated' AS kind, 'not JSON' AS reason FROM events WHERE event_id % 5 = 0")
def a11_quarantine(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props"))
    rows = t(spark, d, "events").select(F.col("event_id").cast("string").alias("resource_id"), text.alias("text"))
    return files.quarantine(files.json_documents(rows))[1]


@query("SELECT o_orderkey, (['txt', 'csv', 'json', 'json', 'empty', 'empty'])[o_orderkey % 6 + 1] AS kind FROM orders")
def a12_payloads(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey") % 6, F.col("o_orderstatus")
    q = F.concat(F.lit('"'), s, F.lit('"'))
    payload = F.when(k == 0, q).when(k == 1, F.concat(F.lit('[["a"],['), q, F.lit("]]"))).when(k == 2, F.concat(F.lit('[{"a":'), q, F.lit("}]"))).when(k == 3, '{"a":1}').when(k == 4, "[]")
    return t(spark, d, "orders").select("o_orderkey", files.payload_kind(payload).alias("kind"))


@query(
    """SELECT p_partkey, (['Year|Income ' || p_name || '|Income all', 'Year|' || p_name || '|', 'a|' || p_name || '|c'])[p_partkey % 3 + 1] AS header, CAST(([2, 1, 1])[p_partkey % 3 + 1] AS INTEGER) AS data_start FROM part"""
)
def a13_headers(spark: SparkSession, d: str) -> DataFrame:
    """Two header rows, two rows of text before the numbers' row under a label that no blank follows, and a plain header."""
    row = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    rows = (
        F.when(k == 0, F.array(row("Year", "Income", ""), row("", n, "all"), row("2024", "1,5", " 3 ")))
        .when(k == 1, F.array(row("Year", n, ""), row("x", "y"), row("2024", "1", "2")))
        .otherwise(F.array(row(" a ", n, "c"), row("1", "2", "3"), row("1", "2", "3")))
    )
    return t(spark, d, "part").select("p_partkey", portal.merged_header(rows).alias("h")).select("p_partkey", F.array_join("h.header", "|").alias("header"), "h.data_start")


@query('''SELECT p_partkey, p_name || ',' || '"' || p_brand || ', ""' || p_type || '"""' || ',,' || p_size AS line FROM part''')
def a14_delimited_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array("p_name", F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')), F.lit(None).cast("string"), F.col("p_size").cast("string"))
    return t(spark, d, "part").select("p_partkey", sinks.delimited_line(cells).alias("line"))


def _curated_parts(spark: SparkSession, d: str) -> str:
    """Parts by brand as curated resources, written to the shared folder."""
    rows = t(spark, d, "part").select(F.lit("parts").alias("dataset_id"), F.col("p_brand").alias("resource_id"), F.lit(None).cast("string").alias("sheet"), F.col("p_partkey").alias("row_no"), F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string")).alias("row"))
    schemas = rows.select("dataset_id", "resource_id", "sheet").distinct().withColumn("columns", F.array(F.lit("name"), F.lit("size")))
    path = scratch(spark, "curated")
    sinks.write_curated(rows, schemas, path)
    return path


@query("SELECT p_brand AS resource_id, count(*) AS n, max(p_name) AS last, 'name,size' AS columns FROM part GROUP BY 1")
def a15_curated_files(spark: SparkSession, d: str) -> DataFrame:
    path = _curated_parts(spark, d)
    rows = spark.read.schema("row_no long, row map<string,string>, resource_id string").json(f"{path}/rows")
    schemas = spark.read.schema("resource_id string, columns array<string>").json(f"{path}/schemas")
    by = rows.groupBy("resource_id").agg(F.count("*").alias("n"), F.max(F.col("row")["name"]).alias("last"))
    return by.join(schemas, "resource_id").select("resource_id", "n", "last", F.array_join("columns", ",").alias("columns"))


@query("SELECT p_partkey AS row_no, p_size AS size, (SELECT count(*) FROM part WHERE p_brand = 'Brand#4' AND contains(p_name, 'r')) AS total FROM part WHERE p_brand = 'Brand#4' AND contains(p_name, 'r') ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def a18_resource_page(spark: SparkSession, d: str) -> DataFrame:
    page, total, _ = sinks.read_resource_page(spark, _curated_parts(spark, d), "parts", "Brand#4", sort="size", descending=True, filters={"name": "R"}, limit=20, offset=5)
    return page.select("row_no", F.col("row")["size"].cast("int").alias("size"), F.lit(total).cast("long").alias("total"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, source AS publisher_id, lang || ',x' AS tags, 'r' || doc_id AS resource, CAST(CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END AS INTEGER) AS position FROM documents
       UNION ALL SELECT CAST(doc_id AS VARCHAR), source, lang || ',x', 's' || doc_id, 1 FROM documents"""
)
def a16_packages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    res = F.array(F.struct(F.concat(F.lit("r"), k).alias("id"), F.when(F.col("doc_id") % 2 == 0, 5).alias("position")), F.struct(F.concat(F.lit("s"), k).alias("id"), F.lit(None).cast("int").alias("position")))
    doc = F.struct(k.alias("id"), F.struct(F.col("source").alias("id")).alias("organization"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("x").alias("name"))).alias("tags"), res.alias("resources"))
    _, ds, rows = portal.flatten_packages(t(spark, d, "documents").select(F.to_json(doc).alias("package")))
    at = rows.select("dataset_id", F.col("id").alias("resource"), "position").join(ds.select("id", "publisher_id", "tags"), F.col("dataset_id") == F.col("id"))
    return at.select("id", "publisher_id", F.array_join("tags", ",").alias("tags"), "resource", "position")


@query("SELECT source AS id FROM documents GROUP BY 1")
def a16_organizations(spark: SparkSession, d: str) -> DataFrame:
    doc = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.col("source").alias("id")).alias("organization"))
    return portal.flatten_packages(t(spark, d, "documents").select(F.to_json(doc).alias("package")))[0].select("id")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return curate.long_cells(files.cells_of(_line_files(spark, d)))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, CAST(c AS INTEGER) AS col_no, (['integer', 'datetime', 'decimal', 'string', 'boolean'])[c + 1] AS type, false AS nullable, CASE WHEN c = 3 THEN 0.7 ELSE 0.95 END AS confidence FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(5) t(c)
    WHERE NOT (c = 2 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_extendedprice >= 1000))
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 2, CASE WHEN count(*) FILTER (l_extendedprice < 1000) >= count(*) * 0.9 THEN 'decimal' ELSE 'string' END, false, CASE WHEN count(*) FILTER (l_extendedprice < 1000) >= count(*) * 0.9 THEN 0.8 ELSE 0.7 END FROM lineitem GROUP BY l_orderkey HAVING max(l_extendedprice) >= 1000""")
def e1_column_types(spark: SparkSession, d: str) -> DataFrame:
    """A decimal comma behind four digits without a group mark isn't a number, so most price columns are text."""
    return curate.infer_types(_cells(spark, d), ["resource_id", "col_no"]).select("resource_id", "col_no", "type", "nullable", "confidence")


@query(f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, row_no, CAST(l_linenumber AS VARCHAR) AS number, strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END AS flag FROM ln""")
def e2_typed_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(files.cells_of(_line_files(spark, d)).select("resource_id", "sheet", "row_no", "width", "cells"), "cells")
    typed = curate.typed_rows(rows.where("row_no > 0"), curate.infer_types(curate.long_cells(rows), ["resource_id", "col_no"]), ["resource_id"])
    return typed.select("resource_id", "row_no", F.get("typed", F.lit(0)).alias("number"), F.get("typed", F.lit(1)).alias("day"), F.get("typed", F.lit(4)).alias("flag"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, 'no,data,tsena,belezhka,da' AS names FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def b5_table_headers(spark: SparkSession, d: str) -> DataFrame:
    return curate.headers(files.cells_of(_line_files(spark, d))).select("resource_id", F.array_join("names", ",").alias("names"))
