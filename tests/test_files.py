"""Captured bytes read from their folder, and XML as tables."""

import io
import zipfile

import pytest

from ledgerloom.plans.curation import _workbook
from ledgerloom.sources import files


def test_captured_files_are_read_by_path(spark, tmp_path):
    """Whole bytes of the files that work names, in folders below the root; missing ones fall out."""
    root = tmp_path / "raw"
    data = {"d1/r1/a.csv": b"a,b\n1,\xff\n", "d1/r2/b.bin": bytes(range(256)), "d2/r3/c d.txt": "текст".encode(), "d3/r4/unused.txt": b"x"}
    for name, content in data.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    work = spark.createDataFrame([("r1", "d1/r1/a.csv"), ("r2", "d1/r2/b.bin"), ("gone", "d9/x.csv"), ("none", None)], "resource_id string, raw_path string")
    got = {r["resource_id"]: (bytes(r["content"]), r["bytes"]) for r in files.read_captured(work, str(root)).collect()}
    assert got == {"r1": (data["d1/r1/a.csv"], 8), "r2": (data["d1/r2/b.bin"], 256)}
    cells = files.cells_of(files.read_captured(work, str(root)).selectExpr("resource_id", "'csv' AS parser", "content")).where("resource_id = 'r1'").collect()
    assert [r["cells"] for r in cells] == [["a", "b"], ["1", "я"]]


def test_xml_records():
    text = '<?xml version="1.0" encoding="x"?>\n<!-- c --><a:r xmlns:a="u"><m>meta</m><a:i k="1">t<n>x</n><n>y &lt;</n></a:i><a:i j="2"><p><q z="3">w</q></p></a:i><!-- <i/> --></a:r>'
    assert files.xml_records(text) == [["@k", "#text", "n", "@j", "p/q/@z", "p/q"], ["1", "t", "x\ny <", "", "", ""], ["", "", "", "2", "3", "w"]]
    assert files.xml_records("<r><v>1</v><v>2</v></r>") == [["#text"], ["1"], ["2"]]
    assert files.xml_records('<r a="1"><b>2</b></r>') == [["@a", "b"], ["1", "2"]]
    assert files.xml_records("<r/>") == [[], []]


def test_broken_xml_goes_to_quarantine(spark):
    rows = spark.createDataFrame([("ok", "<r><v>1</v><v>2</v></r>"), ("bad", "<r><v></r>"), ("null", None), ("text", "no xml")], "resource_id string, text string")
    good, bad = files.quarantine(files.xml_cells(rows))
    assert {r["resource_id"] for r in bad.collect()} == {"bad", "null", "text"} and good.count() == 3


def test_workbooks_share_what_is_read_of_their_short_parts():
    """Plain, deflated and streamed sheets give the same cells; a broken sheet gives the rows before its fault, and a changed byte is an error."""
    sheets = [("Lines", [["1", "R"], ["", "N&amp;1"]]), ("§", [["2", ""]])]
    data = _workbook(sheets)
    cells = [(0, "Lines", ["name", "", "7", "true"]), (0, "Lines", ["1", "R"]), (0, "Lines", ["", "N&1"]), (1, "§", ["name", "", "7", "true"]), (1, "§", ["2"])]
    files._remembered.cache_clear()
    assert [list(files.parse_workbook(data)) for _ in range(5)] == [cells] * 5
    assert (files._remembered.cache_info().misses, files._remembered.cache_info().hits) == (3, 12)

    def again(change=lambda name, part: part, how=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", how) as w:
            for name in z.namelist():
                w.writestr(name, change(name, z.read(name)))
        return out.getvalue()

    assert list(files.parse_workbook(again())) == list(files.parse_workbook(again(how=zipfile.ZIP_BZIP2))) == cells
    wide = again(lambda name, part: part.replace(b"</sheetData>", b" " * (2 * files.SMALL_PART) + b"</sheetData>"))
    assert list(files.parse_workbook(wide)) == cells
    rows = files.parse_workbook(again(lambda name, part: part.replace(b"</row><row><c r=\"B2\"", b"</row></broken><row><c r=\"B2\"")))
    assert next(rows) == cells[0]
    with pytest.raises(zipfile.BadZipFile):
        list(files.parse_workbook(data.replace(b">R<", b">S<")))
