"""A file parsed split by split has the cells of the file parsed as a whole, wherever it is cut."""

import random

import pytest

from ledgerloom.sources import delimited as de
from ledgerloom.sources import files


def serial(data):
    encoding, _ = files.sniff_encoding(data)
    return list(files.parse_delimited(data.decode("utf-8-sig" if encoding == "utf-8" else encoding, "replace")))


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def parsed(spark, root):
    out = {}
    for r in de.delimited_cells(de.read_lines(spark, str(root))).collect():
        out.setdefault(r["path"].split("/")[-1], {})[r["row_no"]] = r["cells"]
    assert all(sorted(rows) == list(range(len(rows))) for rows in out.values())
    return {name: [rows[i] for i in range(len(rows))] for name, rows in out.items()}


def test_any_cut_gives_the_serial_cells(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    parts = ["a", "bc", ",", ",", ";", "\t", '"', '"', '""', "\n", "\n", "\r\n", "\r", "é", "日本", "ж", " ", "x,y", '"q\nq"', '\n"', '",']
    names = {"plain": 'a,b\n1,"2\n3\n4\n5\n6 lines, long enough for many splits\n"\n\n7,"8 ""x"" 9"\n' * 9, "open": 'a,b\n1,"never closed\nand on\nand on', "open end": 'a,"x\n', "bom": "﻿a;b\nc;d\n", "one": "x", "blank": "\n\n\n", "no end": "a,b\nc,d", "long": '"' + "many lines\n" * 30 + '",z\nlast,"1"\n', "mac": "a,b\rc,d\re,f"}
    data = {k: v.encode() for k, v in names.items()}
    data["cp1251"] = ("име,град\n" + 'Иван,"София\nи Пловдив"\n' * 25).encode("cp1251")
    data["late bad byte"] = b"a,b\n" * 60 + b"\xff,c\n"
    for i in range(20):
        data[f"r{i}"] = "".join(rng.choice(parts) for _ in range(rng.randint(1, 600))).encode()
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    got = parsed(spark, tmp_path)
    for name, x in data.items():
        assert got.get(name.replace(" ", "%20"), got.get(name, [])) == serial(x), name


@pytest.mark.parametrize("quoted", [False, True])
def test_split_states_compose(quoted):
    """A split parsed under a state begins as many rows and ends as its lines do one by one."""
    rng = random.Random(6)
    for _ in range(300):
        lines = "".join(rng.choice(["a", ",", '"', '""', "\n", "\r", "é"]) for _ in range(20)).split("\n")
        feed = de._Feed(",", quoted)
        for x in lines:
            feed.take(x)
        rows = list(de.parse_split(lines, ",", quoted))
        assert (feed.begun, feed.open) == (len(rows) - quoted, not rows[-1][1])
