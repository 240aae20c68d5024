import random

import pytest
from pyarrow import fs

from profloom.api import convert
from profloom.operators.rejects import structural_index
from profloom.sources import delimited, discovery, storage
from profloom.sources.discovery import Source

MIXED = 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x"y,1,2\n"two\nlines","q""q",5\r\n\n7,"8",\n'
VALID = [("1", "2", 3), ("7", "8", None), ("two\nlines", 'q"q', 5)]
BAD = [(12, "columns", "4,5"), (16, "columns", "6,7,8,9"), (24, "quoting", '"x"y,1,2')]


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return [str(folder / f"{n}.csv") for n in files]


def walked(data):
    """(start, text) of all records, sign by sign: a line end within an even number of quotes ends one."""
    out, at, even = [], 0, True
    for i, b in enumerate(data):
        even ^= b == 34
        if b == 10 and even:
            out.append((at, data[at:i].decode("utf-8", "replace")))
            at = i + 1
    return out + [(at, data[at:].decode("utf-8", "replace"))] * (at < len(data))


@pytest.mark.parametrize("chunk", [3, 8 << 20])
def test_records_of_blocks(tmp_path, monkeypatch, chunk):
    """Whatever the blocks, every record comes from the block it begins in, whole and once."""
    monkeypatch.setattr(delimited, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        data = b"".join(rng.choice([b"a", b",", b'"', b'"', b"\n", b"\r\n", "é".encode(), b"\xff"]) for _ in range(rng.randint(0, 40)))
        (tmp_path / "x").write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(3))})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            for offsets, texts in delimited.record_chunks(str(tmp_path / "x"), a, b, data.count(b'"', 0, a) % 2 == 1):
                got += zip(offsets.tolist(), texts.to_pylist())
        assert got == walked(data), data


def test_records_that_do_not_end(tmp_path, monkeypatch):
    """A quote that is never closed costs its line, not the file."""
    monkeypatch.setattr(delimited, "CHUNK", 16)
    monkeypatch.setattr(delimited, "LONGEST", 40)
    data = b"a,b\n1,2\n3,\"x\n" + b"".join(b"%d,y\n" % i for i in range(4, 60)) + b'60,"z\n61,w\n'
    (tmp_path / "x").write_bytes(data)
    got = []
    for a in range(0, len(data), 50):
        for offsets, texts in delimited.record_chunks(str(tmp_path / "x"), a, min(a + 50, len(data)), data.count(b'"', 0, a) % 2 == 1):
            for j in delimited.judge(offsets, texts, 2):
                got += zip(j.offsets.tolist(), j.texts.to_pylist(), j.reason)
    assert [t for _, t, _ in sorted(got)] == data.decode().splitlines()
    assert [(t, r) for _, t, r in sorted(got) if r] == [('3,"x', "quoting"), ('60,"z', "quoting")]
    assert all(data[a:].startswith(t.encode()) for a, t, _ in got)


def test_reasons_equal_the_structural_index():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice('a",\n') for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    got = {}
    for j in delimited.judge(np.arange(len(texts)) * 100, pa.array(texts, pa.large_string()), 2):
        got |= dict(zip(zip(j.offsets.tolist(), j.texts.to_pylist()), j.reason))
    s = structural_index(pa.array(texts))
    for i, t in enumerate(texts):
        if not s.broken[i]:
            assert got[i * 100, t] == ("" if s.first[i + 1] - s.first[i] == 2 else "columns")
        elif "\n" not in t:
            assert got[i * 100, t] == "quoting"


@pytest.mark.parametrize("block", [7, 64 << 20])
def test_valid_rows_and_rejects(tmp_path, spark, rows, monkeypatch, block):
    monkeypatch.setattr(delimited, "BLOCK", block)
    paths = put(tmp_path, mixed="﻿" + MIXED, good="a,b,c\n9,9,9\n")
    df = delimited.read_csv(spark, paths, malformed="rows")
    assert rows(df) == sorted([*VALID, ("9", "9", 9)], key=repr)
    bad = delimited.rejected_records(spark, paths)
    assert rows(bad, "path", "at", "reason", "raw") == sorted([(paths[0], at + 3, r, raw) for at, r, raw in BAD], key=repr)
    assert rows(delimited.read_csv(spark, paths)) == [(9, 9, 9)]  # malformed files as a whole
    with pytest.raises(ValueError):
        delimited.read_csv(spark, paths, malformed="none")


def test_large_files_are_read_in_parts_unless_fields_have_line_breaks(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(delimited, "BLOCK", 50_000)
    lines = "".join(f"{i},x{i}\n" for i in range(40_000))
    paths = put(tmp_path, single="k,v\n" + lines, several="k,v\n" + lines + '-1,"a\nb"\n', short="k,v\n1,\n")
    (headed,) = delimited.inspect(spark, [Source(p) for p in paths])
    assert headed.broken_lines == {paths[1]} and [t for _, t in delimited.read_csv(spark, paths).dtypes] == ["bigint", "string"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        one = delimited.read_csv(spark, paths[:1])
        assert one.rdd.getNumPartitions() >= 4 and one.count() == 40_000 and one.agg({"k": "sum"}).first()[0] == sum(range(40_000))
        assert delimited.read_csv(spark, paths).count() == 80_002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_are_read_in_one_job(tmp_path, spark):
    paths = put(tmp_path, **{f"f{i}": f"k,c{i % 3}\n{i},1\n" for i in range(30)}, bad=b"\xff\xfe\n1\n", empty="")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        known = delimited.inspect(spark, [Source(p) for p in paths])
        assert len(tracker.getJobIdsForGroup("headers")) <= 8  # not one for each of the headers or files
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [h.names for h in known] == [("k", f"c{i}") for i in range(3)] and [len(h.files) for h in known] == [10, 10, 10]


def test_uris(tmp_path, spark, rows):
    put(tmp_path / "a b", mixed=MIXED, good="a,b,c\n9,9,9\n")
    found = discovery.walk_files(f"file://{tmp_path}/a b", "*.csv")
    assert len(found) == 2 and rows(delimited.read_csv(spark, found, malformed="rows")) == sorted([*VALID, ("9", "9", 9)], key=repr)
    assert rows(delimited.read_csv(spark, [f"file://{tmp_path}/a b/good.csv"], malformed="rows")) == [(9, 9, 9)]


def test_registered_file_systems(tmp_path, spark, rows, monkeypatch):
    """Discovery, headers, table numbers, rows and rejects of files on a file system that only pyarrow knows."""
    put(tmp_path / "store" / "p1", Cells=MIXED, Image="n\n1\n")
    put(tmp_path / "store" / "p2", Cells="a,b,c\n9,9,9\n", Image="n\n2\n")
    monkeypatch.setitem(storage.SCHEMES, "mock", fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()))
    groups, kind = discovery.gather_sources(spark, "mock://store", ["cells", "image"])
    assert kind == "csv" and [s.path for s in groups["Cells.csv"]] == ["mock://store/p1/Cells.csv", "mock://store/p2/Cells.csv"]
    numbered = discovery.number_tables(spark, groups)
    assert len({s.table_number for s in numbered["Cells.csv"]}) == 2
    paths = [s.path for s in groups["Cells.csv"]]
    assert rows(delimited.read_csv(spark, paths)) == [(9, 9, 9)]
    assert delimited.read_csv(spark, paths, malformed="rows").count() == 4
    assert rows(delimited.rejected_records(spark, paths), "at", "reason", "raw") == sorted(BAD, key=repr)


def test_databases_on_registered_file_systems(tmp_path, spark, monkeypatch):
    import sqlite3

    from profloom.sources import sqlite

    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("CREATE TABLE Per_Cells (a INTEGER, b DOUBLE)")
        db.executemany("INSERT INTO Per_Cells VALUES (?, ?)", [(i, i / 2) for i in range(100)])
    monkeypatch.setitem(storage.SCHEMES, "mock", fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()))
    groups, _ = discovery.gather_sources(spark, "mock://d.sqlite", ["cells"])
    (source,) = groups["Per_cells.sqlite"]
    assert source.table == "Per_Cells" and sqlite.read_sqlite(spark, source.path, source.table).agg({"b": "sum"}).first()[0] == sum(range(100)) / 2


def test_convert_with_a_table_of_rejects(tmp_path, spark, rows):
    put(tmp_path / "in", Image="ImageNumber,FileName_DNA\n1,a.tif\n2\n", Cells="ImageNumber,ObjectNumber,X\n1,1,5\n1,2\n", Nuclei="ImageNumber,ObjectNumber,Y\n1,1,6\n",
        Cytoplasm="ImageNumber,ObjectNumber,Parent_Cells,Parent_Nuclei,Number_Object_Number\n1,1,1,1,1\n1,2,2,2,2,2\n")
    path = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), rejects_path=str(tmp_path / "rejects"))
    assert rows(spark.read.parquet(path), "Metadata_ImageNumber", "Cells_X", "Nuclei_Y") == [(1, 5, 6)]
    assert rows(spark.read.parquet(str(tmp_path / "rejects")), "reason", "raw") == sorted([("columns", "2"), ("columns", "1,2"), ("columns", "1,2,2,2,2,2")], key=repr)
