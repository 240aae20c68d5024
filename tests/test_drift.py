import csv
import io
from datetime import datetime

import pytest

from profloom.operators import drift

SCHEMA = "file_id bigint, series_id bigint, exported_at timestamp_ntz, body string"
T = lambda d: datetime(2024, 1, d)


def changes(spark, rows, files, partitions=None):
    return rows(drift.schema_changes(spark.createDataFrame(files, SCHEMA), partitions), "file_id", "field_name", "change")


SERIES = [
    (9, 1, T(1), "ImageNumber,Count,Plate\n1,5,P1\n2,6,P2\n"),
    (2, 1, T(2), "﻿\"Metadata_Plate\",ImageNumber,Count\r\nP2,2,6.0\r\nP3,3,\r\n"),
    (3, 1, T(3), "ImageNumber,Total,Metadata_Plate\n3,x,P3\n4,7,P4\n"),
    (4, 1, T(4), "ImageNumber,Total,Metadata_Plate,New\n4,7,P4,\n5,8,P5,\n"),
    (5, 1, T(5), "ImageNumber,Metadata_Plate,New\n5,P5,1\n"),
    (6, 1, T(6), "ImageNumber,Metadata_Plate,New,Total\n5,P5,NaN,8\n6,P6,2,9\n"),
    (1, 2, T(1), "ImageNumber,A\n1,1\n"), (7, 2, T(7), "ImageNumber,B\n2,1\n"),
]
EXPECTED = sorted([
    (2, "Metadata_Plate", "renamed"), (2, "Count", "retyped"), (3, "Total", "added"), (3, "Count", "removed"),
    (4, "New", "added"), (4, "Total", "retyped"), (5, "Total", "removed"), (6, "Total", "added"), (6, "New", "retyped"),
    (7, "A", "removed"), (7, "B", "added"),
], key=repr)


@pytest.mark.parametrize("partitions", [1, 2, 3, 100])
def test_changes_of_a_series(spark, rows, partitions):
    assert changes(spark, rows, SERIES, partitions) == EXPECTED


def test_rename_keeps_the_kind_and_may_retype(spark, rows):
    files = [(1, 1, T(1), "ImageNumber,A\n1,1\n2,\n"), (2, 1, T(2), "ImageNumber,A\n1,\n2,\n"), (3, 1, T(3), "ImageNumber,A\n3,7\n"), (4, 1, T(4), "ImageNumber,B\n3,7.0\n4,x\n")]
    assert changes(spark, rows, files, 2) == [(4, "B", "renamed"), (4, "B", "retyped")]


def test_all_blank_is_no_rename(spark, rows):
    assert changes(spark, rows, [(1, 1, T(1), "ImageNumber,A\n1,\n"), (2, 1, T(2), "ImageNumber,B\n1,\n")]) == [(2, "A", "removed"), (2, "B", "added")]


def test_odd_bodies(spark, rows):
    files = [
        (1, 1, T(1), None), (2, 1, T(2), ""), (3, 1, T(3), "ImageNumber,A,A\n1,2,x\n1,9,9\n2\n"), (4, 1, T(4), 'ImageNumber,A\n1,"2"\n\n2,,,\n'),
        (5, None, None, "ImageNumber\n"), (6, None, T(1), "Image,B\n"),
    ]
    got = changes(spark, rows, files)
    assert got == [(3, "A", "added"), (3, "ImageNumber", "added"), (6, "B", "added"), (6, "Image", "added"), (6, "ImageNumber", "removed")]


def test_repeated_rows_and_null_ids(spark, rows):
    twice = [(1, 1, T(1), "ImageNumber,A\n1,1\n")] * 2 + [(None, 1, T(2), "ImageNumber,A\n1,x\n")] * 3
    assert changes(spark, rows, twice, 2) == [(None, "A", "retyped")]


REPEATED = [
    (1, 1, T(1), "ImageNumber,A,B\n1,1,1\n,2,1\n"),
    (2, 1, T(2), "ImageNumber,A,B\n1,1,1\n1.0,x,1\n,2,1\n,2,2.5\n"),
    (3, 1, T(3), "ImageNumber,C,B\n1,1,7\n2,7,7\n2,8,nan\n"),
]


def test_kinds_come_from_all_lines_of_an_image(spark, rows):
    wider = [(2, "A", "retyped"), (2, "B", "retyped"), (2, "ImageNumber", "retyped")]
    assert changes(spark, rows, REPEATED[:2]) == wider
    assert changes(spark, rows, REPEATED) == [*wider, (3, "C", "renamed"), (3, "C", "retyped"), (3, "ImageNumber", "retyped")]


def test_repeated_images_as_in_the_sql(spark, rows):
    import duckdb

    from profloom.plans import records

    db = duckdb.connect()
    db.execute("CREATE TABLE image_file (file_id BIGINT, series_id BIGINT, exported_at TIMESTAMP, body VARCHAR)")
    db.executemany("INSERT INTO image_file VALUES (?, ?, ?, ?)", REPEATED[:2])
    assert sorted(db.execute(records.SQL["p4_found"]).fetchall()) == changes(spark, rows, REPEATED[:2])


def test_consistent_table_of_repeated_images(spark, rows):
    table = drift.consistent_table(spark.createDataFrame(REPEATED, SCHEMA))
    assert table.dtypes == [("file_id", "bigint"), ("A", "string"), ("B", "double"), ("C", "bigint"), ("ImageNumber", "double")]
    assert rows(table.where("file_id = 2"), "A", "B") == [("1", 1.0), ("2", 1.0), ("2", 2.5), ("x", 1.0)]


def test_no_files(spark, rows):
    assert changes(spark, rows, []) == []
    table = drift.consistent_table(spark.createDataFrame([], SCHEMA))
    assert table.columns == ["file_id"] and table.count() == 0


def test_partitions_do_not_matter(spark, rows, data):
    files = spark.read.parquet(f"{data}/image_file.parquet")
    whole = rows(drift.schema_changes(files), "file_id", "field_name", "change")
    assert whole and whole == rows(drift.schema_changes(files, 17), "file_id", "field_name", "change")
    order = [r["file_id"] for r in files.orderBy("series_id", "exported_at", "file_id").select("file_id").collect()]
    assert all(order[r["seq"]] == r["file_id"] for r in drift.schema_changes(files, 17).collect())


def plain(body):
    """Field names, of each field the cell by image, and kinds, cell by cell."""
    lines = [x for x in csv.reader(io.StringIO((body or "").removeprefix("\ufeff"), newline="")) if x]
    names, records = lines[0], [(x + [""] * len(lines[0]))[: len(lines[0])] for x in lines[1:]]
    images, cells = [drift.canonical(r[names.index("ImageNumber")]) for r in records], {n: {} for n in names}
    kinds = dict.fromkeys(names, 0)
    for i, n in enumerate(names):
        for k, r in zip(images, records):
            cells[n].setdefault(k, r[i])
            kind = 0 if not r[i].strip() else 1 if drift.WHOLE.fullmatch(r[i]) else 2 if drift.NUMBER.fullmatch(r[i]) else 3
            kinds[n] = max(kinds[n], kind)
    return names, cells, kinds


def test_changes_in_order_against_a_plain_walk(spark, rows, data):
    """Every series file by file, without partitions and chains."""
    files = spark.read.parquet(f"{data}/image_file.parquet").collect()
    expected = []
    for series in {f["series_id"] for f in files}:
        kinds, before = {}, None
        for f in sorted((f for f in files if f["series_id"] == series), key=lambda f: f["exported_at"]):
            names, cells, new = plain(f["body"])
            if before is None:
                kinds = new
            else:
                old_cells = before
                came, gone = [n for n in names if n not in old_cells], [n for n in old_cells if n not in cells]
                both = [k for k in cells["ImageNumber"] if k in old_cells["ImageNumber"]]
                state = {}
                for n in names:
                    source = n if n in old_cells else None
                    if n in came:
                        own = [drift.canonical(cells[n][k]) for k in both]
                        source = next((g for g in gone if any(own) and own == [drift.canonical(old_cells[g][k]) for k in both]), None)
                        expected.append((f["file_id"], n, "renamed" if source else "added"))
                        gone = [g for g in gone if g != source]
                    last = kinds.get(source, 0) if source else 0
                    if last and new[n] and last != new[n]:
                        expected.append((f["file_id"], n, "retyped"))
                    state[n] = new[n] or last
                expected += [(f["file_id"], g, "removed") for g in gone]
                kinds = state
            before = cells
    assert rows(drift.schema_changes(spark.read.parquet(f"{data}/image_file.parquet"), 7), "file_id", "field_name", "change") == sorted(expected, key=repr)


def test_consistent_table(spark, rows):
    files = spark.createDataFrame([(1, 1, T(1), "ImageNumber,a,File_Id,n\n1,2,x,\n"), (2, 1, T(2), "A,ImageNumber\n2.5,3\nnan,4\n")], SCHEMA)
    table = drift.consistent_table(files)
    assert table.dtypes == [("file_id_1", "bigint"), ("A", "double"), ("File_Id", "string"), ("ImageNumber", "bigint"), ("n", "string")]
    assert repr(rows(table)) == repr(sorted([(1, 2.0, "x", 1, None), (2, 2.5, None, 3, None), (2, float("nan"), None, 4, None)], key=repr))


def test_consistent_table_keeps_long_numbers(spark, rows):
    files = spark.createDataFrame([(1, 1, T(1), "a,b,c,d\n9223372036854775807,-9223372036854775809,1e400,000000000000000000000000007\n"), (2, 1, T(2), "a,b,c,d\n-9223372036854775808,1.5,2,8\n")], SCHEMA)
    table = drift.consistent_table(files)
    assert [t for _, t in table.dtypes] == ["bigint", "bigint", "string", "string", "bigint"]
    assert rows(table) == sorted([(1, (1 << 63) - 1, "-9223372036854775809", "1e400", 7), (2, -(1 << 63), "1.5", "2", 8)], key=repr)


def test_consistent_table_of_names_that_differ_in_case(spark, rows):
    files = spark.createDataFrame([(1, 1, T(1), "a,A,a_1,B\n1,x,2,3\n"), (2, 1, T(2), "b,A\n4,y\n"), (3, 1, T(3), "a\n5\n")], SCHEMA)
    table = drift.consistent_table(files)
    assert table.dtypes == [("file_id", "bigint"), ("A", "string"), ("B", "bigint"), ("a_1", "bigint"), ("a_2", "bigint")]
    assert rows(table) == sorted([(1, "x", 3, 2, 1), (2, "y", 4, None, None), (3, None, None, None, 5)], key=repr)


@pytest.mark.parametrize(("a", "b", "same"), [("7", "7.0", True), ("7", "07", True), ("nan", "NaN", True), ("", " ", True), ("x", "X", False), ("123456789012", "1.23456789012e11", True), ("9007199254740993", "9007199254740992", False), ("-0", "0", True), ("1e400", "2", False), ("-123456789012345", "-123456789012345.0", True), ("0000000000000005", "5", True), ("1e400", "10e399", True), ("1" * 400, "1" * 400 + ".0", True), ("1" * 5000, "1" * 4999 + "2", False), (".5", "0.50", True), ("1e" + "9" * 5000, "1e" + "0" * 9 + "9" * 5000, True), ("-nan", "nan", False)])
def test_canonical(a, b, same):
    assert (drift.canonical(a) == drift.canonical(b)) == same


def test_canonical_against_decimal():
    import random
    from decimal import Decimal

    random.seed(4)
    part = lambda n: "".join(random.choice("0012") for _ in range(random.randint(0, n)))
    cells = {f"{random.choice(['', '-'])}{part(3) or '0'}{random.choice(['', '.'])}{part(3)}{random.choice(['', 'e1', 'E-2', 'e+03', 'e0'])}" for _ in range(4000)}
    cells = [c for c in cells if drift.NUMBER.fullmatch(c)]
    by_form, by_value = {}, {}
    for c in cells:
        by_form.setdefault(drift.canonical(c), set()).add(c)
        by_value.setdefault(Decimal(c), set()).add(c)
    assert sorted(map(sorted, by_form.values())) == sorted(map(sorted, by_value.values()))


def test_very_long_numbers_and_cells(spark, rows):
    long, text = "7" * 5000, "x" * 300_000
    files = [(1, 1, T(1), f"ImageNumber,A,B\n1,{long},{text}\n"), (2, 1, T(2), f"ImageNumber,C,D\n1,{long}.0,{text}\n")]
    assert changes(spark, rows, files) == [(2, "C", "renamed"), (2, "C", "retyped"), (2, "D", "renamed")]
    table = drift.consistent_table(spark.createDataFrame(files, SCHEMA))
    assert rows(table, "A", "B", "C", "D") == sorted([(long, text, None, None), (None, None, f"{long}.0", text)], key=repr)


def test_blank_cells_are_those_of_white_space(spark):
    signs = [chr(c) for c in range(0x3100) if chr(c) not in ',"\r\n'] + ["\ufeff", "\U000e0020"]
    export = drift.Export([str(i) for i in range(len(signs))], [(c,) for c in signs], 1)
    assert [k == 0 for k in drift.kinds_of([export])[0].values()] == [not c.strip() for c in signs]
    assert [v is None for v in drift.cast_cells(signs, "text").to_pylist()] == [not c.strip() for c in signs]


def test_a_carried_kind_over_many_partitions(spark, rows):
    """A kind seen once is known many files, and partitions, later."""
    files = [(1, 1, T(1), "ImageNumber,A,B\n1,1,x\n")] + [(i, 1, T(i), "ImageNumber,A,B\n1,,\n") for i in range(2, 25)]
    files += [(25, 1, T(25), "ImageNumber,A,C\n1,x,1\n"), (26, 2, T(1), "ImageNumber,A\n1,1\n"), (27, 2, T(2), "ImageNumber,A\n1,\n")]
    for n in (1, 5, 27, 60):
        assert changes(spark, rows, files, n) == [(25, "A", "retyped"), (25, "B", "removed"), (25, "C", "added")]


def test_thousands_of_fields(spark, rows):
    names = [f"Texture_{i}" for i in range(6000)]
    body = lambda names, x: ",".join(["ImageNumber", *names]) + "\n" + "".join(f"{k}," + ",".join(f"{k}{i}{x}" for i in range(6000)) + "\n" for k in range(20))
    files = [(i, 1, T(i), body(names, "")) for i in range(1, 6)] + [(7, 1, T(7), body([f"New_{n}" for n in names], ".0"))]
    got = changes(spark, rows, files, 3)
    assert len(got) == 12_000 and {c for _, _, c in got} == {"renamed", "retyped"} and {f for f, _, _ in got} == {7}
