import csv
import math
import re

import pytest

from profloom.operators import compaction

FILES = "file_id bigint, table_number bigint, n_bytes bigint, body string"
HEAD = "ImageNumber,ObjectNumber,AreaShape_Area,Location_Center_X,c0"


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def brute(files):
    """(file_id, line_no) of repeated records, and all distinct records, read line by line."""
    seen, dropped = set(), []
    for file_id, table, _, body in sorted(files, key=lambda f: (f[0] is not None, f[0] or 0)):
        head = None
        for i, line in enumerate(re.split("\r\n|\r|\n", (body or "").removeprefix("﻿")), 1):
            if not line.strip():
                continue
            fields = [f.strip() for f in next(csv.reader([line]))]
            if head is None:
                head = fields
                continue
            if len(fields) < len(head):
                continue
            cells = [number(fields[head.index(c)]) if c in head else None for c in ("ImageNumber", "ObjectNumber", "c0")]
            key = (table, *("nan" if c is not None and math.isnan(c) else c for c in cells))
            if key in seen:
                dropped.append((file_id, i))
            seen.add(key)
    return sorted(dropped, key=repr), seen


def frame(spark, files):
    return spark.createDataFrame(files, FILES)


ODD = [
    (1, 7, 10, f"{HEAD}\n1,1,5,6,0.5\n1,1,9,9,5e-1\n"),
    (2, 7, 10, '﻿"c0","ObjectNumber","ImageNumber"\r\n"+0.5","1","1"\r\n,2,1\r\n"",2.0,1\r\nnan,3,1\r\nNaN,3,1\r\n'),
    (3, 8, 10, f"\n\n{HEAD}\n1,1,5,6,0.5\n1,1,5,6\n\n1,1,5,6,.5"),
    (4, 7, None, None), (5, 7, 0, ""), (6, 7, 3, "﻿"), (7, None, 5, f"{HEAD}\n1,1,1,1,1\n1,1,1,1,1"),
    (8, 7, 5, f'{HEAD}\n1,"1,5",1,1,1\n1,2,1,1,-0\n1,2,1,1,0\nx,2,1,1,y\n,2,1,1,'), (None, 7, 5, f"{HEAD}\n1,1,5,6,0.5"),
]


def test_odd_files(spark, rows):
    records = compaction.small_file_records(frame(spark, ODD), target_bytes=10)
    dropped, seen = brute(ODD)
    assert rows(compaction.dropped_records(records)) == dropped
    assert records.where("NOT copy").count() == len(seen)


@pytest.mark.parametrize(("batch", "most"), [(1, 0), (500_000, 4 << 20)])
def test_whole_table(spark, rows, data, monkeypatch, batch, most):
    monkeypatch.setattr(compaction, "BATCH_RECORDS", batch)
    monkeypatch.setattr(compaction, "BROADCAST_BYTES", most)
    files = spark.read.parquet(f"{data}/nuclei_file.parquet").select("file_id", "table_number", "n_bytes", "body")
    dropped, _ = brute([tuple(r) for r in files.collect()])
    assert rows(compaction.dropped_records(compaction.small_file_records(files))) == dropped


def test_empty_table(spark, rows):
    assert rows(compaction.dropped_records(compaction.small_file_records(frame(spark, [])))) == []


@pytest.mark.parametrize("most", [0, 4 << 20])
def test_rows_of_one_file_id(spark, rows, monkeypatch, most):
    monkeypatch.setattr(compaction, "BROADCAST_BYTES", most)
    records = compaction.small_file_records(frame(spark, [(1, 1, 9, f"{HEAD}\n1,1,1,1,1")] * 3))
    assert records.count() == 3 and rows(compaction.dropped_records(records)) == [(1, 2), (1, 2)]


def test_one_record_a_third_of_all(spark):
    files = [(i, 1, 60, f"{HEAD}\n1,1,1,1,1\n{i},2,1,1,1\n{i},3,1,1,1") for i in range(300)]
    records = compaction.small_file_records(frame(spark, files))
    assert compaction.dropped_records(records).count() == 299


def test_longest_first():
    assert compaction.longest_first([5, 9, 1, 4], 2) == [1, 0, 0, 1]
    sizes = [(i * 37) % 101 for i in range(500)]
    load = [0] * 7
    for s, g in zip(sizes, compaction.longest_first(sizes, 7)):
        load[g] += s
    assert max(load) - min(load) <= max(sizes)
    assert compaction.longest_first([], 3) == []


def test_lanes_keep_groups_apart(spark):
    files = spark.createDataFrame([(i, 10) for i in range(100)], "file_id bigint, n_bytes bigint")
    groups, n, n_groups = compaction.assign_groups(files, target_bytes=100, lane_files=30)
    assert n == 100 and n_groups == 12
    groups = groups.toPandas()
    assert sorted(groups["file_id"]) == list(range(100)) and groups["group_id"].nunique() >= 10


def test_publish(spark, rows, tmp_path):
    records = compaction.small_file_records(frame(spark, ODD), target_bytes=10)
    _, seen = brute(ODD)
    for _ in range(2):  # publishing again replaces the manifest
        manifest = compaction.publish(records, str(tmp_path / "out"), 3)
        assert manifest["n_rows"] == len(seen)
        back = compaction.read_published(spark, str(tmp_path / "out"))
        key = ("table_number", "image_number", "object_number", "c0")
        assert repr(rows(back, *key)) == repr(rows(records.where("NOT copy"), *key))
    empty = compaction.small_file_records(frame(spark, []))
    assert compaction.publish(empty, str(tmp_path / "none"), 2)["files"] == []
    assert compaction.read_published(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("partitions", "target", "n_files"), [(8, 512 << 20, 1), (200, 512 << 20, 1), (8, 4000, 6), (64, 4000, 6)])
def test_output_follows_the_size_alone(spark, data, tmp_path, partitions, target, n_files):
    files = spark.read.parquet(f"{data}/nuclei_file.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        manifest = compaction.publish(compaction.small_file_records(files, target), str(tmp_path / "out"), partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = files.agg({"n_bytes": "sum"}).first()[0]
    assert len(manifest["files"]) == -(-total // target)
    rows = [f["n_rows"] for f in manifest["files"]]
    assert min(rows) >= 0.6 * sum(rows) / len(rows)
    assert n_files == 1 or len(rows) >= n_files
