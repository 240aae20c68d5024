import json
import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.errors import DatatypeException
from profloom.functions import ids, naming, types
from profloom.operators import pages

IDENTIFYING = ["ImageNumber", "ObjectNumber", "Parent_Cells", "Parent_Nuclei"]
OBJECTS = ["image", "cells", "nuclei", "cytoplasm"]


@pytest.mark.parametrize("stem", ["Cytoplasm", "Cells", "Nuclei", "Image"])
def test_prefixes_tell_where_columns_come_from(stem):
    """Whatever the group's file is called: features get its name once, keys become metadata, and names stay apart."""
    names = [*IDENTIFYING, "AreaShape_Area", f"{stem}_Intensity", "z"]
    for file in (f"{stem}.csv", f"Per_{stem}.sqlite", f"my{stem.lower()}s.npz"):
        got = naming.prefixed_names(names, file, IDENTIFYING, ["image"], OBJECTS)
        assert len(set(got)) == len(names) and all(n.startswith("Metadata_") for n in got[: len(IDENTIFYING)])
        assert got[len(IDENTIFYING) :] == [f"{stem}_AreaShape_Area", f"{stem}_Intensity", f"{stem}_z"]
        assert got[:2] == ["Metadata_ImageNumber", "Metadata_ObjectNumber"] and got[2:4] == [f"Metadata_{stem}_Parent_Cells", f"Metadata_{stem}_Parent_Nuclei"]


def test_prefix_branches():
    name = lambda n, *known: naming.prefixed_name(n, "Cells", known, ["image"])
    assert name("X") == "Cells_X" and name("Cells_X") == "Cells_X"
    assert name("Cells_Id", "Cells_Id") == "Metadata_Cells_Id"
    assert name("Metadata_Well", "Metadata_Well") == "Metadata_Well"
    assert name("TableNumber", "TableNumber") == "Metadata_TableNumber" and name("TableNumber") == "Cells_TableNumber"
    assert naming.prefixed_names(["a"], "other.csv", ["a"], ["image"], ["cells"]) == ["a"]


def test_column_order():
    names = ["Zeta", "Nuclei_B", "Nuclei_A", "Cells_A", "Cytoplasm_A", "Image_A", "My_Metadata_x", "Object_Number", "ObjectNumber", "Metadata_ImageNumber", "ImageNumber", "Metadata_TableNumber", "TableNumber"]
    assert naming.ordered_columns(names) == ["TableNumber", "Metadata_TableNumber", "ImageNumber", "Metadata_ImageNumber", "ObjectNumber", "Object_Number", "My_Metadata_x", "Image_A", "Cytoplasm_A", "Cells_A", "Nuclei_A", "Nuclei_B", "Zeta"]


def test_names_made_distinct():
    assert naming.distinct_names(["b", "b", "B", "b_1"]) == ["b", "b_1", "B_2", "b_1_1"]
    assert naming.last_occurrences(["a", "b", "a"]) == [1, 2]


def test_natural_sort_against_padded_digits(spark):
    """Numbers within texts count by value: as if all had as many digits."""
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice(["plate", "Plate", "_", "-", str(rng.randint(0, 12)), str(rng.randint(90, 1100))]) for _ in range(rng.randint(1, 5))) for _ in range(400)})
    padded = lambda t: re.sub("[0-9]+", lambda m: m.group().zfill(30), t)
    by_runs = lambda t: [(0, x) if x[0].isdigit() else (1, x) for x in re.findall("[0-9]+|[^0-9]+", padded(t))]
    assert naming.natural_sort(texts[::-1]) == sorted(texts, key=by_runs) and naming.natural_sort([]) == []
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["t"] for r in df.orderBy(naming.natural_column(F.col("t")), "t").collect()] == sorted(texts, key=lambda t: ("".join(str(len(x.lstrip("0"))).zfill(10) + x.lstrip("0") if x[0].isdigit() else x for x in re.findall("[0-9]+|[^0-9]+", t)), t))


def walked_pages(keys, size):
    """The ranges of pages, row by row: a page is full once it has ``size`` rows and the key changes."""
    out, n = [], 0
    for i, k in enumerate(keys):
        if i and k == keys[i - 1]:
            n += 1
        elif out and n < size:
            n += 1
        else:
            out.append([k, k])
            n = 1
        out[-1][1] = k
    return [tuple(x) for x in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=120), st.integers(1, 15))
def test_page_ranges_against_a_walk(keys, size):
    keys.sort()
    assert pages.page_ranges(keys, size) == walked_pages(keys, size)
    halves = [k / 2 for k in keys]
    assert pages.page_ranges(halves, size) == walked_pages(halves, size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 20))
def test_jumps_of_a_partition(counts, size):
    """Entering a partition with any room left, its pages end as a walk through it ends."""
    before, begun, left = pages.jumps(np.array(counts), size)
    for room in range(size + 1):
        walked = list(pages.fold_pages(enumerate(counts), size, 7, room))
        page, used = walked[-1][1], 0
        first = next((i for i, (_, _, begins) in enumerate(walked) if begins), None)
        at = int(np.searchsorted(before, room))
        if first is None:
            assert at >= len(before)
            continue
        last = max(i for i, (_, _, begins) in enumerate(walked) if begins)
        used = sum(counts[last:])
        assert at == first and 7 + begun[at] == page and left[at] == max(0, size - used)


@pytest.mark.parametrize(("size", "partitions"), [(1, 4), (3, 1), (7, 9), (50, 3), (100_000, 5)])
def test_pages_over_partitions(spark, rows, size, partitions):
    rng = random.Random(size)
    keys = [rng.choice([5, rng.randint(0, 300)]) for _ in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(k,) for k in [*keys, None, None]], "k bigint").repartition(6)
        assert [r[1:] for r in sorted(rows(pages.pages(df, "k", size)))] == walked_pages(sorted(keys), size)
        assert sorted(r["k"] for r in pages.ranged(df, "k", size).where("k BETWEEN lo AND hi").collect()) == sorted(keys)
        texts = df.select(F.lpad(F.col("k").cast("string"), 5, "0").alias("k"))
        assert pages.assign_pages(texts, "k", size).agg(F.countDistinct("page")).first()[0] == len(walked_pages(sorted(keys), size))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert pages.pages(df.limit(0), "k", size).count() == 0


def test_page_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        pages.page_ranges([1], 0)
    with pytest.raises(ValueError):
        pages.key_pages(spark.range(3), "id", 0)


def test_type_map():
    m = types.harmonized
    assert (m(T.FloatType()), m(T.ShortType()), m(T.StringType()), m(T.NullType()), m(T.BinaryType())) == (T.DoubleType(), T.LongType(), T.StringType(), T.NullType(), T.BinaryType())
    casts = {"float": "float32", "integer": "int32"}
    assert m(T.ArrayType(T.DoubleType()), casts) == T.ArrayType(T.FloatType()) and m(T.LongType(), casts) == T.IntegerType()
    s = T.StructType([T.StructField("a", T.FloatType()), T.StructField("b", T.ArrayType(T.IntegerType()))])
    assert m(s) == T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.ArrayType(T.LongType()))])
    with pytest.raises(DatatypeException):
        types.named_type("complex")


def test_common_schema():
    ddl = T.StructType.fromDDL
    schema, dropped = types.common_schema([ddl("a int, b double, c string, d void"), ddl("d string, c bigint, a double"), ddl("a bigint, c string, d string, e int")])
    assert schema == ddl("a double, c string, d string") and dropped == ["b", "e"]


def test_conform_makes_unreadable_texts_null(spark, rows):
    df = spark.createDataFrame([("1", 2), ("x", 3)], "a string, b int")
    assert rows(types.conform(df, T.StructType.fromDDL("a bigint, b double"))) == sorted([(1, 2.0), (None, 3.0)], key=repr)


def test_numeric_split():
    schema = T.StructType.fromDDL("a double, b int, c decimal(9,2), d string, e boolean, f timestamp")
    assert types.split_numeric(schema) == (["a", "b", "c"], ["d", "e", "f"])


def test_void_fields_are_stripped(spark, rows):
    df = spark.sql("SELECT named_struct('a', 1, 'n', NULL, 's', named_struct('x', NULL, 'y', 'q')) AS v, array(named_struct('k', 2, 'n', NULL)) AS l, NULL AS z")
    v, lst, z = (types.strip_void(F.col(c), df.schema[c].dataType) for c in ("v", "l", "z"))
    assert z is None
    out = df.select(v.alias("v"), lst.alias("l"))
    assert out.schema.simpleString() == "struct<v:struct<a:int,s:struct<y:string>>,l:array<struct<k:int>>>"
    assert out.first().asDict(True) == {"v": {"a": 1, "s": {"y": "q"}}, "l": [{"k": 2}]}


def test_ids_equal_those_of_the_uuid_module(spark):
    texts = ["", "a", 'q"\\\n\t\x01é漢😀\x7f', "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", ids.stable_id(F.col("t")).alias("i"), ids.json_text(F.col("t")).alias("j")).collect():
        assert r["i"] == f"obj-{uuid.uuid5(uuid.NAMESPACE_URL, r['t'])}" == ids.object_id(r["t"])
        assert r["j"] == json.dumps(r["t"])
    assert ids.object_id() != ids.object_id() and ids.object_id("a", prefix="img").startswith("img-")


def test_object_ids_have_the_json_of_their_keys(spark):
    df = spark.createDataFrame([(1, 2, "A'é", 1.5, "3", "7", "2", "8"), (1, None, None, None, "bad", "7", "2", "8")],
        "Metadata_ImageNumber bigint, Metadata_ObjectNumber int, Metadata_Well string, Cells_Number_Object_Number double, Nuclei_AreaShape_BoundingBoxMinimum_X string, Nuclei_AreaShape_BoundingBoxMaximum_X string, Nuclei_AreaShape_BoundingBoxMinimum_Y string, Nuclei_AreaShape_BoundingBoxMaximum_Y string")
    out = ids.stamp_object_ids(df)
    assert out.columns[:5] == ["Metadata_ImageNumber", "Metadata_ObjectNumber", "Metadata_Well", "Cells_Number_Object_Number", "Metadata_SourceBBoxXMin"]
    assert out.columns.index("Metadata_ObjectID") == 7
    keys = [{"Metadata_ImageNumber": 1, "Metadata_ObjectNumber": 2, "Metadata_Well": "A'é", "Cells_Number_Object_Number": 1.5}, {"Metadata_ImageNumber": 1}]
    boxes = [{"x_min": 3, "x_max": 7, "y_min": 2, "y_max": 8}, {}]
    expected = [ids.object_id(json.dumps({"keys": k, "bbox": b}, sort_keys=True)) for k, b in zip(keys, boxes)]
    assert [r["Metadata_ObjectID"] for r in out.orderBy("Metadata_ObjectNumber", ascending=False).collect()] == expected
    kept = ids.stamp_object_ids(df.withColumn("Metadata_ObjectID", F.lit("mine")))
    assert {r["Metadata_ObjectID"] for r in kept.collect()} == {"mine"}


def test_box_resolution():
    four = lambda p: [f"{p}AreaShape_BoundingBox{m}_{a}" for m in ("Minimum", "Maximum") for a in "XY"]
    assert ids.resolve_box([*four("Cells_"), *four("Nuclei_")]).x_min == "Nuclei_AreaShape_BoundingBoxMinimum_X"
    assert ids.resolve_box(four("Cells_") + list(ids.BOX_COLUMNS.values())).y_max == "Metadata_SourceBBoxYMax"
    given = {"x_min": "a", "x_max": "b", "y_min": "c", "y_max": "d"}
    assert ids.resolve_box(["a", "b", "c", "d"], given).x_max == "b"
    assert ids.resolve_box(["a", "b", "c", *four("")], given).x_max == "AreaShape_BoundingBoxMaximum_X"
    assert ids.resolve_box(["My_Minimum_X", "My_Minimum_Y", "O_Maximum_X", "O_Maximum_Y"]).x_max == "O_Maximum_X"
    assert ids.resolve_box(["x"]) is None


def test_box_validity(spark, rows):
    values = [("3", "7", "2", "8"), ("bad", "8", "2", "8"), ("7", "3", "2", "2"), ("2", "2", "8", "8"), ("1", "1.5", "0", "9"), (None, "1", "1", "2"), ("nan", "1", "1", "2")]
    df = spark.createDataFrame(values, "x0 string, x1 string, y0 string, y1 string")
    box = ids.Box("x0", "x1", "y0", "y1")
    assert [ids.box_is_valid(ids.box_bounds(box, w)) is not None for w in (True, False)]
    assert rows(df.where(ids.box_is_valid(ids.box_bounds(box, True))), "x0") == [("3",)]
    assert rows(df.where(ids.box_is_valid(ids.box_bounds(box, False))), "x0") == [("1",), ("3",)]


def test_file_values_and_image_columns(spark, rows):
    df = spark.createDataFrame([("file:/a//b/./c.tif", "x", None), ("a/b.TIFF", None, None), (None, "y.txt", None)], "f string, g string, h string")
    assert rows(df.select(ids.file_value(F.col("f")))) == sorted([("/a/b/c.tif",), ("a/b.TIFF",), (None,)], key=repr)
    assert ids.image_columns(df) == ["f"] and ids.image_columns(df.select("g", "h")) == [] and ids.image_columns(spark.range(2)) == []


def test_image_columns_do_not_depend_on_the_order(spark):
    df = spark.createDataFrame([("n/a", "x", None)] * 150 + [("b.Tiff", "x.tiff.txt", None)], "f string, g string, h string")
    assert ids.image_columns(df) == ["f"] == ids.image_columns(df.orderBy("f")) and ids.image_columns(df.limit(0)) == []


def test_drop_null_keeps_nan(spark, rows):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (None, 1.0)], "a int, b double")
    assert repr(rows(pages.drop_null_rows(df))) == "[(1, nan)]"
    assert [r["a"] for r in pages.sorted_by(df, "a").collect()] == [1, 2, None]


def test_melting_compiles(spark, rows, capfd):
    """What Spark generates for rows of several image columns compiles, and it isn't interpreted row by row."""
    from profloom.warehouse.images import melt_images

    df = spark.createDataFrame([(i, f"file:/a//{i}.tif", None if i % 3 else f"b/./{i}.tif", None) for i in range(50)], "i bigint, f string, `g.x` string, h string")
    df = df.groupBy("i").agg(*(F.max(F.col(f"`{c}`")).alias(c) for c in ("f", "g.x", "h")))
    got = rows(melt_images(df, ["f", "g.x", "h"]))
    assert len(got) == 67 and (3, "g.x", "b/3.tif") in got
    assert "Failed to compile" not in capfd.readouterr().err


def test_floats_in_identifiers(spark):
    values = [0.0, -0.0, 1.0, -7.0, 1.5, 1e14, 1e15, 1e16, 1e22, 123456789012345.0, 1e-5, 1e-4, 0.1, float("inf"), 2.0**53, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(ids.json_value(df, "x")).collect()]
    assert got == [None if v is None or v != v else repr(v) for v in values]
