import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.api import Catalog, DatatypeException, NoInputDataException, ProfileException, SchemaException, convert, describe_warehouse, list_tables, read_table
from profloom.operators.pages import page_ranges, sorted_by
from profloom.plans import dialect, harmonize
from profloom.plans.joins import JoinSpec, join_compartments
from profloom.plans.options import check_options
from profloom.presets import PRESETS, Preset, preset
from profloom.sources.images import encode_tiff, image_array
from profloom.streaming.ingest import ingest, latest_rows


def test_presets():
    assert len(PRESETS) == 7 and all(p.chunk_size == 1000 for p in PRESETS.values())
    assert preset("cellprofiler_csv").resolve(chunk_size=5, metadata=None).chunk_size == 5
    assert preset(None) == Preset()
    with pytest.raises(DatatypeException):
        preset("none")


GOOD = {"backend": "parquet", "datatype": "parquet", "concat": True, "join": True, "drop_null": False}


@pytest.mark.parametrize("bad", [
    {"backend": "x"}, {"datatype": "x"}, {"mask_dir": "m"}, {"image_dir": "i"}, {"image_dir": "i", "backend": "iceberg", "join": False}, {"backend": "iceberg", "concat": False},
    {"backend": "iceberg", "join": False}, {"backend": "iceberg", "drop_null": True}, {"backend": "iceberg", "datatype": "anndata_h5ad"}, {"datatype": "anndata_h5ad", "join": False},
])
def test_bad_options(bad):
    check_options(**GOOD)
    with pytest.raises(ProfileException):
        check_options(**GOOD | bad)


def exports(root, images=3, objects=4, start=1):
    """CSV exports: one image without objects, one parent without match, one NaN and one null."""
    folder = root / f"plate{start}"
    folder.mkdir(parents=True)
    im, cy, ce, nu = [], [], [], []
    for i in range(start, start + images):
        im.append(f"{i},W{i},P{start},img_{i}.tif")
        for o in range(1, objects + 1 if i < start + images - 1 else 1):
            cy.append(f"{i},{o},{o},{99 if (i, o) == (start, 1) else o},{o},{o}.5,{o},{o + 3},0,4")
            ce.append(f"{i},{o},{'nan' if o == 2 else o}")
            nu.append(f"{i},{o},{'' if o == 3 else o}")
    for name, head, lines in (("Image", "ImageNumber,Metadata_Well,Metadata_Plate,FileName_DNA", im), ("Cells", "ImageNumber,ObjectNumber,X", ce), ("Nuclei", "ImageNumber,ObjectNumber,Y", nu),
        ("Cytoplasm", "ImageNumber,ObjectNumber,Parent_Cells,Parent_Nuclei,Number_Object_Number,Z,AreaShape_BoundingBoxMinimum_X,AreaShape_BoundingBoxMaximum_X,AreaShape_BoundingBoxMinimum_Y,AreaShape_BoundingBoxMaximum_Y", cy)):
        (folder / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")
    (folder / "Experiment.csv").write_text("Key,Value\na,b\n")


def test_convert_joined(tmp_path, spark):
    exports(tmp_path / "in")
    path = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    df = spark.read.parquet(path)
    assert df.count() == 7 and df.columns[:3] == ["Metadata_ImageNumber", "Metadata_Cytoplasm_Parent_Cells", "Metadata_Cytoplasm_Parent_Nuclei"]
    assert "Image_FileName_DNA" in df.columns and "Metadata_ObjectNumber_2" in df.columns
    assert df.where(F.isnan("Cells_X")).count() == 2 and df.where("Nuclei_Y IS NULL").count() == 2
    with pytest.raises(FileExistsError):
        convert(spark, str(tmp_path / "in"), path)
    kept = convert(spark, str(tmp_path / "in"), str(tmp_path / "full.parquet"), drop_null=True, single_file=True, data_type_cast_map={"float": "float32", "integer": "int32"})
    full = spark.read.parquet(kept)
    assert os.path.isfile(kept) and full.count() == 5 and dict(full.dtypes)["Cells_X"] == "float" and dict(full.dtypes)["Metadata_ImageNumber"] == "int"


def test_convert_pages(tmp_path, spark):
    exports(tmp_path / "in", images=4)
    paths = convert(spark, str(tmp_path / "in"), str(tmp_path / "out.parquet"), concat=False, chunk_size=3)
    keys = sorted(r[0] for r in spark.read.parquet(*paths).select("Cytoplasm_Number_Object_Number").collect())
    assert [os.path.basename(p) for p in paths] == [f"out-{a}-{b}.parquet" for a, b in page_ranges(keys, 3)]


def test_convert_groups(tmp_path, spark):
    exports(tmp_path / "in")
    exports(tmp_path / "in", start=10)
    out = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), join=False)
    assert set(out) == {"Image.csv", "Cells.csv", "Nuclei.csv", "Cytoplasm.csv"}
    cells = spark.read.parquet(out["Cells.csv"][0]["table"][0])
    assert cells.count() == 16 and cells.columns == ["Cells_TableNumber", "Metadata_ImageNumber", "Metadata_ObjectNumber", "Cells_X"] and cells.select("Cells_TableNumber").distinct().count() == 2
    single = convert(spark, str(tmp_path / "in"), str(tmp_path / "each"), join=False, concat=False, chunk_size=2)
    assert len(single["Cells.csv"]) == 2 and len(single["Cells.csv"][0]["table"]) == 4 and single["Cells.csv"][0]["page_key"] == "ObjectNumber" or single["Cells.csv"][0]["table"]
    with pytest.raises(ProfileException, match="page key"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "x"), join=False, page_keys={"cells": "ObjectNumber"})


def test_convert_user_sql(tmp_path, spark):
    exports(tmp_path / "in")
    sql = "SELECT image.*, cells.* EXCLUDE (Metadata_ImageNumber) FROM read_parquet('cells.parquet') AS cells INNER JOIN read_parquet('image.parquet') AS image USING (Metadata_ImageNumber)"
    df = spark.read.parquet(convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), joins=sql))
    assert df.count() == 8
    with pytest.raises(ProfileException, match="join"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "b"), page_keys={})
    with pytest.raises(NoInputDataException):
        convert(spark, str(tmp_path / "nothing"), str(tmp_path / "c"))


def test_convert_sqlite(tmp_path, spark):
    for n in (1, 2):
        with sqlite3.connect(tmp_path / f"p{n}.sqlite") as db:
            db.execute("CREATE TABLE Per_Image (ImageNumber INTEGER, Image_Metadata_Well TEXT, Image_Metadata_Plate TEXT, Image_FileName_DNA VARCHAR(9))")
            db.execute("CREATE TABLE Per_Cytoplasm (ImageNumber INTEGER, Cytoplasm_Number_Object_Number INTEGER, Cytoplasm_Parent_Cells INTEGER, Cytoplasm_Parent_Nuclei INTEGER, Cytoplasm_Z DOUBLE)")
            for t in ("Cells", "Nuclei"):
                db.execute(f"CREATE TABLE Per_{t} (ImageNumber INTEGER, {t}_Number_Object_Number INTEGER, {t}_X DOUBLE)")
                db.executemany(f"INSERT INTO Per_{t} VALUES (?, ?, ?)", [(10 * n, o, "nan" if o == 1 else o) for o in (1, 2)])
            db.execute("INSERT INTO Per_Image VALUES (?, 'W', 'P', 'f.tif')", (10 * n,))
            db.executemany("INSERT INTO Per_Cytoplasm VALUES (?, ?, ?, ?, 1)", [(10 * n, o, o, o) for o in (1, 2, 3)])
    df = spark.read.parquet(convert(spark, str(tmp_path), str(tmp_path / "out"), preset_name="cellprofiler_sqlite"))
    assert df.count() == 4 and df.where("Cells_X IS NULL").count() == 2 and df.select("Image_TableNumber" if "Image_TableNumber" in df.columns else "Cells_TableNumber").distinct().count() == 2


def test_convert_npz(tmp_path, spark):
    np.savez(tmp_path / "a.npz", features=np.ones((3, 2), np.float32), locations=np.zeros((3, 2)), metadata=np.array({"Metadata_Site": 1}, dtype=object))
    out = convert(spark, str(tmp_path), str(tmp_path / "out"), preset_name="deepprofiler", source_datatype="npz", join=False)
    df = spark.read.parquet(next(iter(out.values()))[0]["table"][0])
    assert df.count() == 3 and df.columns[-2:] == ["DP_1", "DP_2"]


def test_schemas_must_agree_if_asked(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1.5,)], "x double")
    assert harmonize.union_all([a, b]).dtypes == [("x", "double")]
    with pytest.raises(SchemaException):
        harmonize.union_all([a, b], infer=False)


def test_join_spec(spark, rows):
    image = spark.createDataFrame([(1, "f"), (2, "g")], "k bigint, Image_FileName_A string")
    base = spark.createDataFrame([(1, 1, 1), (1, 2, 9), (3, 3, 3), (None, 4, 4)], "k bigint, o bigint, p bigint")
    cells = spark.createDataFrame([(1, 1, "c"), (3, 3, "d"), (None, 4, "e")], "k bigint, o bigint, v string")
    tables = {"image": image, "cytoplasm": base, "cells": cells}
    spec = JoinSpec(("k",), {"cells": ("o", "p")}, ("k",), without=("K",))
    assert rows(join_compartments(tables, spec)) == sorted([(1, "f", 1, 1, 1, "c"), (None, None, 3, 3, 3, "d")], key=repr)
    left = JoinSpec(("k",), {"cells": ("o", "p")}, ("k",), without=("k",), keep_unmatched=True)
    assert join_compartments(tables, left).count() == 4 and join_compartments(tables, left).columns == ["k", "Image_FileName_A", "o", "p", "o_1", "v"]
    with pytest.raises(SchemaException, match="no table"):
        join_compartments({"image": image, "cytoplasm": base}, spec)
    with pytest.raises(SchemaException, match="matches"):
        join_compartments(tables | {"image": image.withColumnRenamed("Image_FileName_A", "x")}, spec)


def test_dialect():
    views, columns = {"cells": "v_cells", "image": "v_image"}, {"v_cells": ["a", "Pre_Image_X"], "v_image": ["Image_X", "b"]}
    sql = """SELECT c.* EXCLUDE (a), COLUMNS('Image_.*'), "odd name", 'EXCLUDE' -- EXCLUDE
    FROM read_parquet(['x/cells.parquet']) AS c JOIN read_parquet('image.parquet') i ON c.a = i.b"""
    out = dialect.to_spark_sql(sql, views, columns)
    assert "EXCEPT (a)" in out and "'EXCLUDE'" in out and "`odd name`" in out and "c.`Pre_Image_X`, i.`Image_X`" in out and "FROM v_cells AS c JOIN v_image i" in out
    with pytest.raises(SchemaException):
        dialect.to_spark_sql("SELECT * FROM read_parquet('none.parquet')", views, columns)
    with pytest.raises(SchemaException):
        dialect.to_spark_sql("SELECT COLUMNS('zzz') FROM read_parquet('cells.parquet')", views, columns)


def test_catalog(tmp_path, spark, rows):
    c = Catalog(str(tmp_path / "w"))
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    c.create_table("t", df.schema)
    assert c.read(spark, "t").count() == 0 and c.table_exists("t")
    c.append("t", df)
    c.append("profiles.t", df)
    c.append("other.u", df)
    assert c.read(spark, "u").count() == 1 and rows(c.read(spark, "t")) == [(1, "a")] * 2 and len(c.snapshots("t")) == 2
    c.append("third.u", df)
    for bad in ("u", "none", "a.b"):
        with pytest.raises(NoInputDataException):
            c.resolve(bad)
    with pytest.raises(SchemaException):
        c.append("t", df.select("x"))
    with pytest.raises(ProfileException):
        c.create_table("t", df.schema)
    c.create_view("v", "sql", sql="SELECT sum(x) AS s FROM {profiles.t}")
    assert rows(read_table(spark, c.root, "v")) == [(2,)] and c.view_exists("v")
    with pytest.raises(ProfileException):
        c.create_view("w", "odd")
    with pytest.raises(NoInputDataException):
        read_table(spark, c.root)
    assert list_tables(c.root) == ["other.u", "profiles.t", "profiles.v", "third.u"] and c.namespaces() == ["profiles", "other", "third"]
    about = {r["table"]: r for r in describe_warehouse(spark, c.root).collect()}
    assert about["profiles.t"]["rows"] == 2 and about["profiles.t"]["files"] >= 2 and about["profiles.t"]["snapshot"] == c.snapshots("t")[-1]
    assert tuple(about["profiles.v"])[1:] == ("view", None, 0, None)
    for f in (lambda: c.drop_table("t"), lambda: c.rename_table("t", "s"), lambda: c.update_properties("n")):
        with pytest.raises(NotImplementedError):
            f()


def test_plain_parquet_access(tmp_path, spark):
    path = str(tmp_path / "d.parquet")
    spark.range(3).write.parquet(path)
    assert list_tables(path) == ["d"] and read_table(spark, path).count() == read_table(spark, path, "d").count() == 3
    for f in (lambda: read_table(spark, path, "e"), lambda: read_table(spark, str(tmp_path / "no")), lambda: list_tables(str(tmp_path / "no"))):
        with pytest.raises(NoInputDataException):
            f()


def test_warehouse_with_images(tmp_path, spark):
    exports(tmp_path / "in")
    for folder, value in (("images", 1), ("masks", 2)):
        (tmp_path / folder).mkdir()
        for i in (1, 2, 3):
            name = f"img_{i}.tif" if folder == "images" else f"img_{i}_mask.tif"
            (tmp_path / folder / name).write_bytes(encode_tiff(np.full((10, 10), value * 10 + i, np.uint16)))
    options = {"dest_backend": "iceberg", "image_dir": str(tmp_path / "images"), "mask_dir": str(tmp_path / "masks"), "segmentation_file_regex": {r"_mask\.tif$": r"^img"}, "include_source_images": True}
    root = convert(spark, str(tmp_path / "in"), str(tmp_path / "w"), **options)
    assert list_tables(root) == ["images.image_crops", "images.source_images", "profiles.joined_profiles", "profiles.profile_with_images"]
    crops = read_table(spark, root, "image_crops").collect()
    assert len(crops) == 7 and {c["label_source_kind"] for c in crops} == {"mask"}
    one = crops[0]
    assert image_array(one["ome_arrow_image"]).shape == (4, 3) and one["Metadata_ImageNumber"] in ("1", "2")
    assert image_array(one["ome_arrow_label"])[0, 0] == 20 + int(one["Metadata_ImageNumber"])
    assert read_table(spark, root, "source_images").count() == 2
    view = read_table(spark, root, "profile_with_images")
    assert view.count() == 7 and view.where("ome_arrow_image IS NULL").count() == 0
    again = convert(spark, str(tmp_path / "in"), str(tmp_path / "w2"), **options)
    ids = lambda r: sorted(x[0] for x in read_table(spark, r, "joined_profiles").select("Metadata_ObjectID").collect())
    assert ids(root) == ids(again) and len(set(ids(root))) == 7


def test_warehouse_is_all_or_nothing(tmp_path, spark):
    exports(tmp_path / "in")
    (tmp_path / "images" / "a").mkdir(parents=True)
    (tmp_path / "images" / "b").mkdir()
    for d in "ab":
        (tmp_path / "images" / d / "img_1.tif").write_bytes(encode_tiff(np.zeros((9, 9), np.uint8)))
    with pytest.raises(Exception, match="several images"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "w"), dest_backend="iceberg", image_dir=str(tmp_path / "images"))
    assert not (tmp_path / "w").exists()
    with pytest.raises(ProfileException, match="folder"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "w"), dest_backend="iceberg", image_dir=str(tmp_path / "none"))


def test_stream_ingest_is_idempotent(tmp_path, spark, rows):
    catalog = Catalog(str(tmp_path / "w"))
    go = lambda n: ingest(spark, str(tmp_path / "in"), "k bigint, v string", catalog, "t", str(tmp_path / f"c{n}"), ["k"]).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k bigint, v string").write.parquet(str(tmp_path / "in"))
    go(1)
    spark.createDataFrame([(2, "b"), (3, "c"), (None, "n")], "k bigint, v string").write.mode("append").parquet(str(tmp_path / "in"))
    go(1)
    go(2)  # all files once more, as after a lost checkpoint
    assert rows(catalog.read(spark, "t")) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n")], key=repr)
    assert catalog.state()["tables"]["profiles.t"]["snapshots"]


def test_latest_rows(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c")], "k int, t int, v string")
    assert rows(latest_rows(df, ["k"], "t")) == [(1, 7, "b"), (2, None, "c")]


def test_warehouse_functions(tmp_path, spark):
    from profloom import api

    exports(tmp_path / "in")
    root = api.write_iceberg_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "w"))
    assert api.list_iceberg_tables(root, include_views=False) == ["profiles.joined_profiles"]
    df = api.read_iceberg_table(spark, root, "joined_profiles")
    assert df.count() == 7 and "Metadata_ObjectID" in df.columns
    assert api.describe_iceberg_warehouse(spark, root).first()["rows"] == 7
    with pytest.raises(NoInputDataException):
        api.list_iceberg_tables(str(tmp_path / "in"))


def test_wide_tables_and_odd_names(tmp_path, spark):
    """Names with dots, blanks and backticks, and more columns than code is generated for."""
    folder = tmp_path / "in"
    folder.mkdir()
    odd = ["a.b", "c d", "e`f", "g-h"]
    names = odd + [f"F_{i}" for i in range(300)]
    for t in ("Cells", "Nuclei", "Cytoplasm"):
        keys = ["ImageNumber", "ObjectNumber"] + (["Parent_Cells", "Parent_Nuclei", "Number_Object_Number"] if t == "Cytoplasm" else [])
        (folder / f"{t}.csv").write_text(",".join(keys + names) + "\n" + ",".join(["1"] * len(keys) + ["0.5"] * len(names)) + "\n")
    (folder / "Image.csv").write_text("ImageNumber,FileName_A\n1,x.tif\n")
    df = spark.read.parquet(convert(spark, str(folder), str(tmp_path / "out"), drop_null=True))
    assert df.count() == 1 and {f"Cells_{n}" for n in odd} <= set(df.columns) and len(df.columns) == 3 * 304 + 2 + 4 + 2
    paths = convert(spark, str(folder), str(tmp_path / "pages"), concat=False)
    assert set(odd) <= {n.removeprefix("Cells_") for n in spark.read.parquet(*paths).columns}


def test_two_writers_lose_nothing(tmp_path, spark):
    """Appends of several writers at once: each changes what the others left."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "w")
    df = spark.createDataFrame([(1,)], "x int")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: Catalog(root).append(f"t{i % 2}", df), range(12)))
    c = Catalog(f"file://{root}")
    assert sorted(c.snapshots("t0") + c.snapshots("t1")) == sorted(done) and c.version() >= 14
    assert c.read(spark, "t0").count() == 6 and c.namespaces() == ["profiles"]


def test_sorted_output_spreads_equal_page_keys(spark):
    """Rows of one object number go to several tasks, by the keys behind it, in an order that is always the same."""
    names = ["Metadata_ObjectNumber_1", "Metadata_ImageNumber", "X", "Cytoplasm_Number_Object_Number", "Metadata_TableNumber", "Metadata_ObjectNumber"]
    keys = harmonize.sort_keys(names, "Cytoplasm_Number_Object_Number")
    assert keys == ["Metadata_TableNumber", "Metadata_ImageNumber", "Metadata_ObjectNumber"]
    df = spark.createDataFrame([(1, i) for i in range(20_000)], "Cytoplasm_Number_Object_Number int, Metadata_ImageNumber int")
    ordered = sorted_by(df, "Cytoplasm_Number_Object_Number", *harmonize.sort_keys(df.columns, "Cytoplasm_Number_Object_Number"))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(Cytoplasm_Number_Object_Number" in plan and "Metadata_ImageNumber#" in plan.split("rangepartitioning")[1].split(")")[0]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
