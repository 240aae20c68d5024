import os
import sqlite3
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from profloom.errors import DatatypeException, NoInputDataException, SchemaException
from profloom.plans import harmonize, profiles
from profloom.sources import delimited, discovery, images, npz, rasters, sinks, sqlite
from profloom.sources.discovery import Source
from profloom.warehouse import images as picture_tables


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)


def test_walk_follows_links_once(tmp_path):
    put(tmp_path / "real" / "in", a="x\n1\n")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    (tmp_path / "real" / "cycle").symlink_to(tmp_path)
    assert len(discovery.walk_files(str(tmp_path))) == 1
    assert discovery.walk_files(str(tmp_path), "*.txt") == [] and len(discovery.walk_files(str(tmp_path), "**/*.csv")) == 1
    put(tmp_path, b="x\n1\n", c="x\n")
    assert len(discovery.walk_files(str(tmp_path), most=2)) == 2
    assert len(discovery.walk_files(f"file://{tmp_path}", "*.csv")) >= 3


def test_paths_are_expanded(monkeypatch):
    monkeypatch.setenv("SOMEWHERE", "/data")
    assert discovery.expand_path(' "$SOMEWHERE/x" ') == "/data/x"
    assert discovery.expand_path("s3://bucket/x") == "s3://bucket/x"
    assert discovery.expand_path("file:/data/x") == discovery.expand_path("file:///data/x") == "/data/x"


def test_groups_and_checks(tmp_path, spark):
    put(tmp_path / "1", Cells="a\n1\n", image="a\n1\n", other="a\n1\n")
    put(tmp_path / "2", cells="a\n1\n", Image="a\n")
    groups, kind = discovery.gather_sources(spark, str(tmp_path), ["cells", "image"])
    assert kind == "csv" and {g: len(s) for g, s in groups.items()} == {"Cells.csv": 2, "Image.csv": 1}
    groups, _ = discovery.gather_sources(spark, str(tmp_path), None, "csv")
    assert list(groups) == ["All_files.csv"]
    with pytest.raises(DatatypeException):
        discovery.find_sources(str(tmp_path), None, None)
    with pytest.raises(NoInputDataException):
        discovery.gather_sources(spark, str(tmp_path), ["nuclei"])
    with pytest.raises(DatatypeException):
        discovery.infer_datatype(groups, "npz")
    (tmp_path / "1" / "cells.npz").write_bytes(b"x")
    with pytest.raises(DatatypeException):
        discovery.infer_datatype(discovery.find_sources(str(tmp_path), ["cells"], None))


def test_table_numbers(tmp_path, spark):
    for d, text in (("1", "n\n1\n"), ("2", "n\n2\n")):
        put(tmp_path / d, image=text, cells="a\n1\n")
    put(tmp_path / "3", cells="a\n1\n")
    groups, _ = discovery.gather_sources(spark, str(tmp_path), ["cells", "image"])
    numbered = discovery.number_tables(spark, groups)
    assert [s.table_number for s in numbered["Cells.csv"]] == [zlib.crc32(b"n\n1\n"), zlib.crc32(b"n\n2\n")]
    assert discovery.number_tables(spark, groups, False) is groups
    one = {g: s[:1] for g, s in groups.items()}
    assert discovery.number_tables(spark, one) is one
    assert discovery.number_tables(spark, one, True)["Image.csv"][0].table_number == zlib.crc32(b"n\n1\n")


def test_csv_types_and_traps(tmp_path, spark, rows):
    put(tmp_path, a='b,b,t,q,i,f,n,d,z\n1,x,true,"a ""b"", c",1,nan,,2024-01-02 03:04:05,5\n2,y,false,"two\nlines",2,1e3,,2024-01-03,x\n')
    df = delimited.read_csv(spark, [str(tmp_path / "a.csv")])
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "string", "bigint", "double", "void", "timestamp_ntz", "string"]
    assert df.columns[:2] == ["b", "b_1"]
    assert repr(rows(df, "q", "f", "n", "z")) == repr([("a \"b\", c", float("nan"), None, "5"), ("two\nlines", 1000.0, None, "x")])


def test_csv_files_of_different_headers(tmp_path, spark, rows):
    put(tmp_path, a="x,y,z\n1,2,3\n", b="y,x\n1.5,7\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "ab"]
    df = delimited.read_csv(spark, paths)
    assert df.dtypes == [("x", "bigint"), ("y", "double")] and rows(df) == [(1, 2.0), (7, 1.5)]
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\n1\n")
    assert delimited.read_csv(spark, [*paths, str(tmp_path / "bad.csv")]).count() == 2
    with pytest.raises(NoInputDataException):
        delimited.read_csv(spark, [str(tmp_path / "bad.csv")])


def test_malformed_csv_files_are_left_out(tmp_path, spark, rows, caplog):
    put(tmp_path, good='x,broken\n1,"a,\nb"\n\n2,\n', long="x,broken\n1,a\nword,b,surplus\n", short="x,broken\n7\n2,c\n", other="broken,x\nd,3\n", none="x,broken\n")
    (tmp_path / "long.csv").rename(tmp_path / "long + 1%.csv")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    df = delimited.read_csv(spark, paths)
    assert dict(df.dtypes) == {"x": "bigint", "broken": "string"}
    assert rows(df, "x", "broken") == [(1, "a,\nb"), (2, None), (3, "d")]
    assert sorted(r.getMessage().split(" has ")[0] for r in caplog.records if "left out" in r.getMessage()) == [str(tmp_path / n) for n in ("long + 1%.csv", "short.csv")]
    with pytest.raises(NoInputDataException):
        delimited.read_csv(spark, [str(tmp_path / "short.csv")])


@pytest.mark.parametrize("order", ["ab", "ba"])
def test_numbers_and_texts_of_different_headers(tmp_path, spark, rows, order):
    put(tmp_path, a="x,Count,a\n1,007,\n2,1.50,\n", b="Count,x\nn/a,3\n8,4\n")
    paths = [str(tmp_path / f"{n}.csv") for n in order]
    expected = sorted([(1, "007"), (2, "1.50"), (3, "n/a"), (4, "8")], key=repr)
    assert rows(delimited.read_csv(spark, paths), "x", "Count") == expected
    assert rows(harmonize.union_all(harmonize._csv_parts(spark, [Source(p) for p in paths])), "x", "Count") == expected


def test_numbers_and_texts_meet_in_text(spark, rows):
    number, text = spark.createDataFrame([(1, True)], "c int, f boolean"), spark.createDataFrame([("n/a", "no")], "c string, f string")
    assert rows(harmonize.union_all([number, text])) == rows(harmonize.union_all([text, number])) == sorted([("1", "true"), ("n/a", "no")], key=repr)


def database(path, n=100):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE tbl_a (col_integer INTEGER NOT NULL, col_text TEXT, col_blob BLOB, col_real DOUBLE, flag BOOLEAN, day DATE, size VARCHAR(64))")
        db.executemany("INSERT INTO tbl_a VALUES (?, 'sample', x'00ff', ?, 1, '2024-01-01', 's')", [("nan" if i == 1 else i, "nan" if i == 1 else i / 2) for i in range(n)])
        db.execute("CREATE TABLE empty (a INTEGER)")
        db.execute("CREATE TABLE odd (a GEOMETRY)")
    return str(path)


def test_sqlite_scan(tmp_path, spark):
    path = database(tmp_path / "a.sqlite")
    df = sqlite.read_sqlite(spark, path, "tbl_a", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert df.where("col_integer IS NULL").count() == df.where("col_real IS NULL").count() == 1
    assert df.where("flag = 1 AND day = '2024-01-01' AND size = 's'").count() == 100
    assert sqlite.read_sqlite(spark, path, "empty").count() == 0
    assert discovery.sqlite_tables(path) == ["empty", "odd", "tbl_a"]
    with pytest.raises(DatatypeException):
        sqlite.table_columns(path, "odd")


def archive(path, n=5, m=3, **meta):
    np.savez(path, features=np.arange(n * m, dtype=np.float32).reshape(n, m), locations=np.ones((n, 2)), metadata=np.array({"Metadata_Plate": "p", "Metadata_Site": 3, "Metadata_Model": "cnn", **meta}, dtype=object))
    return str(path)


def test_npz(tmp_path, spark, rows):
    sources = [Source(archive(tmp_path / "a.npz"), table_number=9), Source(archive(tmp_path / "b.npz", 2, Metadata_Plate=None))]
    df = npz.spread_features(npz.read_npz(spark, sources))
    assert df.columns == ["Metadata_TableNumber", "Metadata_NPZSource", "Metadata_Plate", "Metadata_Site", "Metadata_Model", "Location_Center_X", "Location_Center_Y", "cnn_1", "cnn_2", "cnn_3"]
    assert df.count() == 7 and rows(df.where("Metadata_NPZSource = 'b.npz'"), "Metadata_TableNumber", "Metadata_Plate", "cnn_3") == [(None, None, 2.0), (None, None, 5.0)]
    bad = [*sources, Source(archive(tmp_path / "c.npz", m=4))]
    with pytest.raises(Exception, match="shape"):
        npz.read_npz(spark, bad).collect()
    assert issubclass(SchemaException, Exception)


def test_embeddings_as_columns(tmp_path, spark, rows):
    arrays = [list(map(float, range(n))) for n in (64, 70)]
    spark.createDataFrame([(1, "a", arrays[0]), (2, None, arrays[1]), (3, "c", None), (4, "d", [])], "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = profiles.q_npz_flatten(spark, str(tmp_path))
    assert df.columns == ["vec_id", "label", *(f"DP_{i}" for i in range(1, 71))]
    blank = [None] * 70
    assert rows(df) == sorted([(1, "a", *arrays[0], *blank[64:]), (2, None, *arrays[1]), (3, "c", *blank), (4, "d", *blank)], key=repr)
    spark.createDataFrame([], "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert profiles.q_npz_flatten(spark, f"{tmp_path}/none").columns == ["vec_id", "label"]


def test_embeddings_keep_every_element(spark, data):
    from pyspark.sql import functions as F

    df = profiles.q_npz_flatten(spark, data)
    raw = spark.read.parquet(f"{data}/embeddings.parquet")
    width = raw.agg(F.max(F.size("embedding"))).first()[0]
    assert df.columns == ["vec_id", "label", *(f"DP_{i + 1}" for i in range(width))]
    back = df.select("vec_id", F.array(*df.columns[2:]).alias("a"))
    assert raw.join(back, "vec_id").where(F.col("embedding").cast("array<double>") == F.col("a")).count() == raw.where("embedding IS NOT NULL").count() > 0


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32", "int16"])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("shape", [(5, 7), (4, 3, 3)])
def test_tiff_round_trip(dtype, deflate, shape):
    image = (np.arange(np.prod(shape)) % 120).reshape(shape).astype(dtype)
    assert np.array_equal(images.decode_tiff(images.encode_tiff(image, deflate)), image)
    value = images.image_struct(image)
    assert np.array_equal(images.image_array(value), image)
    with pytest.raises(DatatypeException):
        images.decode_tiff(b"nothing")


def pages(*planes, smaller=()):
    """A TIFF of several directories; those whose number is in ``smaller`` are marked as copies of reduced size."""
    out = b""
    for i, plane in enumerate(planes):
        page = bytearray(images.encode_tiff(plane))
        (at,), base = struct.unpack("<I", page[4:8]), max(0, len(out) - 8)
        page[at + 58 : at + 62] = struct.pack("<I", 8 + base)  # where its strip begins
        if i in smaller:
            page[at + 74 : at + 86] = struct.pack("<HHII", images.SUBFILE, 4, 1, 1)  # in place of the rows per strip
        out = out[:-4] + struct.pack("<I", at + base) + page[8:] if out else bytes(page)
    return out


@pytest.mark.parametrize("shape", [(4, 5), (4, 5, 3)])
def test_tiff_of_several_pages(tmp_path, shape):
    planes = [(np.arange(np.prod(shape)) + 100 * k).reshape(shape).astype("uint16") for k in range(3)]
    image = images.decode_tiff(pages(*planes))
    assert image.shape == (3, 4, 5, shape[2] if len(shape) == 3 else 1) and all(np.array_equal(image[k].reshape(shape), p) for k, p in enumerate(planes))
    part = images.image_array(images.image_struct(images.crop(image, 1, 3, -2, 2)))
    assert all(np.array_equal(part[k], p[:2, 1:3].reshape(2, 2, -1)) for k, p in enumerate(planes))
    assert np.array_equal(images.decode_tiff(pages(planes[0], planes[1][::2], smaller=[1])), planes[0])
    with pytest.raises(DatatypeException, match="different"):
        images.decode_tiff(pages(planes[0], planes[1][::2]))
    circle = bytearray(pages(*planes))
    circle[-4:] = circle[4:8]
    with pytest.raises(DatatypeException, match="circle"):
        images.decode_tiff(bytes(circle))


def test_source_images_hold_all_planes(tmp_path, spark):
    (tmp_path / "a.tif").write_bytes(pages(*(np.full((4, 5), k, "uint8") for k in range(3))))
    profiles = spark.createDataFrame([(1, 2, "a.tif", 1, 1, 3, 4, "o")], "Metadata_TableNumber bigint, Metadata_ImageNumber bigint, Image_FileName_DNA string, Cells_AreaShape_BoundingBoxMinimum_X bigint, Cells_AreaShape_BoundingBoxMinimum_Y bigint, Cells_AreaShape_BoundingBoxMaximum_X bigint, Cells_AreaShape_BoundingBoxMaximum_Y bigint, Metadata_ObjectID string")
    whole = picture_tables.source_image_table(profiles, str(tmp_path)).first()["ome_arrow_image"]
    part = picture_tables.crop_table(profiles, str(tmp_path)).first()["ome_arrow_image"]
    assert whole["shape"] == [3, 4, 5, 1] and part["shape"] == [3, 3, 2, 1]
    assert images.image_array(part)[:, 0, 0, 0].tolist() == [0, 1, 2]


def test_crop_clamps():
    image = np.arange(100).reshape(10, 10)
    assert images.crop(image, -5, 2, 8, 99).tolist() == [[80, 81], [90, 91]]


def test_files_are_resolved(spark, rows):
    index = images.index_files(spark, ["a/x.tif", "b/x.tif", "c/y.ome.tiff"])
    values = spark.createDataFrame([("/r/a/x.tif",), ("x.tif",), ("z/y.png",), ("q.tif",), (None,)], "v string")
    assert rows(images.resolve_files(values, "v", index)) == [("/r/a/x.tif", "a/x.tif", 1), ("x.tif", "a/x.tif", 2), ("z/y.png", "c/y.ome.tiff", 1)]
    with pytest.raises(Exception, match="several images"):
        images.resolve_or_fail(values, "v", index).collect()


def test_segmentation():
    names = ["m/Mask_B02.tif", "m/mask_b01.tif", "m/other_b01.tif"]
    match = lambda v, p: images.match_segmentation(v, v, names, p)
    assert match("plate_B01_ch1.tif", {r"^mask_.*\.tif$": r"_(B\d\d)_"}) == "m/mask_b01.tif"
    assert match("plate_B01_ch1.tif", {r"^nothing$": r"_(B\d\d)_", r"^[mM]ask": r"(B\d\d)"}) == "m/mask_b01.tif"
    assert match("plate_C01.tif", {r"^mask": r"_(B\d\d)"}) is None


def test_sinks(tmp_path, spark, rows):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)] + [(None, "none")], "k bigint, v string")
    path = sinks.write_file(df.repartition(3), str(tmp_path / "one.parquet"))
    assert rows(spark.read.parquet(path)) == rows(df) and pq.read_schema(path).metadata[b"data-producer"] == b"profloom"
    assert os.listdir(tmp_path) == ["one.parquet"]
    paths = sinks.write_pages(df, "k", 4, str(tmp_path / "p" / "chunk"))
    assert [os.path.basename(p) for p in paths] == ["chunk-0-3.parquet", "chunk-4-7.parquet", "chunk-8-9.parquet"]
    assert pq.read_table(paths[1])["k"].to_pylist() == [4, 5, 6, 7]
    with pytest.raises(FileExistsError):
        sinks.check_free(path)
    with pytest.raises(DatatypeException):
        sinks.write_anndata(df, "x", "loom")
    with pytest.raises(ImportError, match="anndata"):
        sinks.write_anndata(df, "x", "anndata_h5ad")


def lzw_codes(data):
    """LZW of TIFF: codes from the high bit, one bit more a code early, the table anew when it is full."""
    out, codes, known, word, width = [], [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    n = 258
    for b in data:
        longer = word + bytes([b])
        if longer in known:
            word = longer
            continue
        codes.append((known[word], width))
        known[longer] = n
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        if n == 4094:
            codes.append((256, width))
            known, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        codes.append((known[word], width))
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
    bits = "".join(format(c, f"0{w}b") for c, w in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw_and_packed_runs():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"aaaaaaa" * 50, bytes(rng.integers(0, 4, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 20_000, dtype=np.uint8))):
        assert rasters.lzw(lzw_codes(data)) == data
    assert rasters.packed_runs(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])
    with pytest.raises(DatatypeException):
        rasters.lzw(bytes([0x80, 0x7F, 0xFF]))


def tiff(image, rows, columns, compression, predictor, tiled, apart=False, order="<"):
    """A TIFF file in strips or tiles."""
    image = image if image.ndim == 3 else image[:, :, None]
    height, width, samples = image.shape
    packers = {1: bytes, 5: lzw_codes, 8: zlib.compress}
    parts = []
    for plane in np.split(image, samples, axis=2) if apart else [image]:
        for y in range(0, height, rows):
            for x in range(0, width, columns):
                part = plane[y : y + rows, x : x + columns]
                if tiled:
                    part = np.pad(part, [(0, rows - part.shape[0]), (0, columns - part.shape[1]), (0, 0)])
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    h, w, s = part.shape
                    size = part.dtype.itemsize
                    planes = part.astype(part.dtype.newbyteorder(">")).reshape(h, w * s).view(np.uint8).reshape(h, w * s, size).transpose(0, 2, 1).reshape(h, w * size, s)
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
                parts.append(packers[compression](raw))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    body, at = b"".join(parts), [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [image.dtype.itemsize * 8] * samples), (259, 3, [compression]), (277, 3, [samples]), (284, 3, [2 if apart else 1]), (317, 3, [predictor]), (339, 3, [kind] * samples)]
    entries += [(322, 4, [columns]), (323, 4, [rows]), (324, 4, at), (325, 4, list(map(len, parts)))] if tiled else [(273, 4, at), (278, 4, [rows]), (279, 4, list(map(len, parts)))]
    table, extra = b"", b""
    end = 8 + len(body) + 2 + 12 * len(entries) + 4
    for tag, k, values in sorted(entries):
        packed = struct.pack(f"{order}{len(values)}{'I' if k == 4 else 'H'}", *values)
        if len(packed) > 4:
            packed, extra = struct.pack(order + "I", end + len(extra)), extra + packed
        table += struct.pack(order + "HHI", tag, k, len(values)) + packed.ljust(4, b"\0")
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(body)) + body + struct.pack(order + "H", len(entries)) + table + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize(("dtype", "predictor"), [(np.uint8, 1), (np.uint16, 2), (np.int32, 2), (np.float32, 3), (np.float64, 3), (np.float32, 1)])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("tiled", "apart", "order"), [(True, False, "<"), (False, False, ">"), (True, True, ">")])
def test_tiles_strips_and_predictors(dtype, predictor, compression, tiled, apart, order):
    rng = np.random.default_rng(5)
    for shape in ((37, 50), (33, 16, 3)):
        image = (rng.normal(size=shape) * 50).astype(dtype)
        data = tiff(image, 16, 16 if tiled else shape[1], compression, predictor, tiled, apart and len(shape) == 3, order)
        assert np.array_equal(images.decode_tiff(data), image)


@pytest.mark.parametrize("version", [2, 3])
def test_zarr_folders(tmp_path, version):
    import gzip
    import json

    image = np.arange(2 * 3 * 7 * 9, dtype=np.uint16).reshape(1, 2, 3, 7, 9)
    root = tmp_path / "a.ome.zarr"
    chunks = (1, 1, 2, 4, 5)
    (root / "0").mkdir(parents=True)
    scales = {"multiscales": [{"datasets": [{"path": "0"}, {"path": "1"}]}]}
    if version == 2:
        (root / ".zattrs").write_text(json.dumps(scales))
        (root / "0" / ".zarray").write_text(json.dumps({"shape": image.shape, "chunks": chunks, "dtype": "<u2", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "filters": None, "order": "C", "dimension_separator": "/"}))
    else:
        (root / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {"ome": scales}}))
        about = {"node_type": "array", "shape": image.shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "data_type": "uint16", "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}]}
        (root / "0" / "zarr.json").write_text(json.dumps(about))
    for at in np.ndindex(*(-(-n // c) for n, c in zip(image.shape, chunks))):
        part = image[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        part = np.pad(part, [(0, c - n) for c, n in zip(chunks, part.shape)])
        path = (root / "0" / ("" if version == 2 else "c")).joinpath(*map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zlib.compress(part.tobytes()) if version == 2 else gzip.compress(part.astype(">u2").tobytes()))
    assert images.list_images(str(tmp_path)) == ["a.ome.zarr"] == images.list_images(f"file://{tmp_path}")
    got = images.load_image(str(root))
    assert got.shape == (6, 7, 9, 1) and np.array_equal(got[..., 0], image.reshape(6, 7, 9))
    assert images.crop(got, 2, 5, 1, 4).shape == (6, 3, 3, 1)
    with pytest.raises(DatatypeException):
        (tmp_path / "b.zarr").mkdir()
        images.load_image(str(tmp_path / "b.zarr"))
