"""Queries over files: sources, discovery, layouts of output, and the warehouse with its images.

Each writes its files to the shared folder first, from tables of the test data, and then reads them by the operators.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.functions import ids, naming, types
from profloom.plans import Query, table
from profloom.plans.harmonize import convert
from profloom.plans.profiles import _STAND_INS, export_folder
from profloom.runtime import shared_path
from profloom.sources import delimited, discovery, npz, sinks, storage
from profloom.sources.discovery import Source
from profloom.sources.images import encode_tiff
from profloom.warehouse.access import describe_warehouse, read_table
from profloom.warehouse.catalog import Catalog

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# -- text files


def _write_bodies(df: DataFrame, root: str) -> str:
    """Each row (path, body) as a file below ``root``."""
    at = storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, body in zip(batch["path"].to_pylist(), batch["body"].to_pylist()):
                storage.make_folder(os.path.dirname(f"{root}/{path}"), at)
                system, place = at(f"{root}/{path}")
                with system.open_output_stream(place) as f:
                    f.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select("path", "body").where("body IS NOT NULL").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    return root


_DIRTY = """
WITH lines AS (
  SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN p_partkey || ',' || p_brand WHEN 2 THEN p_partkey || ',' || p_brand || ',' || p_size || ',x'
    WHEN 3 THEN p_partkey || ',"' || p_brand || '"y,' || p_size WHEN 4 THEN p_partkey || ',"' || p_brand || chr(10) || 'two",' || p_size ELSE p_partkey || ',' || p_brand || ',' || p_size END AS raw
  FROM part)
"""


def _dirty_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Parts as CSV files in which some records are short, long or badly quoted and some fields have line breaks."""
    key, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    kind = key % 7
    line = (
        F.when(kind == 1, F.concat_ws(",", key, brand)).when(kind == 2, F.concat_ws(",", key, brand, size, F.lit("x")))
        .when(kind == 3, F.concat(key, F.lit(',"'), brand, F.lit('"y,'), size)).when(kind == 4, F.concat(key, F.lit(',"'), brand, F.lit('\ntwo",'), size))
        .otherwise(F.concat_ws(",", key, brand, size))
    )
    root, at = shared_path(spark, "dirty"), storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage.make_folder(root, at)
        system, place = at(f"{root}/part-{TaskContext.get().partitionId()}.csv")
        with system.open_output_stream(place) as f:
            f.write(b"key,brand,size\n")
            for batch in batches:
                f.write("".join(x + "\n" for x in batch["line"].to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([place])], names=["path"])

    table(spark, sf_dir, "part").select(line.alias("line")).repartition(4).mapInArrow(run, "path string").collect()
    return discovery.walk_files(root, "*.csv")


@query(_DIRTY + """
SELECT p_partkey AS key, p_brand || CASE p_partkey % 7 WHEN 4 THEN chr(10) || 'two' ELSE '' END AS brand, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 7 NOT IN (1, 2, 3)""")
def q_csv_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of malformed files."""
    return delimited.read_csv(spark, _dirty_files(spark, sf_dir), malformed="rows")


@query(_DIRTY + "SELECT raw, CASE p_partkey % 7 WHEN 3 THEN 'quoting' ELSE 'columns' END AS reason FROM lines WHERE p_partkey % 7 IN (1, 2, 3)")
def q_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of malformed files that fail to parse, as they stand there, with the reason."""
    return delimited.rejected_records(spark, _dirty_files(spark, sf_dir)).select("raw", "reason")


# -- discovery


def _nuclei_files(spark: SparkSession, sf_dir: str) -> str:
    return _write_bodies(table(spark, sf_dir, "nuclei_file"), shared_path(spark, "files"))


@query("SELECT DISTINCT path, 'Nuclei.csv' AS group_name FROM nuclei_file WHERE lower(path) LIKE '%/nuclei.csv' AND strpos(body, chr(10)) > 0 AND strpos(body, chr(10)) < length(body)")
def q_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a target with records, by group, out of a folder of thousands."""
    root = _nuclei_files(spark, sf_dir)
    groups, _ = discovery.gather_sources(spark, root, ["nuclei"])
    base = discovery.expand_path(root)
    return spark.createDataFrame([(os.path.relpath(s.path, base), g) for g, sources in groups.items() for s in sources], "path string, group_name string")


@query("SELECT path, true AS equal FROM nuclei_file WHERE lower(path) LIKE '%/nuclei.csv' AND strpos(body, chr(10)) > 0 AND strpos(body, chr(10)) < length(body)")
def q_tablenumbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table numbers of files on disk: each equals the checksum of its file's bytes as the JVM computes it."""
    root = _nuclei_files(spark, sf_dir)
    groups, _ = discovery.gather_sources(spark, root, ["nuclei"])
    numbered = discovery.number_tables(spark, groups, True, image="nuclei")
    base = discovery.expand_path(root)
    found = spark.createDataFrame([(os.path.relpath(s.path, base), s.table_number) for sources in numbered.values() for s in sources], "path string, number bigint")
    return found.join(table(spark, sf_dir, "nuclei_file"), "path").select("path", (F.col("number") == F.crc32(F.encode("body", "UTF-8"))).alias("equal"))


@query("SELECT table_name, n FROM (SELECT 'Per_' || r_name AS table_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL) WHERE contains(lower(table_name), 'a')")
def q_sqlite_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a database whose name contains a target, with their rows."""
    import sqlite3

    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # the nations are 25
    db = sqlite3.connect(":memory:")
    for region in sorted({r["r_name"] for r in rows}):
        db.execute(f'CREATE TABLE "Per_{region}" (n_name VARCHAR)')
        db.executemany(f'INSERT INTO "Per_{region}" VALUES (?)', [(r["n_name"],) for r in rows if r["r_name"] == region])
    path = shared_path(spark, "regions") + ".sqlite"
    db.commit()
    storage.create(path, db.serialize())
    groups, _ = discovery.gather_sources(spark, path, ["a"])
    from profloom.sources import sqlite

    out = None
    for sources in groups.values():
        for s in sources:
            part = sqlite.read_sqlite(spark, s.path, s.table).agg(F.count("*").alias("n")).select(F.lit(s.table).alias("table_name"), "n")
            out = part if out is None else out.unionByName(part)
    return out


# -- arrays


@query("SELECT CAST(vec_id AS DOUBLE) AS Location_Center_X, CAST(label AS DOUBLE) AS Location_Center_Y, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS Model_{i + 1}" for i in range(64)) + " FROM embeddings")
def q_npz_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as NPZ files, a few hundred rows each, and read back by the source."""
    root, at = shared_path(spark, "npz"), storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage.make_folder(root, at)
        paths = []
        for batch in batches:
            for i in range(0, batch.num_rows, 300):
                part = batch.slice(i, 300)
                held = BytesIO()
                where = np.stack([part[c].to_numpy().astype(float) for c in ("vec_id", "label")], axis=1)
                features = np.array(part["embedding"].to_pylist(), np.float32)
                np.savez(held, features=features, locations=where, metadata=np.array({"Metadata_Model": "Model", "Metadata_Site": 3}, dtype=object))
                paths.append(f"{root}/{TaskContext.get().partitionId()}-{len(paths)}.npz")
                system, place = at(paths[-1])
                with system.open_output_stream(place) as f:
                    f.write(held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInArrow(run, "path string").collect()
    df = npz.spread_features(npz.read_npz(spark, [Source(p) for p in discovery.walk_files(root, "*.npz")]))
    return df.where("Metadata_Site = 3 AND Metadata_Model = 'Model'").drop("Metadata_TableNumber", "Metadata_NPZSource", "Metadata_Site", "Metadata_Model")


# -- names and types


@query("""
SELECT l_orderkey AS k, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS a, CAST(l_linenumber AS BIGINT) AS b, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS first_item, l_shipmode_like AS t
FROM (SELECT *, l_returnflag AS l_shipmode_like FROM lineitem)""")
def q_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonized types within structs and arrays."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.struct(F.col("l_quantity").cast("float").alias("a"), F.col("l_linenumber").cast("smallint").alias("b"), F.col("l_returnflag").alias("t")).alias("s"),
        F.array(F.col("l_tax").cast("float")).alias("items"),
    )
    return types.cast_types(df).select("k", "s.a", "s.b", F.col("items")[0].alias("first_item"), "s.t")


@query("SELECT c_custkey, c_mktsegment AS name FROM customer")
def q_last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of columns of one name the last stays."""
    df = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey", F.col("c_acctbal").alias("name"), F.col("c_mktsegment").alias("name"))
    names, keep = df.columns, naming.last_occurrences(df.columns)
    held = df.toDF(*(str(i) for i in range(len(names))))
    return held.select(*(F.col(str(i)).alias(names[i]) for i in keep))


@query("SELECT s_suppkey, s_name AS name, s_acctbal AS balance, CAST(s_nationkey AS BIGINT) AS item FROM supplier")
def q_strip_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs and arrays without the fields that are always null."""
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.struct(F.col("s_name").alias("name"), F.lit(None).alias("nothing"), F.struct(F.lit(None).alias("x"), F.col("s_acctbal").alias("balance")).alias("inner")).alias("v"),
        F.array(F.struct(F.lit(None).alias("nothing"), F.col("s_nationkey").cast("bigint").alias("item"))).alias("l"),
    )
    stripped = df.select("s_suppkey", *(types.strip_void(F.col(c), df.schema[c].dataType).alias(c) for c in ("v", "l")))
    assert "void" not in stripped.schema.simpleString()
    return stripped.select("s_suppkey", "v.name", "v.inner.*", F.col("l")[0]["item"].alias("item"))


@query("SELECT TableNumber, ImageNumber, ObjectNumber, CAST(floor(Location_Center_X) AS BIGINT) AS Metadata_SourceBBoxXMin, 9 AS Metadata_SourceBBoxXMax, 0 AS Metadata_SourceBBoxYMin, 1 AS Metadata_SourceBBoxYMax FROM nuclei WHERE NOT (CAST(Location_Center_X AS VARCHAR) = 'nan')")
def q_box_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that bound objects under their metadata names."""
    box = "Nuclei_AreaShape_BoundingBox"
    rows = table(spark, sf_dir, "nuclei").where("NOT isnan(Location_Center_X)")
    return ids.recode_box(rows.select(
        "TableNumber", "ImageNumber", "ObjectNumber", F.floor("Location_Center_X").alias(f"{box}Minimum_X"), F.lit(9).alias(f"{box}Maximum_X"), F.lit(0).alias(f"{box}Minimum_Y"), F.lit(1).alias(f"{box}Maximum_Y"),
    ))


# -- layouts of output

_CELLS = "SELECT Metadata_ImageNumber, Metadata_ObjectNumber, Cells_Feature FROM cells"
_JOINED = """
SELECT image.Metadata_ImageNumber, Image_FileName_DNA, cytoplasm.Metadata_ObjectNumber, Metadata_Cytoplasm_Parent_Cells, Metadata_Cytoplasm_Parent_Nuclei, Cytoplasm_Size,
  cytoplasm.Metadata_ObjectNumber AS Cytoplasm_Number_Object_Number, cells.Metadata_ObjectNumber AS Metadata_ObjectNumber_1, Cells_Feature,
  nuclei.Metadata_ObjectNumber AS Metadata_ObjectNumber_2, Nuclei_Feature
FROM cytoplasm JOIN cells USING (Metadata_ImageNumber) JOIN nuclei USING (Metadata_ImageNumber) LEFT JOIN image USING (Metadata_ImageNumber)
WHERE cells.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Cells AND nuclei.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Nuclei"""


@query(_STAND_INS + _CELLS)
def q_layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups written apart, each as one dataset: the cells' read back."""
    out = convert(spark, export_folder(spark, sf_dir), shared_path(spark, "groups"), join=False, add_tablenumber=False, source_datatype="csv")
    return spark.read.parquet(*out["Cells.csv"][0]["table"])


@query(_STAND_INS + _CELLS)
def q_layout_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source by itself in pages: all pages of the cells."""
    out = convert(spark, export_folder(spark, sf_dir), shared_path(spark, "sources"), join=False, concat=False, add_tablenumber=False, chunk_size=5000, source_datatype="csv")
    return spark.read.parquet(*(p for source in out["Cells.csv"] for p in source["table"]))


@query(_STAND_INS + _JOINED)
def q_layout_joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined profiles in a file per page of object numbers: all pages read back."""
    return spark.read.parquet(*convert(spark, export_folder(spark, sf_dir), shared_path(spark, "pages"), concat=False, add_tablenumber=False, source_datatype="csv"))


@query(_STAND_INS + f"SELECT 'profloom' AS producer, count(*) AS n FROM ({_JOINED})")
def q_layout_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined profiles in one file, with who wrote it in the footer."""
    import pyarrow.parquet as pq

    path = convert(spark, export_folder(spark, sf_dir), shared_path(spark, "single") + ".parquet", single_file=True, add_tablenumber=False, source_datatype="csv")
    system, place = storage.locate(path)
    footer = pq.read_metadata(place, filesystem=system)
    return spark.createDataFrame([(footer.metadata[b"data-producer"].decode(), footer.num_rows)], "producer string, n bigint")


@query("SELECT n_name, r_name, 'profloom' AS producer FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_producer_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset of many files, with who wrote it beside its first column."""
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    back = spark.read.parquet(sinks.write_dataset(df, shared_path(spark, "dataset")))
    return back.withColumn("producer", F.lit(back.schema[0].metadata.get("data-producer")))


# -- the warehouse

_WIDTH, _HEIGHT = 64, 48
_BOXES = {"Minimum_X": "k % 50", "Maximum_X": "k % 50 + o % 4 * 6", "Minimum_Y": "k % 40 - 3", "Maximum_Y": "k % 40 + 9"}
_BOXED_OBJECTS = _STAND_INS + f""", joined AS ({_JOINED}),
o AS (SELECT j.Metadata_ImageNumber AS k, j.Metadata_ObjectNumber AS o, 'img_' || substr(o_orderpriority, 1, 1) || o_orderstatus || '.tif' AS file FROM joined j JOIN orders ON o_orderkey = j.Metadata_ImageNumber),
b AS (SELECT *, k % 50 AS x0, k % 50 + o % 4 * 6 AS x1, k % 40 - 3 AS y0, k % 40 + 9 AS y1 FROM o),
c AS (SELECT *, least(x1, {_WIDTH}) AS x_end, greatest(y0, 0) AS y_begin, least(y1, {_HEIGHT}) AS y_end FROM b WHERE x0 < x1)
"""


def _store(spark: SparkSession, sf_dir: str) -> str:
    """A warehouse of profiles with boxes, crops and source images, from CSV exports and a folder of TIFF files."""
    images = shared_path(spark, "images")
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("img_"), F.substring("o_orderpriority", 1, 1), "o_orderstatus", F.lit(".tif"))
    at = storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage.make_folder(images, at)
        for batch in batches:
            for n in batch["name"].to_pylist():
                system, place = at(f"{images}/{n}")
                with system.open_output_stream(place) as f:
                    f.write(encode_tiff(np.arange(_WIDTH * _HEIGHT, dtype=np.uint16).reshape(_HEIGHT, _WIDTH)))
            yield batch

    orders.select(name.alias("name")).distinct().mapInArrow(run, "name string").collect()  # fifteen names

    def change(role: str, df: DataFrame) -> DataFrame:
        if role == "image":
            files = orders.select(F.col("o_orderkey").alias("Metadata_ImageNumber"), name.alias("Image_FileName_DNA"))
            return df.drop("Image_FileName_DNA").join(files, "Metadata_ImageNumber")
        if role == "cytoplasm":
            numbered = df.withColumns({"k": F.col("Metadata_ImageNumber"), "o": F.col("Metadata_ObjectNumber")})
            return numbered.withColumns({f"AreaShape_BoundingBox{n}": F.expr(e) for n, e in _BOXES.items()}).drop("k", "o")
        return df

    return convert(
        spark, export_folder(spark, sf_dir, change), shared_path(spark, "store"), dest_backend="iceberg", image_dir=images, include_source_images=True, add_tablenumber=False, source_datatype="csv"
    )


@query(_BOXED_OBJECTS + f"""
SELECT CAST(k AS VARCHAR) AS image_number, CAST(o AS VARCHAR) AS object_number, file, x_end - x0 AS width, y_end - y_begin AS height,
  CAST((x_end - x0) * {_WIDTH} * (y_end - y_begin) * (y_begin + y_end - 1) / 2 + (y_end - y_begin) * (x_end - x0) * (x0 + x_end - 1) / 2 AS BIGINT) AS pixel_sum
FROM c""")
def q_crop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop of every object of valid box, cut from its image: sizes and sums of pixels."""
    crops = read_table(spark, _store(spark, sf_dir), "image_crops").select("Metadata_ImageNumber", "Metadata_ObjectNumber", "source_image_file", "ome_arrow_image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures = batch["ome_arrow_image"].to_pylist()
            sums = [int(np.frombuffer(p["pixels"], p["dtype"]).sum()) for p in pictures]
            shapes = [[p["shape"][i] for p in pictures] for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in (*shapes, sums))], names=["image_number", "object_number", "file", "width", "height", "pixel_sum"])

    return crops.mapInArrow(run, "image_number string, object_number string, file string, width bigint, height bigint, pixel_sum bigint")


@query(_BOXED_OBJECTS + f"SELECT CAST(k AS VARCHAR) AS image_number, file, {_HEIGHT} AS height, {_WIDTH} AS width FROM o GROUP BY ALL")
def q_source_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source image as a whole, once per key."""
    shape = F.col("ome_arrow_image.shape")
    return read_table(spark, _store(spark, sf_dir), "source_images").select(F.col("Metadata_ImageNumber").alias("image_number"), F.col("source_image_file").alias("file"), shape[0].alias("height"), shape[1].alias("width"))


@query(_BOXED_OBJECTS + "SELECT k AS image_number, o AS object_number, file, true AS has_image FROM c")
def q_stored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved view of profiles with their crops, by its name."""
    view = read_table(spark, _store(spark, sf_dir), "profile_with_images")
    return view.select(F.col("Metadata_ImageNumber").alias("image_number"), F.col("Metadata_ObjectNumber").alias("object_number"), F.col("source_image_file").alias("file"), F.col("ome_arrow_image").isNotNull().alias("has_image"))


@query(_BOXED_OBJECTS + """
SELECT 'images.image_crops' AS table, 'table' AS kind, count(*) AS rows FROM c UNION ALL SELECT 'images.source_images', 'table', count(DISTINCT (k, file)) FROM o
UNION ALL SELECT 'profiles.joined_profiles', 'table', count(*) FROM o UNION ALL SELECT 'profiles.profile_with_images', 'view', NULL""")
def q_describe_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and views of a warehouse with their rows, from footers."""
    return describe_warehouse(spark, _store(spark, sf_dir)).select("table", "kind", "rows")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def q_append_by_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs of one warehouse that append in turn: each change is made on what the other left."""
    root, df = shared_path(spark, "writers"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    first, second = Catalog(root), Catalog(root)
    first.append("customer", df.drop("c_acctbal"))
    second.append("customer", df.where("c_acctbal < 0").drop("c_acctbal"))
    return first.read(spark, "customer")
