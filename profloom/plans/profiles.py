"""Queries of the harmonization operators over the test tables.

The image, nuclei and ph3 tables are used as they are; orders and lineitem stand in where a query
needs three object compartments: orders are images, lineitem rows grouped by order and line
are objects whose parents have the line's number, and one compartment lacks line 7.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.functions import ids, naming, types
from profloom.operators import pages
from profloom.plans import Query, table
from profloom.plans.dialect import run_join_sql
from profloom.plans.harmonize import convert, union_all
from profloom.plans.joins import JoinSpec, except_columns, join_compartments, matching_columns
from profloom.presets import PRESETS
from profloom.runtime import materialize, shared_path, shuffle_partitions
from profloom.sources import delimited, images, npz, sqlite, storage
from profloom.sources.discovery import walk_files
from profloom.streaming.ingest import counts_by_period, ingest
from profloom.warehouse import images as picture_tables
from profloom.warehouse.access import describe_frames, read_table
from profloom.warehouse.catalog import Catalog

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _told(df: DataFrame) -> DataFrame:
    """NaN in a form that compares equal to itself: each float column is null there, and a column beside it tells so."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats} | {f"{n}_is_nan": F.coalesce(F.isnan(n), F.lit(False)) & F.col(n).isNotNull() for n in floats})


def _told_sql(sql: str, *floats: str) -> str:
    """The same of a query's ``floats``."""
    with_query, _, rest = sql.rpartition("\n--\n")
    # by its text, as statistics of files, which leave NaN out, may fold isnan to false
    null = ", ".join(f"CASE WHEN CAST({n} AS VARCHAR) <> 'nan' THEN {n} END AS {n}" for n in floats)
    tell = ", ".join(f"coalesce(CAST({n} AS VARCHAR) = 'nan', false) AS {n}_is_nan" for n in floats)
    return f"{with_query}\nSELECT * REPLACE ({null}), {tell} FROM ({rest})"


# -- stand-ins


def _objects(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if kind == "cells":
        lines = lines.where("l_linenumber <> 7")
    by = lines.groupBy(F.col("l_orderkey").alias("Metadata_ImageNumber"), F.col("l_linenumber").cast("bigint").alias("Metadata_ObjectNumber"))
    if kind == "cytoplasm":
        out = by.agg(F.max("l_quantity").alias("Cytoplasm_Size"))
        parent = F.col("Metadata_ObjectNumber")
        return out.select("*", parent.alias("Metadata_Cytoplasm_Parent_Cells"), parent.alias("Metadata_Cytoplasm_Parent_Nuclei"))
    measure = "l_extendedprice" if kind == "cells" else "l_discount"
    return by.agg(F.min(measure).alias(f"{kind.capitalize()}_Feature"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Metadata_ImageNumber"), F.col("o_orderpriority").alias("Image_Metadata_Well"), F.col("o_orderstatus").alias("Image_Metadata_Plate"),
        F.concat(F.lit("img_"), F.col("o_orderkey"), F.lit(".tiff")).alias("Image_FileName_DNA"),
    )


def _roles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"image": _images(spark, sf_dir)} | {k: _objects(spark, sf_dir, k) for k in ("cytoplasm", "cells", "nuclei")}


_STAND_INS = """
WITH cytoplasm AS (
  SELECT l_orderkey AS Metadata_ImageNumber, CAST(l_linenumber AS BIGINT) AS Metadata_ObjectNumber, max(l_quantity) AS Cytoplasm_Size,
    CAST(l_linenumber AS BIGINT) AS Metadata_Cytoplasm_Parent_Cells, CAST(l_linenumber AS BIGINT) AS Metadata_Cytoplasm_Parent_Nuclei
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
cells AS (
  SELECT l_orderkey AS Metadata_ImageNumber, CAST(l_linenumber AS BIGINT) AS Metadata_ObjectNumber, min(l_extendedprice) AS Cells_Feature
  FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_orderkey, l_linenumber),
nuclei AS (
  SELECT l_orderkey AS Metadata_ImageNumber, CAST(l_linenumber AS BIGINT) AS Metadata_ObjectNumber, min(l_discount) AS Nuclei_Feature
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
image AS (
  SELECT o_orderkey AS Metadata_ImageNumber, o_orderpriority AS Image_Metadata_Well, o_orderstatus AS Image_Metadata_Plate,
    'img_' || o_orderkey || '.tiff' AS Image_FileName_DNA FROM orders)
"""


@query(_STAND_INS + """
SELECT image.Metadata_ImageNumber, Image_FileName_DNA, cytoplasm.* EXCLUDE (Metadata_ImageNumber),
  cells.Metadata_ObjectNumber AS Metadata_ObjectNumber_1, Cells_Feature, nuclei.Metadata_ObjectNumber AS Metadata_ObjectNumber_2, Nuclei_Feature
FROM cytoplasm LEFT JOIN cells USING (Metadata_ImageNumber) LEFT JOIN nuclei USING (Metadata_ImageNumber) LEFT JOIN image USING (Metadata_ImageNumber)
WHERE cells.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Cells AND nuclei.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Nuclei""")
def q_compartment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_compartments(_roles(spark, sf_dir), PRESETS["cellprofiler_csv"].joins)


@query(_STAND_INS + """
SELECT image.Metadata_ImageNumber, Image_Metadata_Plate, Image_FileName_DNA, cytoplasm.* EXCLUDE (Metadata_ImageNumber),
  cells.Metadata_ObjectNumber AS Metadata_ObjectNumber_1, Cells_Feature, nuclei.Metadata_ObjectNumber AS Metadata_ObjectNumber_2, Nuclei_Feature
FROM cytoplasm
LEFT JOIN cells ON cells.Metadata_ImageNumber = cytoplasm.Metadata_ImageNumber AND cells.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Cells
LEFT JOIN nuclei ON nuclei.Metadata_ImageNumber = cytoplasm.Metadata_ImageNumber AND nuclei.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Nuclei
LEFT JOIN image ON image.Metadata_ImageNumber = cytoplasm.Metadata_ImageNumber""")
def q_compartment_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = PRESETS["cellprofiler_sqlite_cpg0016_jump"].joins
    return join_compartments(_roles(spark, sf_dir), JoinSpec(spec.keys, spec.match, ("Metadata_ImageNumber", "Image_Metadata_Plate"), without=spec.without, keep_unmatched=True))


_USER_JOIN = """
WITH objects AS (
  SELECT a.* EXCLUDE (Metadata_Cytoplasm_Parent_Nuclei), b.Cells_Feature
  FROM read_parquet('cytoplasm.parquet') AS a
  LEFT JOIN read_parquet('cells.parquet') AS b
    ON a.Metadata_ImageNumber = b.Metadata_ImageNumber AND a.Metadata_Cytoplasm_Parent_Cells = b.Metadata_ObjectNumber)
SELECT objects.*, COLUMNS('Image_.*') FROM objects
INNER JOIN read_parquet('image.parquet') AS image ON image.Metadata_ImageNumber = objects.Metadata_ImageNumber
WHERE image.Image_Metadata_Plate <> 'no EXCLUDE here'"""


@query(_STAND_INS + """
SELECT a.* EXCLUDE (Metadata_Cytoplasm_Parent_Nuclei), b.Cells_Feature, Image_Metadata_Well, Image_Metadata_Plate, Image_FileName_DNA
FROM cytoplasm a LEFT JOIN cells b ON a.Metadata_ImageNumber = b.Metadata_ImageNumber AND a.Metadata_Cytoplasm_Parent_Cells = b.Metadata_ObjectNumber
JOIN image ON image.Metadata_ImageNumber = a.Metadata_ImageNumber""")
def q_join_with_cte_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _roles(spark, sf_dir)
    return run_join_sql(spark, _USER_JOIN, {k: roles[k] for k in ("image", "cytoplasm", "cells")})


@query(_STAND_INS + "SELECT * FROM cytoplasm JOIN cells USING (Metadata_ImageNumber, Metadata_ObjectNumber)")
def q_inner_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT * FROM read_parquet('cytoplasm.parquet') INNER JOIN read_parquet('cells.parquet') USING (Metadata_ImageNumber, Metadata_ObjectNumber)"
    return run_join_sql(spark, sql, {k: _objects(spark, sf_dir, k) for k in ("cytoplasm", "cells")})


@query(_STAND_INS + """
SELECT a.Metadata_ImageNumber, a.Metadata_ObjectNumber, a.Cells_Feature, b.Metadata_ImageNumber AS Metadata_ImageNumber_1,
  b.Metadata_ObjectNumber AS Metadata_ObjectNumber_1, b.Nuclei_Feature
FROM cells a JOIN nuclei b ON a.Metadata_ImageNumber = b.Metadata_ImageNumber AND a.Metadata_ObjectNumber = b.Metadata_ObjectNumber""")
def q_join_dedupe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT * FROM read_parquet('cells.parquet') a JOIN read_parquet('nuclei.parquet') b ON a.Metadata_ImageNumber = b.Metadata_ImageNumber AND a.Metadata_ObjectNumber = b.Metadata_ObjectNumber"
    return run_join_sql(spark, sql, {k: _objects(spark, sf_dir, k) for k in ("cells", "nuclei")})


# -- profile tables


def _named(df: DataFrame, group: str) -> DataFrame:
    config = PRESETS["cell-health-cellprofiler-to-cytominer-database"]
    known = [*config.identifying_columns, "ObjectNumber", "Metadata_Plate"]
    return df.toDF(*naming.prefixed_names(df.columns, group, known, config.metadata, ("cells", "nuclei", "ph3")))


def _live_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nuclei").where("removed_at IS NULL")
    return rows.groupBy("TableNumber", "ImageNumber", "ObjectNumber").agg(F.max("AreaShape_Area").alias("AreaShape_Area"), F.min("c0").alias("c0"))


def _wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").groupBy("TableNumber", "ImageNumber").agg(
        F.max("Metadata_Plate").alias("Metadata_Plate"), F.max("Metadata_Well").alias("Metadata_Well"), F.min("FileName_DNA").alias("FileName_DNA")
    )


_PROFILE_TABLES = """
WITH n AS (
  SELECT TableNumber, ImageNumber, ObjectNumber, max(AreaShape_Area) AS area, min(c0) AS c0 FROM nuclei WHERE removed_at IS NULL GROUP BY ALL),
p AS (
  SELECT TableNumber, ImageNumber, ObjectNumber, min(Parent_Nuclei) AS parent, max(Location_Center_Y) AS y FROM ph3 GROUP BY ALL),
i AS (
  SELECT TableNumber, ImageNumber, max(Metadata_Plate) AS plate, max(Metadata_Well) AS well, min(FileName_DNA) AS file FROM image GROUP BY ALL)
"""


@query(_told_sql(_PROFILE_TABLES + """
--
SELECT i.TableNumber AS Metadata_TableNumber, i.ImageNumber AS Metadata_ImageNumber, i.plate AS Metadata_Plate, i.well AS Metadata_Well, i.file AS Image_FileName_DNA,
  p.ObjectNumber AS Metadata_ObjectNumber, p.parent AS Ph3_Parent_Nuclei, p.y AS Ph3_Location_Center_Y,
  n.ObjectNumber AS Metadata_ObjectNumber_1, n.area AS Nuclei_AreaShape_Area, n.c0 AS Nuclei_c0
FROM p JOIN n ON p.TableNumber = n.TableNumber AND p.ImageNumber = n.ImageNumber AND p.parent = n.ObjectNumber
LEFT JOIN i ON i.TableNumber = p.TableNumber AND i.ImageNumber = p.ImageNumber""", "Ph3_Location_Center_Y", "Nuclei_AreaShape_Area", "Nuclei_c0"))
def q_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PH3 objects with their nuclei and images: the three profile tables through naming and join."""
    marks = table(spark, sf_dir, "ph3").groupBy("TableNumber", "ImageNumber", "ObjectNumber").agg(F.min("Parent_Nuclei").alias("Parent_Nuclei"), F.max("Location_Center_Y").alias("Location_Center_Y"))
    marks = _named(marks, "PH3.csv").withColumnRenamed("Metadata_Ph3_Parent_Nuclei", "Ph3_Parent_Nuclei")
    keys = ("Metadata_TableNumber", "Metadata_ImageNumber")
    spec = JoinSpec(keys, {"nuclei": ("Metadata_ObjectNumber", "Ph3_Parent_Nuclei")}, (*keys, "Metadata_Plate", "Metadata_Well"), without=keys, anchor="ph3")
    return _told(join_compartments({"image": _named(_wells(spark, sf_dir), "Image.csv"), "ph3": marks, "nuclei": _named(_live_nuclei(spark, sf_dir), "Nuclei.csv")}, spec))


@query(_PROFILE_TABLES + "SELECT TableNumber, ImageNumber, ObjectNumber, plate AS Metadata_Plate, area AS AreaShape_Area FROM n LEFT JOIN i USING (TableNumber, ImageNumber)")
def q_tablenumber_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = JoinSpec(("TableNumber", "ImageNumber"), {}, ("Metadata_Plate",), None, ("c0",), anchor="nuclei")
    return join_compartments({"nuclei": _live_nuclei(spark, sf_dir), "image": _wells(spark, sf_dir)}, spec)


@query(_told_sql("SELECT CAST(7 AS BIGINT) AS TableNumber, CAST(ImageNumber AS INTEGER) AS ImageNumber, CAST(ObjectNumber AS INTEGER) AS ObjectNumber, CAST(AreaShape_Area AS FLOAT) AS AreaShape_Area, CAST(c0 AS FLOAT) AS c0 FROM nuclei", "AreaShape_Area", "c0"))
def q_cast_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = types.cast_types(table(spark, sf_dir, "nuclei").select("ImageNumber", "ObjectNumber", "AreaShape_Area", "c0"), {"float": "float32", "integer": "int32"})
    return _told(df.select(F.lit(7).cast("bigint").alias("TableNumber"), "*"))


@query(_told_sql("""
SELECT TableNumber AS Metadata_TableNumber, ImageNumber AS Metadata_ImageNumber, ObjectNumber AS Metadata_ObjectNumber, c0 AS Nuclei_c0,
  AreaShape_Area AS Nuclei_AreaShape_Area, Location_Center_X AS Metadata_Nuclei_Parent_Cells, Location_Center_Y AS Metadata_Nuclei_ObjectNumber,
  Intensity_MeanIntensity_DNA AS Nuclei_Intensity, CAST(loaded_at AS VARCHAR) IS NULL AS Metadata_Well FROM nuclei""",
    "Nuclei_c0", "Nuclei_AreaShape_Area", "Metadata_Nuclei_Parent_Cells", "Metadata_Nuclei_ObjectNumber", "Nuclei_Intensity"))
def q_prefix_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches of the naming rule: features with and without the name, keys of every sort."""
    df = table(spark, sf_dir, "nuclei").select(
        "TableNumber", "ImageNumber", "ObjectNumber", "c0", F.col("AreaShape_Area").alias("Nuclei_AreaShape_Area"), F.col("Location_Center_X").alias("Parent_Cells"),
        F.col("Location_Center_Y").alias("Nuclei_ObjectNumber"), F.col("Intensity_MeanIntensity_DNA").alias("Intensity"), F.col("loaded_at").isNull().alias("Metadata_Well"),
    )
    return _told(_named(df, "Per_Nuclei.sqlite"))


@query(_told_sql("SELECT TableNumber, ImageNumber, ObjectNumber, Metadata_Extra, Image_Note, Cells_X, Nuclei_c0, zeta FROM (SELECT *, 1 AS Metadata_Extra, 2 AS Image_Note, c0 AS Nuclei_c0, AreaShape_Area AS Cells_X, Location_Center_X AS zeta FROM nuclei)", "Cells_X", "Nuclei_c0", "zeta"))
def q_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nuclei").select(
        F.col("Location_Center_X").alias("zeta"), F.col("c0").alias("Nuclei_c0"), F.col("AreaShape_Area").alias("Cells_X"), F.lit(2).alias("Image_Note"),
        F.lit(1).alias("Metadata_Extra"), "ObjectNumber", "ImageNumber", "TableNumber",
    )
    return _told(df.select(*naming.ordered_columns(df.columns)))


@query(_told_sql("SELECT * EXCLUDE (loaded_at, removed_at, URL_DNA) FROM image", "Count_Cells", "Count_Nuclei", "Count_PH3", "ExecutionTime_01Images"))
def q_exclude_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "image")
    return _told(df.select(*except_columns(df.columns, ["loaded_at", "REMOVED_AT", "URL_DNA"])))


@query(_told_sql("SELECT ImageNumber, COLUMNS('Name_.*|Count_') FROM image", "Count_Cells", "Count_Nuclei", "Count_PH3"))
def q_columns_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "image")
    return _told(df.select("ImageNumber", *matching_columns(df.columns, "Name_.*|Count_")))


_PAGES_OF = """
WITH RECURSIVE k AS (SELECT {key} AS key, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY ALL),
c AS (SELECT key, n, sum(n) OVER (ORDER BY key) - n AS before FROM k),
starts(page, first_key, seen) AS (
  SELECT CAST(0 AS BIGINT), (SELECT min(key) FROM c), CAST(0 AS HUGEINT)
  UNION ALL
  SELECT page + 1, (SELECT min(key) FROM c WHERE before >= seen + 1000), (SELECT min(before) FROM c WHERE before >= seen + 1000)
  FROM starts WHERE EXISTS (SELECT 1 FROM c WHERE before >= seen + 1000)),
key_pages AS (SELECT key, n, (SELECT max(page) FROM starts WHERE first_key <= key) AS page FROM k)
"""
_PAGES = _PAGES_OF.format(key="o_custkey", table="orders")


@query(_told_sql(_PAGES_OF.format(key="ImageNumber", table="nuclei") + """, ranges AS (SELECT page, min(key) AS lo, max(key) AS hi FROM key_pages GROUP BY page)
--
SELECT page, lo, hi, TableNumber, ImageNumber, ObjectNumber, c0 FROM nuclei JOIN ranges ON ImageNumber BETWEEN lo AND hi""", "c0"))
def q_keyset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the nuclei by its range of image numbers, in order."""
    df = table(spark, sf_dir, "nuclei").select("TableNumber", "ImageNumber", "ObjectNumber", "c0")
    return _told(pages.sorted_by(pages.ranged(df, "ImageNumber", 1000), "page", "ImageNumber", "TableNumber", "ObjectNumber"))


@query(_PAGES + "SELECT page, min(key) AS lo, max(key) AS hi FROM key_pages GROUP BY page")
def q_pagesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages(table(spark, sf_dir, "orders"), "o_custkey", 1000)


@query(_PAGES + "SELECT o_orderkey, o_custkey, page FROM orders JOIN key_pages ON o_custkey = key")
def q_page_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assign_pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 1000)


@query(_told_sql("""
SELECT TableNumber, ImageNumber, ObjectNumber, CAST(c0 AS DOUBLE) AS measure FROM nuclei
UNION ALL SELECT TableNumber, ImageNumber, ObjectNumber, CAST(Number_Object_Number AS DOUBLE) FROM ph3""", "measure"))
def q_concat_common_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["TableNumber", "ImageNumber", "ObjectNumber"]
    a = table(spark, sf_dir, "nuclei").select(*keys, F.col("c0").alias("measure"), "AreaShape_Area")
    b = table(spark, sf_dir, "ph3").select(F.col("Number_Object_Number").alias("measure"), *keys, "Location_Center_Z")
    return _told(union_all([a, b]))


@query(r"SELECT DISTINCT path, list_aggregate(list_transform(regexp_extract_all(path, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), 'string_agg', '') AS natural_key FROM image_file")
def q_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_file").select("path", naming.natural_column(F.col("path")).alias("natural_key")).distinct().orderBy("natural_key")


@query(_told_sql("SELECT TableNumber, ImageNumber, Metadata_Plate, Metadata_Well, Count_Cells FROM image WHERE Metadata_Plate IS NOT NULL AND Metadata_Well IS NOT NULL AND Count_Cells IS NOT NULL AND TableNumber IS NOT NULL AND ImageNumber IS NOT NULL", "Count_Cells"))
def q_drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(pages.drop_null_rows(table(spark, sf_dir, "image").select("TableNumber", "ImageNumber", "Metadata_Plate", "Metadata_Well", "Count_Cells")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (isnan(c0)) AS n_nan FROM nuclei WHERE c0 IS NOT NULL")
def q_drop_null_keeps_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.drop_null_rows(table(spark, sf_dir, "nuclei").select("c0"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.isnan("c0")).alias("n_nan"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuclei of each object once, with bounds as texts, some of which are no numbers or no box."""
    x, y = F.col("x"), F.col("y")
    objects = table(spark, sf_dir, "nuclei").groupBy("TableNumber", "ImageNumber", "ObjectNumber").agg(F.max("Location_Center_X").alias("x"), F.max("Location_Center_Y").alias("y"))
    return objects.select(
        F.col("TableNumber").alias("Metadata_TableNumber"), F.col("ImageNumber").alias("Metadata_ImageNumber"), F.col("ObjectNumber").alias("Metadata_ObjectNumber"),
        F.when(F.col("ObjectNumber") % 11 == 0, "bad").otherwise(F.floor(x).cast("string")).alias("Nuclei_AreaShape_BoundingBoxMinimum_X"),
        (F.floor(x) + F.col("ObjectNumber") % 5 * 3).cast("string").alias("Nuclei_AreaShape_BoundingBoxMaximum_X"),
        F.floor(y).cast("string").alias("Nuclei_AreaShape_BoundingBoxMinimum_Y"), (F.floor(y) + F.col("ObjectNumber") % 2 * 2 + 0.5).cast("string").alias("Nuclei_AreaShape_BoundingBoxMaximum_Y"),
    )


_BOXED = """
WITH o AS (SELECT TableNumber AS t, ImageNumber AS i, ObjectNumber AS o, max(Location_Center_X) AS x, max(Location_Center_Y) AS y FROM nuclei GROUP BY ALL),
b AS (
  SELECT t, i, o, CASE WHEN o % 11 = 0 THEN 'bad' ELSE CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) END AS x0, CAST(CAST(floor(x) AS BIGINT) + o % 5 * 3 AS VARCHAR) AS x1,
    CAST(CAST(floor(y) AS BIGINT) AS VARCHAR) AS y0, CAST(CAST(floor(y) AS BIGINT) + o % 2 * 2 + 0.5 AS VARCHAR) AS y1 FROM o WHERE NOT isnan(x) AND NOT isnan(y))
"""


@query(_BOXED + """
SELECT t AS table_number, i AS image_number, o AS object_number, CAST(trunc(try_cast(x0 AS DOUBLE)) AS BIGINT) AS x_min, CAST(trunc(try_cast(x1 AS DOUBLE)) AS BIGINT) AS x_max FROM b
WHERE trunc(try_cast(x0 AS DOUBLE)) < trunc(try_cast(x1 AS DOUBLE)) AND trunc(try_cast(y0 AS DOUBLE)) < trunc(try_cast(y1 AS DOUBLE))""")
def q_try_cast_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _boxed(spark, sf_dir)
    bounds = ids.box_bounds(ids.resolve_box(df.columns), whole=True)
    return df.where(ids.box_is_valid(bounds)).select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), F.col("Metadata_ObjectNumber").alias("object_number"), bounds["x_min"].alias("x_min"), bounds["x_max"].alias("x_max"))


@query(_BOXED + """
SELECT t AS table_number, i AS image_number, o AS object_number, try_cast(y1 AS DOUBLE) AS y_max FROM b
WHERE try_cast(x0 AS DOUBLE) < try_cast(x1 AS DOUBLE) AND try_cast(y0 AS DOUBLE) < try_cast(y1 AS DOUBLE)""")
def q_bbox_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _boxed(spark, sf_dir)
    bounds = ids.box_bounds(ids.resolve_box(df.columns), whole=False)
    return df.where(ids.box_is_valid(bounds)).select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), F.col("Metadata_ObjectNumber").alias("object_number"), bounds["y_max"].alias("y_max"))


@query(r"SELECT TableNumber, Key AS setting, CASE WHEN regexp_full_match(Value, '-?[0-9]{1,18}') THEN CAST(Value AS BIGINT) END AS whole_value FROM experiment")
def q_typeof_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of another class than its column's becomes null, as the guarded database scan gives it."""
    value = F.when(F.col("Value").rlike(r"\A-?[0-9]{1,18}\z"), F.col("Value").try_cast("bigint"))
    return table(spark, sf_dir, "experiment").select("TableNumber", F.col("Key").alias("setting"), value.alias("whole_value"))


# -- images and identifiers


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").groupBy(F.col("TableNumber").alias("Metadata_TableNumber"), F.col("ImageNumber").alias("Metadata_ImageNumber")).agg(
        F.max("Metadata_Well").alias("Metadata_Well"), F.max("FileName_DNA").alias("Image_FileName_DNA"), F.max("URL_DNA").alias("Image_URL_DNA")
    )


_FILES = """
WITH f AS (SELECT TableNumber AS t, ImageNumber AS i, max(Metadata_Well) AS well, max(FileName_DNA) AS Image_FileName_DNA, max(URL_DNA) AS Image_URL_DNA FROM image GROUP BY ALL),
m AS (
  SELECT t, i, well, source_image_column, regexp_replace(regexp_replace(file, '^file:', ''), '/(\\./)+|/{2,}', '/', 'g') AS source_image_file
  FROM f UNPIVOT (file FOR source_image_column IN (Image_FileName_DNA, Image_URL_DNA)))
""".replace("\\\\", "\\")
_UUID = "'obj-' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr({h}, 17, 1) AS INTEGER) & 3) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_NS = r"'\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB"


def _id_sql(head: str, text: str, columns: str) -> str:
    separator = ", " if head.strip().endswith(")") else " WITH "
    return f"{head}{separator}h AS (SELECT *, sha1({_NS} || encode({text})) AS h FROM src) SELECT {columns}, {_UUID.format(h='h')} AS stable_id FROM h"


@query(_FILES + "SELECT t AS table_number, i AS image_number, source_image_column, source_image_file FROM m")
def q_melt_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = picture_tables.melt_images(_files(spark, sf_dir), ["Image_FileName_DNA", "Image_URL_DNA"])
    return long.select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), "source_image_column", "source_image_file")


_KEYS3 = """'{"Metadata_ImageNumber": ' || i || ', "Metadata_ObjectNumber": ' || o || ', "Metadata_TableNumber": ' || t || '}'"""
_KEYS2 = """'{"Metadata_ImageNumber": ' || i || ', "Metadata_TableNumber": ' || t || CASE WHEN well IS NULL THEN '' ELSE ', "Metadata_Well": "' || well || '"' END || '}'"""
_WITH_FILE = """ || ', "source_image_column": "' || source_image_column || '", "source_image_file": "' || source_image_file || '"}'"""


@query(_id_sql(_BOXED + """, v AS (SELECT *, trunc(try_cast(x0 AS DOUBLE)) AS a, trunc(try_cast(x1 AS DOUBLE)) AS b, trunc(try_cast(y0 AS DOUBLE)) AS c, trunc(try_cast(y1 AS DOUBLE)) AS d FROM b),
src AS (SELECT t, i, o, CASE WHEN a < b AND c < d THEN '{"x_max": ' || CAST(b AS BIGINT) || ', "x_min": ' || CAST(a AS BIGINT) || ', "y_max": ' || CAST(d AS BIGINT) || ', "y_min": ' || CAST(c AS BIGINT) || '}' ELSE '{}' END AS box FROM v)""",
    f"""'{{"bbox": ' || box || ', "keys": ' || {_KEYS3} || '}}'""", "t AS table_number, i AS image_number, o AS object_number"))
def q_object_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ids.stamp_object_ids(_boxed(spark, sf_dir).where("Nuclei_AreaShape_BoundingBoxMaximum_X IS NOT NULL"))
    return df.select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), F.col("Metadata_ObjectNumber").alias("object_number"), F.col("Metadata_ObjectID").alias("stable_id"))


@query(_id_sql(_FILES + ", src AS (SELECT * FROM m)", f"""'{{"bbox": {{}}, "keys": ' || {_KEYS2}{_WITH_FILE}""", "t AS table_number, i AS image_number, source_image_column, source_image_file"))
def q_crop_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = picture_tables.melt_images(_files(spark, sf_dir), ["Image_FileName_DNA", "Image_URL_DNA"])
    return long.select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), "source_image_column", "source_image_file", ids.crop_ids(long, F.col("source_image_column"), F.col("source_image_file")).alias("stable_id"))


@query(_id_sql(_FILES + ", src AS (SELECT * FROM m)", f"""'{{"keys": ' || {_KEYS2}{_WITH_FILE}""", "t AS table_number, i AS image_number, source_image_column, source_image_file"))
def q_image_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = picture_tables.source_image_rows(_files(spark, sf_dir))
    return long.select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), "source_image_column", "source_image_file", F.col("Metadata_ImageID").alias("stable_id"))


@query(_BOXED + r""", f AS (SELECT TableNumber AS t, ImageNumber AS i, max(FileName_DNA) AS file FROM image GROUP BY ALL),
p AS (SELECT b.*, file FROM b JOIN f USING (t, i) WHERE try_cast(x0 AS DOUBLE) < try_cast(x1 AS DOUBLE) AND try_cast(y0 AS DOUBLE) < try_cast(y1 AS DOUBLE) AND file IS NOT NULL),
marked AS (SELECT DISTINCT TableNumber AS t, ImageNumber AS i, Parent_Nuclei AS o, true AS has FROM ph3)
SELECT t AS table_number, i AS image_number, o AS object_number, 'Image_FileName_DNA' AS source_image_column, file AS source_image_file,
  CASE WHEN has THEN 'mask' END AS label_source_kind FROM p LEFT JOIN marked USING (t, i, o)""")
def q_profile_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, stored with their identifiers, and the crops of those that PH3 objects refer to."""
    files = _files(spark, sf_dir).select("Metadata_TableNumber", "Metadata_ImageNumber", "Image_FileName_DNA")
    profiles = materialize(ids.stamp_object_ids(_boxed(spark, sf_dir).where("Nuclei_AreaShape_BoundingBoxMaximum_X IS NOT NULL").join(files, ["Metadata_TableNumber", "Metadata_ImageNumber"])), "profiles")
    keys = {"Metadata_TableNumber": "TableNumber", "Metadata_ImageNumber": "ImageNumber", "Metadata_ObjectNumber": "Parent_Nuclei"}
    marked = table(spark, sf_dir, "ph3").select(*(F.col(c).alias(k) for k, c in keys.items()))
    crops = profiles.join(marked, list(keys), "left_semi").select("Metadata_ObjectID", F.lit("Image_FileName_DNA").alias("source_image_column"), F.col("Image_FileName_DNA").alias("source_image_file"), F.lit("mask").alias("label_source_kind"))
    view = picture_tables.profile_with_images(profiles, crops)
    return view.select(F.col("Metadata_TableNumber").alias("table_number"), F.col("Metadata_ImageNumber").alias("image_number"), F.col("Metadata_ObjectNumber").alias("object_number"), "source_image_column", "source_image_file", "label_source_kind")


@query("SELECT DISTINCT FileName_DNA AS file_name FROM image WHERE FileName_DNA IS NOT NULL AND FileName_DNA NOT IN (SELECT FileName_DNA FROM image WHERE removed_at IS NOT NULL AND FileName_DNA IS NOT NULL)")
def q_source_image_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "image").where("FileName_DNA IS NOT NULL").select(F.col("FileName_DNA").alias("file_name"), "removed_at")
    return picture_tables.unseen(df.select("file_name").dropDuplicates(["file_name"]), df.where("removed_at IS NOT NULL"), "file_name")


@query(r"""
WITH files AS (SELECT DISTINCT path FROM image_file),
wanted AS (SELECT DISTINCT '/data/' || path AS value FROM image_file UNION SELECT DISTINCT regexp_extract(path, '[^/]*/[^/]*$') FROM image_file),
tries AS (SELECT value, unnest(range(1, len(string_split(value, '/')) + 1)) AS rank FROM wanted),
ends AS (SELECT value, rank, array_to_string(string_split(value, '/')[rank:], '/') AS name FROM tries),
hits AS (SELECT value, rank, path FROM ends JOIN files ON name = path),
names AS (SELECT value, 1000 AS rank, path FROM wanted JOIN files ON regexp_extract(value, '[^/]*$') = regexp_extract(path, '[^/]*$')),
found AS (SELECT * FROM hits UNION ALL SELECT * FROM names),
best AS (SELECT value, min(rank) AS rank FROM found GROUP BY value)
SELECT value, min(path) AS path, count(DISTINCT path) AS n FROM found JOIN best USING (value, rank) GROUP BY value""")
def q_path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by whole path and by the end of one, looked up among the paths of a folder."""
    paths = table(spark, sf_dir, "image_file").select("path").distinct()
    by_path = paths.select(F.lit("path").alias("kind"), F.col("path").alias("name"), "path")
    by_name = paths.select(F.lit("name").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    values = paths.select(F.concat(F.lit("/data/"), "path").alias("value")).unionByName(paths.select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("value")))
    return images.resolve_files(values, "value", images.index_frame(by_path.unionByName(by_name)))


@query(r"""
WITH v AS (SELECT DISTINCT p_name AS value FROM part),
k AS (SELECT value, regexp_extract(value, '([a-z]+)', 1) AS id FROM v),
masks AS (SELECT DISTINCT 'mask_' || id AS stem FROM k WHERE id <> '')
SELECT value, min(stem) || '.tif' AS path FROM k JOIN masks ON contains(stem, id) WHERE id <> '' GROUP BY value""")
def q_segmentation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    words = [r[0] for r in values.select(F.regexp_extract("value", "([a-z]+)", 1)).distinct().collect()]  # a fixed vocabulary
    names = [f"mask_{w}.tif" for w in words if w]
    index = images.index_files(spark, names)
    return images.segmentation_paths(values.withColumn("candidate", F.lit("none.tif")), "value", "candidate", names, {r"^mask_.*\.tif$": r"^\W*([a-z]+)\b"}, index)


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'outline' WHEN value > 50 THEN 'mask' END AS label_source_kind, CASE WHEN event_type = 'click' THEN 'o' WHEN value > 50 THEN 'm' END AS ome_arrow_label FROM events")
def q_label_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "o").alias("ome_arrow_outline"), F.when(F.col("value") > 50, "m").alias("ome_arrow_mask"))
    return picture_tables.label_columns(df).select("event_id", "label_source_kind", "ome_arrow_label")


# -- arrays, types, tables, files


@query(_told_sql("SELECT TableNumber, ImageNumber, Metadata_Site, Count_Cells, Count_Nuclei, Count_PH3, Channel_DNA, ExecutionTime_01Images FROM image", "Count_Cells", "Count_Nuclei", "Count_PH3", "ExecutionTime_01Images"))
def q_numeric_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "image")
    return _told(df.select(*types.split_numeric(df.schema)[0]))


@query("SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS DP_{i + 1}" for i in range(64)) + " FROM embeddings")
def q_npz_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    return npz.array_columns(df, "features", "DP", npz.array_width(df, "features"))


_DESCRIBED = ("image", "nuclei", "ph3", "experiment", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _DESCRIBED))
def q_describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_frames(spark, {t: table(spark, sf_dir, t) for t in _DESCRIBED})


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_limit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(5)


@query("SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read back by the inferring scan."""
    folder = shared_path(spark, "csv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.option("header", True).option("escape", '"').csv(folder)
    return types.cast_types(delimited.read_csv(spark, walk_files(folder, "*.csv")))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS mixed FROM customer")
def q_sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database with values of a wrong class in one column, read by ranges of row ids."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("mixed"))
    path = shared_path(spark, "database") + ".sqlite"
    with closing(sqlite3.connect(":memory:")) as db:  # a database has one writer; rows come a partition at a time
        db.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR(25), c_nationkey INTEGER, mixed DOUBLE)")
        db.executemany("INSERT INTO customer VALUES (?, ?, ?, ?)", ((*r[:3], "nan" if r[3] is None else r[3]) for r in rows.toLocalIterator()))
        db.commit()
        storage.create(path, db.serialize())
    return sqlite.read_sqlite(spark, path, "customer", partitions=8)


@query()
def q_crc32_tablenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table numbers of exports: the CRC-32 of each file's bytes."""
    return table(spark, sf_dir, "image_file").select("file_id", F.crc32(F.encode("body", "UTF-8")).alias("table_number"))


def export_folder(spark: SparkSession, sf_dir: str, change: Callable[[str, DataFrame], DataFrame] = lambda role, df: df) -> str:
    """The stand-in compartments as a folder of CSV exports, each in two folders; ``change`` may add columns to a compartment."""
    root = shared_path(spark, "export")
    names = {"Metadata_ImageNumber": "ImageNumber", "Metadata_ObjectNumber": "ObjectNumber", "Metadata_Cytoplasm_Parent_Cells": "Parent_Cells", "Metadata_Cytoplasm_Parent_Nuclei": "Parent_Nuclei"}
    roles = _roles(spark, sf_dir)
    roles["cytoplasm"] = roles["cytoplasm"].withColumn("Number_Object_Number", F.col("Metadata_ObjectNumber"))
    for role, df in roles.items():
        staged = f"{root}/staged-{role}"
        change(role, df).withColumnsRenamed(names).coalesce(2).write.option("header", True).csv(staged)
        for i, path in enumerate(walk_files(staged, "*.csv")):
            storage.make_folder(f"{root}/tables/{i}")
            storage.move(path, f"{root}/tables/{i}/{role.capitalize()}.csv")
    return f"{root}/tables"


@query(_STAND_INS + """
SELECT image.Metadata_ImageNumber, Image_FileName_DNA, cytoplasm.Metadata_ObjectNumber, Metadata_Cytoplasm_Parent_Cells, Metadata_Cytoplasm_Parent_Nuclei, Cytoplasm_Size,
  cytoplasm.Metadata_ObjectNumber AS Cytoplasm_Number_Object_Number, cells.Metadata_ObjectNumber AS Metadata_ObjectNumber_1, Cells_Feature,
  nuclei.Metadata_ObjectNumber AS Metadata_ObjectNumber_2, Nuclei_Feature
FROM cytoplasm LEFT JOIN cells USING (Metadata_ImageNumber) LEFT JOIN nuclei USING (Metadata_ImageNumber) LEFT JOIN image USING (Metadata_ImageNumber)
WHERE cells.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Cells AND nuclei.Metadata_ObjectNumber = cytoplasm.Metadata_Cytoplasm_Parent_Nuclei""")
def q_convert_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline from CSV exports to the joined Parquet dataset, read back."""
    out = shared_path(spark, "converted")
    return spark.read.parquet(convert(spark, export_folder(spark, sf_dir), out, "parquet", add_tablenumber=False, source_datatype="csv"))


@query("SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_acctbal > 0")
def q_warehouse_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots appended to a warehouse table, read back by its unqualified name."""
    root, df = shared_path(spark, "warehouse"), table(spark, sf_dir, "supplier")
    catalog = Catalog(root)
    catalog.append("supplier", df)
    catalog.append("supplier", df.where("s_acctbal > 0"))
    return read_table(spark, root, "supplier")


@query("SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS best FROM supplier GROUP BY s_nationkey")
def q_warehouse_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "views")
    catalog = Catalog(root)
    catalog.append("supplier", table(spark, sf_dir, "supplier"))
    catalog.create_view("by_nation", "sql", sql="SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS best FROM {profiles.supplier} GROUP BY s_nationkey")
    return read_table(spark, root, "by_nation")


@query("SELECT DISTINCT ON (TableNumber, ImageNumber) TableNumber, ImageNumber, min(loaded_at) AS loaded_at FROM image GROUP BY TableNumber, ImageNumber")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image loads that arrive as files of a stream, each key stored once."""
    root = shared_path(spark, "stream")
    loads = table(spark, sf_dir, "image").groupBy("TableNumber", "ImageNumber").agg(F.min("loaded_at").alias("loaded_at"))
    for _ in range(2):
        loads.repartition(2).write.mode("append").parquet(f"{root}/in")
    catalog = Catalog(f"{root}/warehouse")
    ingest(spark, f"{root}/in", "TableNumber bigint, ImageNumber bigint, loaded_at timestamp_ntz", catalog, "loads", f"{root}/checkpoint", ["TableNumber", "ImageNumber"], files_per_batch=2).awaitTermination()
    return catalog.read(spark, "loads")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day of event time, from a stream; complete output once all files are read."""
    folder = shared_path(spark, "events")
    table(spark, sf_dir, "events").select(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"), "event_type").repartition(shuffle_partitions(spark)).write.parquet(folder)
    name = "w" + os.path.basename(folder).replace("-", "")
    stream = counts_by_period(spark.readStream.schema("ts timestamp, event_type string").parquet(folder), "ts", "event_type", "1 day", "1 hour")
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.to_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT column_name, data_type FROM (DESCRIBE SELECT * FROM image) t(column_name, data_type, a, b, c, d)")
def q_column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of columns, under their SQL names."""
    names = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    return spark.createDataFrame([(n, names[t]) for n, t in table(spark, sf_dir, "image").dtypes], "column_name string, data_type string")
