"""Image tables of a warehouse: crops of objects, whole source images, and profiles with images."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.functions import ids
from profloom.functions.naming import quoted
from profloom.sources import images as files
from profloom.sources import storage
from profloom.sources.discovery import expand_path
from profloom.warehouse.catalog import Catalog, view_kind

IMAGE_TABLE_NAME = "image_crops"
SOURCE_IMAGE_TABLE_NAME = "source_images"
_PICTURES = ("image", "outline", "mask", "label")


def melt_images(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per object and image column: source_image_column, source_image_file; rows without a file drop out.

    References are put right within the array that is exploded, so each once; what generates code for ``unpivot``
    fails on such rows.
    """
    rest = [quoted(c) for c in df.columns if c not in columns]
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), ids.file_value(F.col(quoted(c))).alias("file")) for c in columns))
    long = df.select(*rest, F.explode(F.filter(pairs, lambda x: x["file"].isNotNull())).alias("__image"))
    return long.select(*rest, F.col("__image.column").alias("source_image_column"), F.col("__image.file").alias("source_image_file"))


def profile_with_images(profiles: DataFrame, crops: DataFrame | None, given: Mapping[str, str] | None = None) -> DataFrame:
    """Profiles of valid box, a row per image column, with their crops; the profiles alone if nothing can be shown."""
    box = ids.resolve_box(profiles.columns, given)
    columns = ids.image_columns(profiles)
    if box is None or not columns or crops is None:
        return profiles
    valid = profiles.where(ids.box_is_valid(ids.box_bounds(box, whole=False)))
    long = melt_images(valid, columns)
    keys = ["Metadata_ObjectID", "source_image_column", "source_image_file"]
    new = [c for c in crops.columns if c in keys or c not in long.columns]
    return long.join(crops.select(*(F.col(f"`{c}`") for c in new)), keys, "left")


@view_kind("profile_with_images")
def _view(catalog: Catalog, spark: SparkSession, view: dict) -> DataFrame:
    return profile_with_images(catalog.read(spark, view["profiles"]), catalog.read(spark, view["images"]), view.get("bbox_column_map"))


def label_columns(df: DataFrame) -> DataFrame:
    """The label of a crop: its outline, else its mask; and which of these it is."""
    kind = F.when(F.col("ome_arrow_outline").isNotNull(), "outline").when(F.col("ome_arrow_mask").isNotNull(), "mask")
    return df.withColumns({"label_source_kind": kind, "ome_arrow_label": F.coalesce("ome_arrow_outline", "ome_arrow_mask")})


def with_files(long: DataFrame, image_dir: str, mask_dir: str | None, outline_dir: str | None, patterns: Mapping[str, str] | None) -> DataFrame:
    """Melted rows with the paths of their image, mask and outline."""
    spark = long.sparkSession
    index = files.index_files(spark, files.list_images(image_dir))
    found = files.resolve_or_fail(long, "source_image_file", index).withColumnRenamed("path", "image_path")
    out = long.join(found, "source_image_file")
    for name, folder in (("mask_path", mask_dir), ("outline_path", outline_dir)):
        if folder is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
            continue
        names = files.list_images(folder)
        matched = files.segmentation_paths(out.withColumn("__image", F.col("image_path")), "source_image_file", "__image", names, patterns, files.index_files(spark, names))
        out = out.join(matched.withColumnRenamed("path", name), "source_image_file", "left")
    return out


def _pictures(rows: DataFrame, folders: Mapping[str, str | None], cut: bool) -> DataFrame:
    """Read image, mask and outline of each row, whole or cut by its box.

    Rows are grouped by file and sorted, so a task decodes each image once, and holds one at a time. An image with very many
    objects is split over tasks at run time.
    """
    names = rows.columns
    roots, at_file = {k: expand_path(v) if v else None for k, v in folders.items()}, storage.resolver()
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"ome_arrow_{k}", files.IMAGE_TYPE) for k in ("image", "outline", "mask"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[str, object]] = {}

        def picture(kind: str, path: str | None, bounds: tuple | None) -> dict | None:
            if path is None or roots[kind] is None:
                return None
            if held.get(kind, ("",))[0] != path:
                held[kind] = (path, files.load_image(storage.join(roots[kind], path), at_file))
            image = held[kind][1]
            return files.image_struct(files.crop(image, *bounds) if bounds else image)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bounds = list(zip(*(part[f"source_bbox_{b}"].to_pylist() for b in ids.BOX_PARTS))) if cut else [None] * len(part)
                new = [pa.array([picture(k, p, b) for p, b in zip(part[f"{k}_path"].to_pylist(), bounds)], files.ARROW_IMAGE) for k in ("image", "outline", "mask")]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *(f"ome_arrow_{k}" for k in ("image", "outline", "mask"))])

    return rows.hint("rebalance", "image_path").sortWithinPartitions("image_path").mapInArrow(run, schema)


def crop_table(profiles: DataFrame, image_dir: str, mask_dir: str | None = None, outline_dir: str | None = None, patterns: Mapping[str, str] | None = None, given: Mapping[str, str] | None = None) -> DataFrame | None:
    """A row per object and image column with a file and a valid box; None if there can't be any."""
    box = ids.resolve_box(profiles.columns, given)
    columns = ids.image_columns(profiles)
    if box is None or not columns:
        return None
    bounds = ids.box_bounds(box, whole=True)
    keys = ids.key_columns(profiles.columns)
    lean = profiles.where(ids.box_is_valid(bounds)).select(
        *(F.col(f"`{k}`") for k in keys), "Metadata_ObjectID", *(F.col(f"`{c}`") for c in columns), *(bounds[p].alias(f"source_bbox_{p}") for p in ids.BOX_PARTS)
    )
    long = melt_images(lean, columns)
    crop_id = ids.crop_ids(long, F.col("source_image_column"), F.col("source_image_file"), {p: F.col(f"source_bbox_{p}") for p in ids.BOX_PARTS})
    long = long.withColumn("Metadata_ImageCropID", crop_id).dropDuplicates(["Metadata_ImageCropID"])
    rows = label_columns(_pictures(with_files(long, image_dir, mask_dir, outline_dir, patterns), {"image": image_dir, "mask": mask_dir, "outline": outline_dir}, cut=True))
    return rows.select(
        *(F.col(f"`{k}`").cast("string").alias(k) for k in keys), "Metadata_ObjectID", "Metadata_ImageCropID", "source_image_column", "source_image_file",
        "label_source_kind", *(f"source_bbox_{p}" for p in ids.BOX_PARTS), *(f"ome_arrow_{k}" for k in _PICTURES),
    )


def source_image_rows(profiles: DataFrame) -> DataFrame | None:
    """A row per distinct source image: its keys, id, column and file."""
    columns = ids.image_columns(profiles)
    if not columns:
        return None
    keys = ids.key_columns(profiles.columns, image_level=True)
    long = melt_images(profiles.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`") for c in columns)).distinct(), columns)
    return long.withColumn("Metadata_ImageID", ids.image_ids(long, F.col("source_image_column"), F.col("source_image_file"))).dropDuplicates(["Metadata_ImageID"])


def source_image_table(profiles: DataFrame, image_dir: str, mask_dir: str | None = None, outline_dir: str | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame | None:
    """Every distinct source image as a whole, with its mask and outline."""
    rows = source_image_rows(profiles)
    if rows is None:
        return None
    keys = ids.key_columns(profiles.columns, image_level=True)
    whole = label_columns(_pictures(with_files(rows, image_dir, mask_dir, outline_dir, patterns), {"image": image_dir, "mask": mask_dir, "outline": outline_dir}, cut=False))
    return whole.select(*(F.col(f"`{k}`").cast("string").alias(k) for k in keys), "Metadata_ImageID", "source_image_column", "source_image_file", "label_source_kind", *(f"ome_arrow_{k}" for k in _PICTURES))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet; of the known table only that column is read."""
    return rows.join(known.select(key), key, "left_anti")
