"""Writing a whole warehouse: profiles, crops, source images and the view that joins them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from profloom.errors import ProfileException
from profloom.functions import ids
from profloom.plans import harmonize
from profloom.presets import Preset
from profloom.sources import storage
from profloom.sources.images import require_folder
from profloom.warehouse import images
from profloom.warehouse.catalog import DEFAULT_NAMESPACE, REGISTRY, Catalog


def write_warehouse(
    spark: SparkSession,
    source_path: str,
    warehouse_path: str,
    config: Preset,
    *,
    source_datatype: str | None = None,
    data_type_cast_map: Mapping[str, str] | None = None,
    add_tablenumber: bool | None = None,
    infer_common_schema: bool = True,
    malformed: str = "files",
    image_dir: str | None = None,
    mask_dir: str | None = None,
    outline_dir: str | None = None,
    include_source_images: bool = False,
    segmentation_file_regex: Mapping[str, str] | None = None,
    bbox_column_map: Mapping[str, str] | None = None,
    default_namespace: str = DEFAULT_NAMESPACE,
    images_namespace: str = "images",
    registry_file: str = REGISTRY,
    profiles_table_name: str = "joined_profiles",
    profile_with_images_view_name: str = "profile_with_images",
) -> str:
    """Harmonize and join the exports below ``source_path`` into a new warehouse; all or nothing.

    The joined profiles are computed once and stored; crops and source images are derived from the stored
    table. Source images don't depend on whether any crop could be made.
    """
    if storage.exists(warehouse_path):
        raise FileExistsError(f"{warehouse_path} exists; it isn't overwritten")
    if not config.joins or "join" not in config.page_keys:
        raise ProfileException("a warehouse needs joins and a page key named 'join'")
    for folder, what in ((image_dir, "image_dir"), (mask_dir, "mask_dir"), (outline_dir, "outline_dir")):
        require_folder(folder, what)
    catalog = Catalog(warehouse_path, registry_file, default_namespace)
    try:
        catalog.create_namespace(default_namespace)
        df = harmonize.joined(spark, source_path, config, datatype=source_datatype, casts=data_type_cast_map, add_tablenumber=add_tablenumber, infer=infer_common_schema, malformed=malformed)
        catalog.append(f"{default_namespace}.{profiles_table_name}", ids.stamp_object_ids(harmonize.storable(df), bbox_column_map))
        if image_dir is not None:
            catalog.create_namespace(images_namespace)
            profiles = catalog.read(spark, f"{default_namespace}.{profiles_table_name}")
            crops = images.crop_table(profiles, image_dir, mask_dir, outline_dir, segmentation_file_regex, bbox_column_map)
            if crops is not None:
                catalog.append(f"{images_namespace}.{images.IMAGE_TABLE_NAME}", crops)
                catalog.create_view(
                    f"{default_namespace}.{profile_with_images_view_name}", "profile_with_images", profiles=f"{default_namespace}.{profiles_table_name}",
                    images=f"{images_namespace}.{images.IMAGE_TABLE_NAME}", bbox_column_map=dict(bbox_column_map) if bbox_column_map else None,
                )
            if include_source_images:
                whole = images.source_image_table(profiles, image_dir, mask_dir, outline_dir, segmentation_file_regex)
                if whole is not None:
                    catalog.append(f"{images_namespace}.{images.SOURCE_IMAGE_TABLE_NAME}", whole)
    except BaseException:
        storage.remove_folder(warehouse_path)
        raise
    return warehouse_path
