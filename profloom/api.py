"""The public functions in one place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from profloom.errors import DatatypeException, NoInputDataException, ProfileException, SchemaException
from profloom.functions.ids import object_id
from profloom.plans.harmonize import convert
from profloom.presets import PRESETS as config
from profloom.warehouse.access import describe_warehouse, is_warehouse, list_tables, read_table
from profloom.warehouse.build import write_warehouse
from profloom.warehouse.catalog import Catalog
from profloom.warehouse.images import IMAGE_TABLE_NAME


def list_iceberg_tables(path: str, include_views: bool = True) -> list[str]:
    """Full names of a warehouse's tables, and of its views if wanted."""
    if not is_warehouse(path):
        raise NoInputDataException(f"there is no warehouse at {path}")
    return Catalog(path).names(include_views)


def read_iceberg_table(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """A warehouse's table or view as a lazy DataFrame."""
    return Catalog(path).read(spark, table_name)


def write_iceberg_warehouse(spark: SparkSession, source_path: str, warehouse_path: str, preset_name: str | None = "cellprofiler_csv", **options: Any) -> str:
    """:func:`convert` into a warehouse, with the same options."""
    return convert(spark, source_path, warehouse_path, dest_backend="iceberg", preset_name=preset_name, **options)


describe_iceberg_warehouse = describe_warehouse

__all__ = [
    "Catalog", "DatatypeException", "IMAGE_TABLE_NAME", "NoInputDataException", "ProfileException", "SchemaException",
    "config", "convert", "describe_iceberg_warehouse", "describe_warehouse", "list_iceberg_tables", "list_tables", "object_id",
    "read_iceberg_table", "read_table", "write_iceberg_warehouse", "write_warehouse",
]
