"""One way to list, describe and read Parquet data and warehouses."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from profloom.errors import NoInputDataException
from profloom.sources import storage
from profloom.warehouse.catalog import REGISTRY, Catalog


def is_warehouse(path: str, registry_file: str = REGISTRY) -> bool:
    return storage.is_folder(path) and Catalog(path, registry_file).version() > 0


def _only_name(path: str) -> str:
    return os.path.splitext(os.path.basename(os.path.normpath(path)))[0]


def list_tables(path: str) -> list[str]:
    """Names of all tables and views; of Parquet data the one name of the file or folder."""
    if is_warehouse(path):
        return Catalog(path).names()
    if not storage.exists(path):
        raise NoInputDataException(f"there is nothing at {path}")
    return [_only_name(path)]


def read_table(spark: SparkSession, path: str, table_name: str | None = None) -> DataFrame:
    """A table as a lazy DataFrame; the name may be left out where there is only one."""
    if is_warehouse(path):
        catalog = Catalog(path)
        if table_name is None:
            names = catalog.names(include_views=False)
            if len(names) != 1:
                raise NoInputDataException(f"a table name is needed; there are {', '.join(names)}")
            table_name = names[0]
        return catalog.read(spark, table_name)
    if not storage.exists(path):
        raise NoInputDataException(f"there is nothing at {path}")
    if table_name is not None and table_name != _only_name(path):
        raise NoInputDataException(f"{path} holds only the table {_only_name(path)}")
    return spark.read.parquet(path)


def _footers(folders: list[str]) -> tuple[int, int]:
    """Rows and files below some folders, from the footers alone."""
    rows = files = 0
    for folder in folders:
        system, place = storage.locate(folder)
        for name in storage.files_in(folder):
            if name.endswith(".parquet"):
                rows += pq.read_metadata(storage.join(place, name), filesystem=system).num_rows
                files += 1
    return rows, files


DESCRIPTION = "table string, kind string, rows bigint, files bigint, snapshot string"


def describe_warehouse(spark: SparkSession, path: str) -> DataFrame:
    """A row per table and view: kind, rows, files and current snapshot; views have no rows of their own."""
    catalog = Catalog(path)
    state = catalog.state()
    out: list[tuple] = []
    for name in catalog.names():
        if name in state["views"]:
            out.append((name, "view", None, 0, None))
            continue
        rows, files = _footers(catalog.folders(name))
        snapshots = state["tables"][name]["snapshots"]
        out.append((name, "table", rows, files, snapshots[-1] if snapshots else None))
    return spark.createDataFrame(out, DESCRIPTION)


def describe_frames(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several DataFrames, counted in one job each by column-free scans."""
    from functools import reduce

    from pyspark.sql import functions as F

    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
