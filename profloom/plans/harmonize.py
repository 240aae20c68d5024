"""The whole pipeline: discover, type, rename, union, join, order and write measurement exports.

Everything up to the sink is one lazy plan. What the driver does itself is metadata work: listing
files, reading headers, resolving names and types.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.errors import ProfileException, SchemaException
from profloom.functions.naming import last_occurrences, ordered_columns, prefixed_names, quoted
from profloom.functions.types import cast_types, common_schema, conform
from profloom.operators.pages import drop_null_rows, sorted_by
from profloom.plans.dialect import run_join_sql
from profloom.plans.joins import JoinSpec, join_compartments
from profloom.plans.options import check_options
from profloom.presets import Preset, preset
from profloom.sources import delimited, npz, sinks, sqlite, storage
from profloom.sources.discovery import Groups, Source, expand_path, gather_sources, number_tables

log = logging.getLogger(__name__)

Casts = Mapping[str, str] | None


@dataclass(frozen=True)
class ProfileSet:
    """Lazy tables by group, and the sources that each is read from."""

    tables: dict[str, DataFrame]
    sources: Groups

    def role(self, group: str, config: Preset) -> str | None:
        low = group.lower()
        return next((t for t in (*config.metadata, *config.compartments) if t.lower() in low), None)

    def by_role(self, config: Preset) -> dict[str, DataFrame]:
        return {r: df for g, df in self.tables.items() if (r := self.role(g, config)) is not None}


def union_all(parts: Sequence[DataFrame], casts: Casts = None, infer: bool = True) -> DataFrame:
    """All rows of the parts under their common schema; without ``infer`` the schemas must be equal."""
    if not infer:
        shape = [(f.name, f.dataType) for f in parts[0].schema.fields]
        if any([(f.name, f.dataType) for f in p.schema.fields] != shape for p in parts[1:]):
            raise SchemaException("the tables of a group differ, and no common schema was to be inferred")
        return reduce(DataFrame.unionByName, parts)
    schema, dropped = common_schema([p.schema for p in parts], casts)
    if dropped:
        log.warning("columns that not all tables of the group have are left out: %s", ", ".join(dropped))
    return reduce(DataFrame.unionByName, (conform(p, schema) for p in parts))


def _csv_parts(spark: SparkSession, sources: Sequence[Source], infer: bool = True, malformed: str = "files") -> list[DataFrame]:
    numbered = [(s.path, s.table_number) for s in sources if s.table_number is not None]
    numbers = spark.createDataFrame(numbered, "path string, TableNumber bigint") if numbered else None
    known = delimited.inspect(spark, sources, malformed)
    # what is text in some file is read as the text it is in all, not by way of a number
    texts = {f.name for h in known for f in h.schema.fields if isinstance(f.dataType, T.StringType)} if infer else set()
    parts = []
    for h in known:
        read = T.StructType([T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in h.schema.fields])
        parts.append(delimited.scan_files(spark, h, read, numbers, malformed))
    return parts


def _sqlite_parts(spark: SparkSession, sources: Sequence[Source]) -> list[DataFrame]:
    alike: dict[tuple, list[tuple]] = {}
    for s in sources:
        shape = tuple(sqlite.table_columns(s.path, s.table))
        alike.setdefault((shape, s.table_number is None), []).append((s.path, s.table, s.table_number))
    return [sqlite.read_files(spark, files) for files in alike.values()]


def read_group(spark: SparkSession, group: str, sources: Sequence[Source], kind: str, config: Preset, casts: Casts = None, infer: bool = True, malformed: str = "files") -> DataFrame:
    """One group as a DataFrame in harmonized types and names."""
    if kind == "npz":
        return npz.read_npz(spark, sources)
    parts = _csv_parts(spark, sources, infer, malformed) if kind == "csv" else _sqlite_parts(spark, sources)
    df = cast_types(union_all(parts, casts, infer), casts)
    return df.toDF(*prefixed_names(df.columns, group, config.identifying_columns, config.metadata, config.compartments))


def read_profiles(spark: SparkSession, source_path: str, config: Preset, datatype: str | None = None, casts: Casts = None, add_tablenumber: bool | None = None, infer: bool = True, malformed: str = "files") -> ProfileSet:
    groups, kind = gather_sources(spark, source_path, config.targets or None, datatype)
    if kind != "npz":
        groups = number_tables(spark, groups, add_tablenumber)
    groups_read = [(g, s) for g, s in groups.items() if s]
    with ThreadPoolExecutor(max(1, min(8, len(groups_read)))) as pool:  # the jobs that find headers and kinds of each group run side by side
        tables = list(pool.map(lambda x: read_group(spark, *x, kind, config, casts, infer, malformed), groups_read))
    return ProfileSet({g: df for (g, _), df in zip(groups_read, tables)}, groups)


def page_key(group: str, page_keys: Mapping[str, str]) -> str | None:
    return next((key for name, key in page_keys.items() if name != "join" and name.lower() in group.lower()), None)


def join_profiles(spark: SparkSession, profiles: ProfileSet, config: Preset) -> DataFrame:
    """The joined table in its column order; of columns of equal name the last stays."""
    if isinstance(config.joins, JoinSpec):
        df = join_compartments(profiles.by_role(config), config.joins)
    elif config.joins:
        stems = {os.path.splitext(g)[0]: df for g, df in profiles.tables.items()}
        df = run_join_sql(spark, config.joins, stems)
    else:
        raise ProfileException("there is nothing to join by; give joins or use join=False")
    keep = last_occurrences(df.columns)
    names = {df.columns[i]: f"`{i}`" for i in keep}
    held = df.toDF(*(str(i) for i in range(len(df.columns))))
    return held.selectExpr(*(f"{names[n]} AS {quoted(n)}" for n in ordered_columns(names)))


def joined(spark: SparkSession, source_path: str, config: Preset, *, datatype: str | None = None, casts: Casts = None, add_tablenumber: bool | None = None, infer: bool = True, drop_null: bool = False, malformed: str = "files") -> DataFrame:
    """The lazy joined table of everything below ``source_path``."""
    df = join_profiles(spark, read_profiles(spark, source_path, config, datatype, casts, add_tablenumber, infer, malformed), config)
    return drop_null_rows(df) if drop_null else df


SORT_KEYS = ("TableNumber", "ImageNumber", "ObjectNumber", "Object_Number")


def sort_keys(names: Sequence[str], first: str) -> list[str]:
    """The keys that follow ``first`` in the order of output: by them rows of one page key, an object number as a rule, are told apart,
    so that the sort can spread them over many tasks and gives the same order every time."""
    ranked = [(i, n) for n in names if n != first and (n.startswith("Metadata_") or n in SORT_KEYS) for i, end in enumerate(SORT_KEYS) if n.endswith(end)]
    return [n for _, n in sorted(ranked)]


def storable(df: DataFrame) -> DataFrame:
    """Columns that were blank in all files become text, so that any reader takes them."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.withColumns({n: F.lit(None).cast("string") for n in void}) if void else df


def convert(
    spark: SparkSession,
    source_path: str,
    dest_path: str,
    dest_datatype: str = "parquet",
    *,
    dest_backend: str = "parquet",
    image_dir: str | None = None,
    mask_dir: str | None = None,
    outline_dir: str | None = None,
    include_source_images: bool = False,
    segmentation_file_regex: Mapping[str, str] | None = None,
    source_datatype: str | None = None,
    metadata: Sequence[str] | None = None,
    compartments: Sequence[str] | None = None,
    identifying_columns: Sequence[str] | None = None,
    concat: bool = True,
    join: bool = True,
    joins: JoinSpec | str | None = None,
    chunk_size: int | None = None,
    infer_common_schema: bool = True,
    drop_null: bool = False,
    data_type_cast_map: Casts = None,
    add_tablenumber: bool | None = None,
    page_keys: Mapping[str, str] | None = None,
    bbox_column_map: Mapping[str, str] | None = None,
    sort_output: bool = True,
    preset_name: str | None = "cellprofiler_csv",
    single_file: bool = False,
    rejects_path: str | None = None,
    **warehouse_options: Any,
) -> str | list[str] | dict[str, list[dict]]:
    """Harmonize the exports below ``source_path`` and write them to ``dest_path``.

    Joined and concatenated, the result is one Parquet dataset (a folder of files; one file with
    ``single_file``), whose path is returned. Joined only, it is one file per page of the join's page key,
    and their paths are returned. Not joined, each group is written to ``dest_path/{group}/`` and
    described as ``{group: [{"source_path", "table": [paths]}]}``; not concatenated either, each source by itself in pages.

    CSV files with records that fail to parse are left out with a warning; with ``rejects_path`` such records alone are, and
    are written there (path, at, reason, raw).
    """
    dest = expand_path(dest_path)
    check_options(
        dest_backend, dest_datatype, concat=concat, join=join, drop_null=drop_null, image_dir=image_dir, mask_dir=mask_dir,
        outline_dir=outline_dir, include_source_images=include_source_images, segmentation_file_regex=segmentation_file_regex,
    )
    sinks.check_free(dest)
    config = preset(preset_name).resolve(
        metadata=metadata, compartments=compartments, identifying_columns=identifying_columns, joins=joins, chunk_size=chunk_size,
        page_keys=dict(page_keys) if page_keys is not None else None,
    )
    if join and "join" not in config.page_keys:
        raise ProfileException("joined output needs a page key named 'join'")
    malformed = "files"
    if rejects_path is not None:
        sinks.check_free(expand_path(rejects_path))
        groups, kind = gather_sources(spark, source_path, config.targets or None, source_datatype)
        if kind == "csv":
            malformed = "rows"
            sinks.write_dataset(delimited.rejected_records(spark, [s.path for sources in groups.values() for s in sources]), expand_path(rejects_path))
    if dest_backend == "iceberg":
        from profloom.warehouse.build import write_warehouse

        return write_warehouse(
            spark, source_path, dest, config, source_datatype=source_datatype, data_type_cast_map=data_type_cast_map,
            add_tablenumber=add_tablenumber, infer_common_schema=infer_common_schema, malformed=malformed, image_dir=image_dir, mask_dir=mask_dir,
            outline_dir=outline_dir, include_source_images=include_source_images, segmentation_file_regex=segmentation_file_regex,
            bbox_column_map=bbox_column_map, **warehouse_options,
        )
    if join:
        df = storable(joined(spark, source_path, config, datatype=source_datatype, casts=data_type_cast_map, add_tablenumber=add_tablenumber, infer=infer_common_schema, drop_null=drop_null, malformed=malformed))
        key = config.page_keys["join"]
        if not concat:
            return sinks.write_pages(df, key, config.chunk_size, os.path.splitext(dest)[0], sort_output)
        df = sorted_by(df, key, *sort_keys(df.columns, key)) if sort_output and key in df.columns else df
        if dest_datatype != "parquet":
            return sinks.write_anndata(df, dest, dest_datatype)
        return sinks.write_file(df, dest) if single_file else sinks.write_dataset(df, dest)
    return _write_groups(spark, source_path, dest, config, concat, source_datatype, data_type_cast_map, add_tablenumber, infer_common_schema, drop_null, sort_output, single_file, malformed)


def _write_groups(spark: SparkSession, source_path: str, dest: str, config: Preset, concat: bool, datatype: str | None, casts: Casts, add_tablenumber: bool | None, infer: bool, drop_null: bool, sort: bool, single_file: bool, malformed: str = "files") -> dict[str, list[dict]]:
    groups, kind = gather_sources(spark, source_path, config.targets or None, datatype)
    if kind != "npz":
        groups = number_tables(spark, groups, add_tablenumber)
    out: dict[str, list[dict]] = {}

    def finished(group: str, sources: Sequence[Source]) -> DataFrame:
        df = read_group(spark, group, sources, kind, config, casts, infer, malformed)
        df = npz.spread_features(df) if kind == "npz" else df
        return storable(drop_null_rows(df) if drop_null else df)

    for group, sources in groups.items():
        key = page_key(group, config.page_keys)
        if key is None and kind != "npz":
            raise ProfileException(f"no page key fits the group {group}")
        stem = os.path.splitext(group)[0].lower()
        storage.make_folder(os.path.join(dest, stem))
        if concat:
            df, path = finished(group, sources), os.path.join(dest, stem, f"{stem}.parquet")
            names = dict(zip(delimited_names(df.columns), df.columns))
            order = names.get((key or "").lower())
            df = sorted_by(df, order, *sort_keys(df.columns, order)) if sort and order else df
            out[group] = [{"source_path": os.path.join(dest, stem), "table": [sinks.write_file(df, path) if single_file else sinks.write_dataset(df, path)]}]
            continue
        out[group] = []
        root = expand_path(source_path)
        for s in sources:
            df = finished(group, [s])
            folder = os.path.join(dest, stem, os.path.relpath(s.parent, root if storage.is_folder(root) else s.parent).lower())
            folder = folder if "://" in folder else os.path.normpath(folder)
            storage.make_folder(folder)
            base = os.path.join(folder, s.stem + (f".{s.table}" if s.table else ""))
            named = next((n for n in df.columns if key and n.endswith(key)), None)
            tables = sinks.write_pages(df, named, config.chunk_size, base, sort) if named else [sinks.write_dataset(df, f"{base}.parquet")]
            out[group].append({"source_path": s.path, "table_name": s.table, "tablenumber": s.table_number, "page_key": key, "table": tables})
    return out


def delimited_names(names: Sequence[str]) -> list[str]:
    """Lower-case names without the prefixes that harmonization put in front, to find a page key again."""
    out = []
    for n in names:
        low = n.lower()
        out.append(low.removeprefix("metadata_"))
    return out
