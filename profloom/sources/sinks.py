"""Writing results: Parquet datasets, single files with producer metadata, pages, AnnData."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom import __version__
from profloom.errors import DatatypeException
from profloom.functions.naming import quoted
from profloom.functions.types import split_numeric
from profloom.operators.pages import assign_pages
from profloom.sources import storage

PRODUCER = {b"data-producer": b"profloom", b"data-producer-version": __version__.encode()}


IN_MEMORY = 4 << 30  # bytes of numbers up to which a result goes through the driver


def check_free(path: str) -> None:
    """An error if ``path`` exists already."""
    if storage.exists(path):
        raise FileExistsError(f"{path} exists; it isn't overwritten")


def write_dataset(df: DataFrame, path: str) -> str:
    """A Parquet dataset: one file per task, as large results need it. The producer stands in the schema that each footer holds, beside the first column."""
    names = df.columns
    if names:
        first = quoted(names[0])
        about = df.schema[0].metadata | {k.decode(): v.decode() for k, v in PRODUCER.items()}
        df = df.select(F.col(first).alias(names[0], metadata=about), *(quoted(n) for n in names[1:]))
    df.write.parquet(path)
    return path


def write_file(df: DataFrame, path: str) -> str:
    """One Parquet file with producer metadata in its footer; for results that one file can hold.

    Spark writes the parts in parallel; they are then streamed into the file a row group at a time, and
    a rename makes it visible.
    """
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.write.parquet(parts)
    system, place = storage.locate(parts)
    try:
        files = [storage.join(place, f) for f in storage.files_in(parts) if f.endswith(".parquet")]
        schema = pq.read_schema(files[0], filesystem=system) if files else pa.schema([])
        known = {k: v for k, v in (schema.metadata or {}).items() if not k.startswith(b"org.apache.spark")}
        schema = schema.with_metadata(known | PRODUCER)
        with system.open_output_stream(f"{place}.whole") as out, pq.ParquetWriter(out, schema) as writer:
            for f in files:
                with system.open_input_file(f) as held:
                    source = pq.ParquetFile(held)
                    for i in range(source.num_row_groups):
                        writer.write_table(source.read_row_group(i).replace_schema_metadata(schema.metadata))
        storage.move(f"{parts}.whole", path)
    finally:
        storage.remove_folder(parts)
    return path


def _label(value: object) -> str:
    return str(value)


def write_pages(df: DataFrame, key: str, size: int, stem: str, sort: bool = True) -> list[str]:
    """One file per page, ``{stem}-{first key}-{last key}.parquet``; returns their paths in order of pages.

    Each page is written by one task under a name of its attempt and then renamed.
    """
    names = df.columns
    held = [f"c{i}" for i in range(len(names))]  # names as they are would be parsed
    key = held[names.index(key)]
    paged = assign_pages(df.toDF(*held), key, size)
    order = ["page", F.col(key).asc_nulls_last()] if sort else ["page"]
    at = storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, page, low, high, temporary, done = None, None, None, None, "", []

        def close() -> None:
            if writer is not None:
                writer.close()
                path = f"{stem}-{_label(low)}-{_label(high)}.parquet"
                storage.move(temporary, path, at)
                done.append((page, path))

        for batch in batches:
            ids = batch["page"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
            rows = batch.select(held)
            for a, b in zip(cuts, cuts[1:]):
                part = rows.slice(a, b - a)
                keys = [k for k in part[key].to_pylist() if k is not None]
                if ids[a] != page:
                    close()
                    page, low, high = int(ids[a]), min(keys), max(keys)
                    temporary = f"{stem}-{uuid.uuid4().hex}.tmp"
                    storage.make_folder(os.path.dirname(temporary) or ".", at)
                    system, place = at(temporary)
                    writer = pq.ParquetWriter(place, filesystem=system, schema=part.rename_columns(names).schema.with_metadata(PRODUCER))
                low, high = min(low, *keys), max(high, *keys)
                writer.write_batch(part.rename_columns(names).replace_schema_metadata(PRODUCER))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int64()), pa.array([f for _, f in done], pa.string())], names=["page", "path"])

    found = paged.repartition("page").sortWithinPartitions(*order).mapInArrow(run, "page bigint, path string").collect()
    return [r["path"] for r in sorted(found, key=lambda r: r["page"])]


def write_anndata(df: DataFrame, path: str, datatype: str) -> str:
    """Numeric columns as X, all others as obs; needs the anndata package, and a result that the driver can hold, which is measured first."""
    if datatype not in ("anndata_h5ad", "anndata_zarr"):
        raise DatatypeException(f"unknown AnnData format {datatype!r}")
    try:
        import anndata
    except ImportError as e:
        raise ImportError(f"{datatype} needs the package anndata, which isn't installed") from e
    numeric, rest = split_numeric(df.schema)
    cells = df.count() * len(df.columns)
    if cells * 8 > IN_MEMORY:
        raise DatatypeException(f"{cells} cells are too many for one {datatype} file; write Parquet")
    frame = df.toPandas()
    data = anndata.AnnData(X=frame[numeric].to_numpy(), obs=frame[rest].rename(index=str))
    data.var_names = numeric
    data.write_h5ad(path, compression="gzip") if datatype == "anndata_h5ad" else data.write_zarr(path)
    return path
