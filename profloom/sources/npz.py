"""NPZ embeddings: features, locations and metadata of many files as rows.

Features stay one array column until the sink; the number of columns, which a plan must know, is
taken from the first file's header and checked in every other.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.errors import SchemaException
from profloom.functions.naming import quoted
from profloom.sources.discovery import Source

DEFAULT_PREFIX = "DP"
_ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}


def _metadata(npz: np.lib.npyio.NpzFile) -> dict[str, object]:
    if "metadata" not in npz.files:
        return {}
    value = npz["metadata"]
    return dict(value.item() if value.ndim == 0 else value.ravel()[0])


def _plain(value: object) -> object:
    value = value.item() if isinstance(value, np.generic) else value
    return value if isinstance(value, (bool, int, float, str)) or value is None else str(value)


def _type(value: object) -> T.DataType:
    value = _plain(value)
    for python, kind in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType())):
        if isinstance(value, python):
            return kind
    return T.StringType()


def read_npz(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """(Metadata_TableNumber, Metadata_NPZSource, the metadata, Location_Center_X and _Y, features) of all rows."""
    with np.load(sources[0].path, allow_pickle=True) as first:
        meta = _metadata(first)
        width = first["features"].shape[1]
    keys = {k: _type(v) for k, v in meta.items()}
    numbers = {os.path.realpath(s.path): s.table_number for s in sources}
    schema = T.StructType([
        T.StructField("Metadata_TableNumber", T.LongType()), T.StructField("Metadata_NPZSource", T.StringType()),
        *(T.StructField(k, t) for k, t in keys.items()),
        T.StructField("Location_Center_X", T.DoubleType()), T.StructField("Location_Center_Y", T.DoubleType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ])
    prefix = str(meta.get("Metadata_Model") or DEFAULT_PREFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                local = path.removeprefix("file:")
                with np.load(io.BytesIO(content.as_py()), allow_pickle=True) as npz:
                    features, where, own = npz["features"], npz["locations"], _metadata(npz)
                if features.ndim != 2 or features.shape[1] != width:
                    raise SchemaException(f"{path} has features of shape {features.shape}, not of {width} columns")
                n = len(features)
                for at in range(0, n, 1024):
                    m = min(1024, n - at)
                    block = np.ascontiguousarray(features[at : at + m], dtype=np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * width, width, dtype=np.int32)), pa.array(block.ravel()))
                    number = numbers.get(os.path.realpath(local))
                    arrays = [pa.array([number] * m, pa.int64()), pa.array([os.path.basename(path)] * m, pa.string())]
                    arrays += [pa.array([_plain(own.get(k)) if not isinstance(t, T.StringType) or own.get(k) is None else str(_plain(own.get(k)))] * m, _ARROW[t]) for k, t in keys.items()]
                    arrays += [pa.array(where[at : at + m, i].astype(np.float64)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*arrays, lists], names=schema.names)

    rows = spark.read.format("binaryFile").load([s.path for s in sources]).select("path", "content").mapInArrow(run, schema)
    return rows.withMetadata("features", {"prefix": prefix, "width": width})


def array_width(df: DataFrame, array: str) -> int:
    """The length of the longest array, which a plan of one column per element must know; 0 without any."""
    return df.agg(F.max(F.size(array))).first()[0] or 0


def array_columns(df: DataFrame, array: str, prefix: str, width: int) -> DataFrame:
    """An array column as ``width`` columns, in one projection; missing elements are null."""
    rest = [quoted(n) for n in df.columns if n != array]
    return df.selectExpr(*rest, *(f"get({quoted(array)}, {i}) AS {quoted(f'{prefix}_{i + 1}')}" for i in range(width)))


def spread_features(df: DataFrame) -> DataFrame:
    """The array column ``features`` as columns ``{prefix}_1`` …"""
    about = df.schema["features"].metadata
    return array_columns(df, "features", about["prefix"], about["width"])
