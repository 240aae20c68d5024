"""SQLite tables as a partitioned data source.

One partition per range of row ids of a file's table, so a large database is read by many tasks. Each
cell is guarded by its declared type within SQLite: a value of another storage class becomes null.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from profloom.errors import DatatypeException
from profloom.sources import storage
from profloom.sources.discovery import open_database

# The storage class of each declared type.
AFFINITY: dict[str, tuple[str, ...]] = {
    "integer": ("int", "integer", "tinyint", "smallint", "mediumint", "bigint", "unsigned big int", "int2", "int8"),
    "text": ("character", "varchar", "varying character", "nchar", "native character", "nvarchar", "text", "clob"),
    "blob": ("blob",),
    "real": ("real", "double", "double precision", "float"),
    "numeric": ("numeric", "decimal", "boolean", "date", "datetime"),
}
# Storage classes that a column of an affinity may hold; numbers of either class fit numeric, dates are texts.
ALLOWED = {"integer": ("integer",), "text": ("text",), "blob": ("blob",), "real": ("real", "integer"), "numeric": ("integer", "real")}
SPARK = {"integer": T.LongType(), "text": T.StringType(), "blob": T.BinaryType(), "real": T.DoubleType(), "numeric": T.DoubleType()}
ARROW = {"integer": pa.int64(), "text": pa.string(), "blob": pa.binary(), "real": pa.float64(), "numeric": pa.float64()}
DATES = ("date", "datetime")
ROWS = 20_000


@dataclass(frozen=True)
class SqlColumn:
    name: str
    affinity: str

    def guarded(self) -> str:
        q = '"' + self.name.replace('"', '""') + '"'
        classes = ", ".join(f"'{c}'" for c in ALLOWED[self.affinity])
        return f"CASE WHEN typeof({q}) IN ({classes}) THEN {q} END"


def affinity_of(declared: str) -> str:
    """The storage class of a declared type; sizes in brackets don't matter."""
    name = re.sub(r"\s*\(.*\)", "", declared or "").strip().lower()
    for affinity, names in AFFINITY.items():
        if name in names:
            return "text" if name in DATES else affinity
    raise DatatypeException(f"unknown SQLite type {declared!r}")


def table_columns(path: str, table: str) -> list[SqlColumn]:
    quoted = table.replace('"', '""')
    with closing(open_database(path)) as db:
        return [SqlColumn(r[1], affinity_of(r[2])) for r in db.execute(f'PRAGMA table_info("{quoted}")')]


class _Range(InputPartition):
    def __init__(self, file: tuple, low: int | None, high: int | None) -> None:
        self.file, self.low, self.high = file, low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, files: list[tuple], columns: list[SqlColumn], partitions: int) -> None:
        self.files, self.columns, self.parts, self.at = files, columns, partitions, storage.resolver()

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in self.files:
            if "://" in file[0]:  # held in memory where it is read, so once
                out.append(_Range(file, None, None))
                continue
            try:
                with closing(open_database(file[0])) as db:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(file[1])}").fetchone()
            except sqlite3.OperationalError:  # a view or a table without row ids
                out.append(_Range(file, None, None))
                continue
            if low is not None:
                step = max(1, -(-(high - low + 1) // self.parts))
                out += [_Range(file, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [_Range(self.files[0], 1, 0)]  # an empty range, where there are no rows

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        path, table, number = partition.file
        where = "" if partition.low is None else f" WHERE rowid BETWEEN {partition.low} AND {partition.high}"
        sql = f"SELECT {', '.join(c.guarded() for c in self.columns)} FROM {_quoted(table)}{where}"
        db = open_database(path, self.at)
        try:
            cursor = db.execute(sql)
            while rows := cursor.fetchmany(ROWS):
                arrays = [pa.array([float(x) if x is not None and ARROW[c.affinity] == pa.float64() else x for x in column], ARROW[c.affinity]) for c, column in zip(self.columns, zip(*rows))]
                names = [c.name for c in self.columns]
                if number is not None:
                    arrays, names = [pa.array([number] * len(rows), pa.int64()), *arrays], ["TableNumber", *names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            db.close()


class SqliteSource(DataSource):
    """Options: files (JSON list of path, table, table number or null; all of the same columns), partitions per file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _files(self) -> list[tuple]:
        return [tuple(f) for f in json.loads(self.options["files"])]

    def schema(self) -> T.StructType:
        path, table, number = self._files()[0]
        fields = [T.StructField(c.name, SPARK[c.affinity]) for c in table_columns(path, table)]
        return T.StructType([T.StructField("TableNumber", T.LongType()), *fields] if number is not None else fields)

    def reader(self, schema: T.StructType) -> SqliteReader:
        files = self._files()
        return SqliteReader(files, table_columns(*files[0][:2]), int(self.options.get("partitions", 8)))


def _read_registered(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """The same from file systems that only this package knows, which a data source can't be told of: a task per table."""
    reader = SqliteReader(files, table_columns(*files[0][:2]), 1)
    fields = [T.StructField(c.name, SPARK[c.affinity]) for c in reader.columns]
    schema = T.StructType([T.StructField("TableNumber", T.LongType()), *fields] if files[0][2] is not None else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["i"].to_pylist():
                yield from reader.read(_Range(files[i], None, None))

    return spark.range(len(files)).withColumnRenamed("id", "i").repartition(len(files), "i").mapInArrow(run, schema)


def read_files(spark: SparkSession, files: list[tuple], partitions: int | None = None) -> DataFrame:
    """Tables of equal columns, (path, table, table number or None) each, as one DataFrame."""
    if any(storage.is_registered(f[0]) for f in files):
        return _read_registered(spark, files)
    spark.dataSource.register(SqliteSource)
    parts = partitions or max(1, spark.sparkContext.defaultParallelism * 2 // len(files))
    return spark.read.format("sqlite_table").options(files=json.dumps(files), partitions=str(parts)).load()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int | None = None) -> DataFrame:
    return read_files(spark, [(path, table, None)], partitions)
