"""Incremental ingestion: plates that arrive while the engine runs, appended once each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from profloom.warehouse.catalog import Catalog


def latest_rows(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """Of each key the row loaded last."""
    rest = [c for c in df.columns if c not in key]
    last = F.max(F.struct(F.col(time), *(F.col(c) for c in rest if c != time)))
    return df.groupBy(*key).agg(last.alias("__last")).select(*key, *(F.col(f"__last.`{c}`").alias(c) for c in rest)).select(*df.columns)


def ingest(
    spark: SparkSession, source: str, schema: str, catalog: Catalog, table: str, checkpoint: str, key: list[str],
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append new Parquet files below ``source`` to a warehouse table, rows of a known key excepted.

    The stream's checkpoint remembers the files; leaving out the keys that are stored makes a batch that is
    repeated after a failure harmless. Of the table only the key columns are read, without an exchange where the batch is small.
    """

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(and_, (a[k].eqNullSafe(b[k]) for k in key))

    def add(batch: DataFrame, _: int) -> None:
        rows = transform(batch).dropDuplicates(key)
        if not catalog.table_exists(table):
            catalog.append(table, rows)
            return
        rows = rows.persist()  # used twice; lost parts are read again from the batch's files
        try:
            rows.count()  # its size is known then, and a small batch is broadcast to the table's key columns, which stay where they are
            known, keys = catalog.read(batch.sparkSession, table).select(*key), rows.select(*key)
            seen = known.join(keys, same(known, keys), "left_semi").distinct()
            catalog.append(table, rows.join(seen, same(rows, seen), "left_anti"))
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_period(stream: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Rows per key and window of event time; rows later than ``late`` don't change windows that have closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
