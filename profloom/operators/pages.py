"""Pages of rows by ranges of a key that never split equal keys: the layout of chunked output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.functions.naming import quoted
from profloom.runtime import cut_lineage, materialize, shuffle_partitions, slices


def fold_pages(counts: Iterable[tuple[object, int]], size: int, page: int = -1, room: int = 0) -> Iterator[tuple[object, int, bool]]:
    """(key, page, whether the page begins here) of sorted (key, count): a page ends with the key that fills it.

    ``page`` and ``room`` are the last page before the first key and how many rows it still takes.
    """
    for key, n in counts:
        begins = room <= 0
        if begins:
            page, room = page + 1, size
        room -= n
        yield key, page, begins


def page_ranges(keys: Iterable[object], size: int) -> list[tuple[object, object]]:
    """The inclusive ranges of sorted keys, repeated as often as they occur."""
    if size < 1:
        raise ValueError("the page size must be at least 1")
    out: list[list[object]] = []
    for key, _, begins in fold_pages(_runs(keys), size):
        if begins:
            out.append([key, key])
        out[-1][1] = key
    return [(a, b) for a, b in out]


def _runs(keys: Iterable[object]) -> Iterator[tuple[object, int]]:
    last, n = None, 0
    for k in keys:
        if n and k == last:
            n += 1
        else:
            if n:
                yield last, n
            last, n = k, 1
    if n:
        yield last, n


def jumps(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How pages run through a partition of sorted keys, for every way to enter it.

    Of each key at which the first page of the partition may begin (the first of all, and those behind the end of a page
    begun before): rows before it, pages begun from it to the partition's end, and room left in the last of them.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    full = np.searchsorted(ends, starts + size)  # the key that fills a page that begins here
    n = len(counts)
    begun, room = np.ones(n, np.int64), starts + size - (ends[-1] if n else 0)
    inner = np.flatnonzero(full < n - 1)
    begun_list, room_list, full_list = begun.tolist(), room.tolist(), full.tolist()
    for i in inner[::-1].tolist():
        begun_list[i], room_list[i] = begun_list[full_list[i] + 1] + 1, room_list[full_list[i] + 1]
    enter = min(n, int(np.searchsorted(ends, size)) + 2)
    return starts[:enter], np.array(begun_list[:enter], np.int64), np.maximum(np.array(room_list[:enter], np.int64), 0)


def key_pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, page) of each distinct key that isn't null.

    Rows are counted by key where they are and the counts are sorted by range partitions. A partition tells how pages run
    through it for every way to enter it (at most ``size`` of them); these rows, one per partition, are chained, and each
    partition then numbers its own keys.
    """
    if size < 1:
        raise ValueError("the page size must be at least 1")
    spark, kind = df.sparkSession, df.schema[key].dataType
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    long = "array<bigint>"

    def sorted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []
        for b in batches:
            held.append(b["n"].to_numpy())
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b["key"], b["n"], pa.array([part] * m, pa.int32()), pa.nulls(m, pa.int64()), *(pa.nulls(m, pa.list_(pa.int64())) for _ in range(3))], names=names)
        if held and sum(map(len, held)):
            n = np.concatenate(held)
            ways = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in jumps(n, size)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b["key"].type), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([int(n.sum())], pa.int64()), *ways], names=names)

    names = ["key", "n", "part", "rows", "before", "begun", "room"]
    schema = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL(f"n bigint, part int, rows bigint, before {long}, begun {long}, room {long}").fields])
    ordered = counts.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(sorted_counts, schema)
    walked = materialize(ordered, "pages")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, room = -1, 0
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part["part"], pa.array([page], pa.int64()), pa.array([room], pa.int64())], names=["part", "page", "room_left"])
                rows = part["rows"][0].as_py()
                before, begun, left = (part[c].flatten().to_numpy() for c in ("before", "begun", "room"))
                at = int(np.searchsorted(before, room))  # where the next page begins: at the first key with no room before it
                if at >= len(before):
                    room = max(0, room - rows)
                else:
                    page, room = page + int(begun[at]), int(left[at])

    starts = walked.where("rows IS NOT NULL").select("part", *names[3:]).repartition(1).sortWithinPartitions("part").mapInArrow(chained, "part int, page bigint, room_left bigint")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, room = None, -1, 0
        for b in batches:
            found = []
            for part, n, first_page, first_room in zip(*(b[c].to_pylist() for c in ("part", "n", "page", "room_left"))):
                if part != last:
                    last, page, room = part, first_page, first_room
                if room <= 0:
                    page, room = page + 1, size
                room -= n
                found.append(page)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(found, pa.int64())], names=["key", "page"])

    keys = walked.where("rows IS NULL").select("key", "n", "part").join(F.broadcast(starts), "part")  # a row per partition is broadcast
    return keys.repartition("part").sortWithinPartitions("part", "key").mapInArrow(numbered, T.StructType([T.StructField("key", kind), T.StructField("page", T.LongType())]))


def pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """(page, lo, hi) of all pages."""
    return _bounds(key_pages(df, key, size))


def _bounds(known: DataFrame) -> DataFrame:
    return known.groupBy("page").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))


def assign_pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with the column ``page``; rows of a null key belong to no page and drop out."""
    known = key_pages(df, key, size).withColumnRenamed("key", "__page_key")
    return df.join(known, F.col(key) == F.col("__page_key")).drop("__page_key")


def ranged(df: DataFrame, key: str, size: int) -> DataFrame:
    """Every row within the range of its page: ``df`` with page, lo and hi."""
    known = cut_lineage(key_pages(df, key, size))
    bounds = known.join(_bounds(known), "page").withColumnRenamed("key", "__page_key")
    return in_range(df.join(bounds, F.col(key) == F.col("__page_key")).drop("__page_key"), key, F.col("lo"), F.col("hi"))


def in_range(df: DataFrame, key: str, lo: object, hi: object) -> DataFrame:
    """Rows with a key from ``lo`` to ``hi``, both included."""
    return df.where(F.col(key).between(lo, hi))


def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in order of ``keys``, nulls last."""
    return df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without any null; NaN stays."""

    def all_of(names: list[str]) -> str:  # halves, as a chain of thousands would be too deep for the parser
        if len(names) == 1:
            return f"{quoted(names[0])} IS NOT NULL"
        half = len(names) // 2
        return f"({all_of(names[:half])} AND {all_of(names[half:])})"

    return df.where(all_of(df.columns)) if df.columns else df
