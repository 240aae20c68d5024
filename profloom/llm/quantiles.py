"""Percentiles of very large numeric columns by deterministic, mergeable rank summaries.

A summary of n values of a group is a sorted list of tuples (value, rmin, rmax): the value's rank
lies in [rmin, rmax]. Every partition (and every block of ``block_rows`` rows in it) makes its own
summary, exact at first and then compressed so that neighbouring tuples are at most the permitted
uncertainty apart. Merging adds the rank intervals: the merged rmin of a tuple is the sum over all
summaries of the rmin of the last tuple not after it, its rmax the sum of the rmax of the first tuple
after it less one. Nothing but these intervals is assumed, so the gap between neighbours,
``max(rmax of the next − rmin)``, is at any time a proven bound for twice the rank error; it is
kept in the column ``gap``. Summaries of partitions, files or days can be stored and merged later.

Merging is hierarchical: summaries of a group are spread over about √partitions lanes, merged and
compressed there, and the lanes' results merged again, so that even a group with a third of all rows
is a few hundred tuples per lane in its last task.

Defined cases: null and NaN values don't count; a group without values has no summary; equal values
are ordered in any way, which no percentile can tell; null group keys form groups of their own unless
filtered before; infinities are values; groups with at most 1/eps values are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 0.004  # permitted rank uncertainty per level, as a share of the values; the rank error is at most this share
BLOCK_ROWS = 500_000


def _heads(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def compress(group: np.ndarray, rmin: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    """Which tuples to keep: of each group its ends, and of each stretch of eps·n ranks the last.

    ``n`` is the number of values of each tuple's group. The gap grows by at most eps·n.
    """
    step = np.maximum(1, np.floor(eps * n)).astype(np.int64)
    bucket = rmin // step
    last = np.ones(len(group), bool)
    last[:-1] = (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])
    last[_heads(group)] = True
    return last


def merge(group: np.ndarray, summary: np.ndarray, value: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the summaries of each group; ``n`` is the number of values of each tuple's summary.

    Tuples of one summary are adjacent and in order. Returns group, value, rmin, rmax and the group's n.
    """
    m = len(group)
    heads = _heads(summary)
    is_head = np.zeros(m + 1, bool)
    is_head[heads] = True
    is_head[m] = True
    step = rmin - np.where(is_head[:-1], 0, np.concatenate([[0], rmin[:-1]]))
    after = np.where(is_head[1:], n + 1, np.concatenate([rmax[1:], [0]]))
    first_rmax = np.zeros(m, np.int64)
    first_rmax[heads] = rmax[heads] - 1
    first_n = np.zeros(m, np.int64)
    first_n[heads] = n[heads]

    order = np.lexsort((rmin, summary, value, group))
    g = group[order]
    starts = _heads(g)
    sizes = np.diff(np.append(starts, m))
    within = lambda x: np.cumsum(x) - np.repeat(np.cumsum(x)[starts] - x[starts], sizes)
    total = lambda x: np.repeat(np.add.reduceat(x[order], starts), sizes)
    low = within(step[order])
    above = total(first_rmax) + within((after - rmax)[order])
    high = above - (after[order] - 1) + rmax[order]
    return g, value[order], low, high, total(first_n)


def gaps(group: np.ndarray, rmin: np.ndarray, rmax: np.ndarray) -> np.ndarray:
    """The gap of each group: twice the bound on the error of any rank looked up in it."""
    starts = _heads(group)
    gap = rmax - rmin
    gap[1:] = np.where(group[1:] == group[:-1], np.maximum(gap[1:], rmax[1:] - rmin[:-1]), gap[1:])
    return np.maximum.reduceat(gap, starts) if len(starts) else gap


def look_up(group: np.ndarray, value: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray, percent: float) -> np.ndarray:
    """Of each group the value whose rank interval is closest to the rank ⌈percent · n / 100⌉."""
    starts = _heads(group)
    sizes = np.diff(np.append(starts, len(group)))
    rank = np.maximum(1, np.ceil(percent * n / 100 - 1e-9))
    off = np.maximum(rank - rmin, rmax - rank)
    best = np.repeat(np.minimum.reduceat(off, starts), sizes)
    at = np.flatnonzero(off == best)
    return value[at[_heads(group[at])]]


def _schema(df: DataFrame, groups: list[str]) -> T.StructType:
    fields = [T.StructField(g, df.schema[g].dataType) for g in groups]
    tuples = [T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("rmin", T.ArrayType(T.LongType())), T.StructField("rmax", T.ArrayType(T.LongType()))]
    return T.StructType([*fields, T.StructField("lane", T.LongType()), T.StructField("n", T.LongType()), T.StructField("gap", T.LongType()), *tuples])


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row that is the same for equal keys; null equals null."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = pc.dictionary_encode(c, null_encoding="encode")
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _pack(keys: list[pa.Array], lane: int | pa.Array, group: np.ndarray, value: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray, eps: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Compressed summaries as rows; ``keys`` has the key of each group in order."""
    keep = compress(group, rmin, n, eps) if eps else np.ones(len(group), bool)
    group, value, rmin, rmax, n = (x[keep] for x in (group, value, rmin, rmax, n))
    starts = _heads(group)
    offsets = pa.array(np.append(starts, len(group)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value, rmin, rmax)]
    lanes = pa.array(np.full(len(starts), lane, np.int64)) if isinstance(lane, int) else lane
    batch = pa.RecordBatch.from_arrays([*keys, lanes, pa.array(n[starts]), pa.array(gaps(group, rmin, rmax)), *lists], names=names)
    for at in range(0, batch.num_rows, 8192):
        yield batch.slice(at, 8192)


def summarize(df: DataFrame, groups: list[str], value: str, eps: float = EPSILON, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Summaries of ``value`` per group, partition and block; a narrow pass without shuffle."""
    schema = _schema(df, groups)
    lanes = ceil(sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def block(held: list[pa.RecordBatch], lane: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(i).combine_chunks() if table.num_rows else table.column(i) for i in range(len(groups))]
        keys = [k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys]
        code, v = _codes(keys), table.column(len(groups)).to_numpy()
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        starts = _heads(code)
        sizes = np.diff(np.append(starts, len(code)))
        rank = np.arange(len(code)) - np.repeat(starts, sizes) + 1
        first = pa.array(order[starts])
        yield from _pack([k.take(first) for k in keys], lane, code, v, rank, rank.copy(), np.repeat(sizes, sizes), eps, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        lane, held, rows = task.partitionId() if task else 0, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= block_rows:
                yield from block(held, lane % lanes)
                held, rows, lane = [], 0, lane + 1
        if held:
            yield from block(held, lane % lanes)

    values = df.select(*groups, F.col(value).cast("double").alias("__value")).where("__value IS NOT NULL AND NOT isnan(__value)")
    return values.mapInArrow(run, schema)


def _merge_level(summaries: DataFrame, groups: list[str], eps: float, by_lane: bool) -> DataFrame:
    names = summaries.columns
    n_keys = len(groups)
    keys = [*groups, "lane"] if by_lane else groups

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        columns = [table.column(i).chunk(0) for i in range(len(names))]
        by = columns[: n_keys + 1] if by_lane else columns[:n_keys]
        code = _codes(by)
        value, rmin, rmax = (columns[names.index(c)] for c in ("value", "rmin", "rmax"))
        sizes = pc.list_value_length(value).to_numpy(zero_copy_only=False)
        spread = lambda x: np.repeat(x, sizes)
        n = columns[names.index("n")].to_numpy(zero_copy_only=False)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (value, rmin, rmax)]
        group, v, low, high, total = merge(spread(code), spread(np.arange(len(code))), *flat, spread(n))
        _, first = np.unique(code, return_index=True)
        take = pa.array(first)
        yield from _pack([c.take(take) for c in columns[:n_keys]], columns[n_keys].take(take), group, v, low, high, total, eps, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tuples = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            tuples += batch.num_rows + len(batch.column(names.index("value")).flatten())
            if tuples < 2_000_000:
                continue
            # rows are sorted by key: all but the last key's rows are whole groups
            table = pa.Table.from_batches(held)
            by = [table.column(k).combine_chunks() for k in keys]
            code = _codes([b.chunk(0) if isinstance(b, pa.ChunkedArray) else b for b in by])
            cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if cut:
                yield from merged(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                tuples = 0
        if held:
            yield from merged(pa.Table.from_batches(held))

    return summaries.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, summaries.schema)


def merge_summaries(summaries: DataFrame, groups: list[str], eps: float = EPSILON) -> DataFrame:
    """One summary per group from any number of them, by lanes first and then over the lanes."""
    return _merge_level(_merge_level(summaries, groups, eps, by_lane=True), groups, 0.0, by_lane=False)


def percentiles(summaries: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """(groups, n, gap, p…) of merged summaries; the rank of each value is off by at most gap / 2."""
    names = [*groups, "n", "gap", *(f"p{p}" for p in percents)]
    fields = [*(summaries.schema[c] for c in names[: len(groups) + 2]), *(T.StructField(f"p{p}", T.DoubleType()) for p in percents)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value, rmin, rmax = (batch[c] for c in ("value", "rmin", "rmax"))
                sizes = pc.list_value_length(value).to_numpy(zero_copy_only=False)
                group = np.repeat(np.arange(batch.num_rows), sizes)
                n = np.repeat(batch["n"].to_numpy(zero_copy_only=False), sizes)
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (value, rmin, rmax)]
                found = [pa.array(look_up(group, *flat, n, p)) for p in percents]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[: len(groups) + 2]), *found], names=names)

    return summaries.mapInArrow(run, T.StructType(fields))


def merge_parts(summaries: DataFrame, part: str, groups: list[str], eps: float = EPSILON) -> DataFrame:
    """One summary per group of summaries that were made and kept by ``part`` (a day, a file), whose lanes the parts are spread over."""
    lanes = ceil(sqrt(int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lane = F.pmod(F.xxhash64(part), F.lit(lanes)).cast("bigint")
    return merge_summaries(summaries.withColumn("lane", lane).drop(part), groups, eps)


def well_values(ph3: DataFrame, image: DataFrame, by_day: bool = False) -> DataFrame:
    """(metadata_plate, metadata_well, x) of every PH3 object once, with its image's plate and well, and if wanted the day it first came.

    Objects of several rows count with the least of their values (rows of one object agree).
    """
    x = F.col("Location_Center_X")
    key = ["TableNumber", "ImageNumber"]
    objects = ph3.where(x.isNotNull() & ~F.isnan(x)).groupBy(*key, "ObjectNumber").agg(F.min(x).alias("x"), *([F.min("loaded_at").cast("date").alias("day")] if by_day else []))
    wells = (
        image.groupBy(*key).agg(F.max("Metadata_Plate").alias("metadata_plate"), F.max("Metadata_Well").alias("metadata_well"))
        .where("metadata_plate IS NOT NULL AND metadata_well IS NOT NULL")
    )
    # the hash as a further key: images are exchanged anew and not taken as their reduction left them, as only
    # a join of two plain exchanges is split by adaptive skew handling where one image has very many objects
    both = [*key, "__hash"]
    objects, wells = (df.withColumn("__hash", F.xxhash64(*key)) for df in (objects, wells))
    return objects.join(wells, both).select("metadata_plate", "metadata_well", "x", *(["day"] if by_day else []))


def daily_summaries(ph3: DataFrame, image: DataFrame, eps: float = EPSILON) -> DataFrame:
    """A summary per well and day: what a daily run stores, to be merged into percentiles of any span of days."""
    groups = ["metadata_plate", "metadata_well", "day"]
    return merge_summaries(summarize(well_values(ph3, image, by_day=True), groups, "x", eps), groups, eps)


def well_percentiles(ph3: DataFrame, image: DataFrame, percents: list[int], eps: float = EPSILON) -> DataFrame:
    groups = ["metadata_plate", "metadata_well"]
    return percentiles(merge_summaries(summarize(well_values(ph3, image), groups, "x", eps), groups, eps), groups, percents)
